"""Statistical kernels without a SQL form, as pandas UDFs over numpy: tails, rank tests, string ratios, fits."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# tails -------------------------------------------------------------------------------------------

TAILS = T.StructType([T.StructField(x, T.DoubleType()) for x in ("lower", "upper", "two_sided")])
_log_factorials = np.zeros(2)
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: int) -> float:
    return upper_gamma(df / 2.0, x / 2.0)


@lru_cache(maxsize=1 << 16)
def poisson_at_least(k: int, mean: float) -> float:
    """P(X >= k) for a Poisson mean."""
    if k <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    return 1.0 - upper_gamma(k, mean) if mean < k + 1 and upper_gamma(k, mean) < 0.5 else _poisson_tail(k, mean)


def _poisson_tail(k: int, mean: float) -> float:
    """The same by summing terms upwards, which keeps small tails exact."""
    log_term = k * math.log(mean) - mean - math.lgamma(k + 1)
    term, total, i = 1.0, 1.0, k
    while term > total * 1e-17:
        i += 1
        term *= mean / i
        total += term
        if i > k + 100_000:
            break
    return min(1.0, math.exp(log_term) * total)


def log_factorials(n: int) -> np.ndarray:
    """ln 0! ... ln n!; one table grows as needed."""
    global _log_factorials
    if len(_log_factorials) <= n:
        _log_factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * n + 2)))])
    return _log_factorials[: n + 1]


@lru_cache(maxsize=1 << 16)
def binomial_tails(k: int, n: int, p: float) -> tuple[float, float, float]:
    """P(X <= k), P(X >= k) and the exact two-sided p: the sum of outcomes no likelier than k."""
    if p <= 0 or p >= 1:
        hit = k == (0 if p <= 0 else n)
        return (1.0 if k >= n or p <= 0 else 0.0, 1.0 if k <= 0 or p >= 1 else 0.0, 1.0 if hit else 0.0)
    i = np.arange(n + 1)
    f = log_factorials(n)
    log = f[n] - f - f[::-1] + i * math.log(p) + (n - i) * math.log1p(-p)
    pmf = np.exp(log)
    return min(1.0, float(pmf[: k + 1].sum())), min(1.0, float(pmf[k:].sum())), min(1.0, float(pmf[pmf <= pmf[k] * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    out = normal_two_sided(z.fillna(0).to_numpy(float))
    return pd.Series(out).where(z.notna().to_numpy())


@F.pandas_udf(T.DoubleType())
def poisson_p(observed: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(e) or pd.isna(o) else poisson_at_least(int(o), round(float(e), 12)) for o, e in zip(observed, expected)], dtype="float64")


@F.pandas_udf(TAILS)
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if pd.isna(q) or pd.isna(b) or b <= 0 else binomial_tails(int(a), int(b), round(float(q), 12)) for a, b, q in zip(k, n, p)]
    return pd.DataFrame(rows, columns=["lower", "upper", "two_sided"], dtype="float64")


# strings -----------------------------------------------------------------------------------------


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / total if total else 100.0


def set_ratio(a: str, b: str) -> float:
    """Token-set ratio: the best Indel ratio among the shared words and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    best = indel_ratio(one, two)
    return max(best, indel_ratio(both, one), indel_ratio(both, two)) if both else best


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def compatibility_form(s: pd.Series) -> pd.Series:
    """NFKC of texts; nulls pass, so that callers can leave out what is ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


# fits --------------------------------------------------------------------------------------------


def fit_logit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, bool]:
    """Binomial logit by weighted least squares, with a light ridge where the plain fit does not settle."""
    for ridge in (0.0, 1e-4):
        beta = np.zeros(x.shape[1])
        ok = False
        for _ in range(rounds):
            mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            v = np.maximum(w * mu * (1 - mu), 1e-12)
            hessian = x.T @ (x * v[:, None]) + ridge * w.sum() * np.eye(x.shape[1])
            try:
                step = np.linalg.solve(hessian, x.T @ (w * (y - mu)) - ridge * w.sum() * beta)
            except np.linalg.LinAlgError:
                break
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                ok = True
                break
            if not np.isfinite(beta).all() or np.abs(beta).max() > 50:
                break
        if ok:
            return beta, ridge == 0.0
    return beta if np.isfinite(beta).all() else np.zeros(x.shape[1]), False


def pelt(values: np.ndarray, penalty: float, least: int, jump: int = 5) -> list[int]:
    """Optimal partition under squared error by dynamic programming with pruning; breaks on multiples of `jump`."""
    n = len(values)
    s1, s2 = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    ends = [k for k in range(jump, n, jump) if k >= least] + [n]
    best = np.full(n + 1, np.inf)
    before = np.full(n + 1, -1, np.int64)
    best[0] = -penalty
    live = np.zeros(1, np.int64)
    for e in ends:
        ready = live <= e - least
        starts = live[ready]
        if not len(starts):
            continue
        cost = s2[e] - s2[starts] - (s1[e] - s1[starts]) ** 2 / (e - starts)
        total = best[starts] + cost
        k = int(total.argmin())
        best[e], before[e] = total[k] + penalty, starts[k]
        live = np.concatenate([starts[total <= best[e]], live[~ready], [e]])  # later ends may still start a segment
    out, e = [], n
    while before[e] > 0:
        e = int(before[e])
        out.append(e)
    return sorted(out)


def isolation_scores(x: np.ndarray, trees: int = 300, seed: int = 42) -> np.ndarray:
    """Isolation forest scores in (0, 1]; higher is more isolated."""
    rng = np.random.default_rng(seed)
    n, size = len(x), min(256, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def c(m: np.ndarray | float) -> np.ndarray:
        m = np.asarray(m, float)
        return np.where(m > 2, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1), np.where(m == 2, 1.0, 0.0))

    depth = np.zeros(n)
    for _ in range(trees):
        sample = x[rng.choice(n, size, replace=False)]
        stack = [(np.arange(size), np.arange(n), 0)]
        while stack:
            inside, reach, level = stack.pop()
            if not len(reach):
                continue
            part = sample[inside]
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(x.shape[1]),) * 2
            able = np.flatnonzero(high > low)
            if level >= limit or len(inside) <= 1 or not len(able):
                depth[reach] += level + c(len(inside))
                continue
            d = int(rng.choice(able))
            cut = rng.uniform(low[d], high[d])
            stack.append((inside[part[:, d] < cut], reach[x[reach, d] < cut], level + 1))
            stack.append((inside[part[:, d] >= cut], reach[x[reach, d] >= cut], level + 1))
    return 2.0 ** (-(depth / trees) / max(float(c(size)), 1e-9))
