"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from byte and word arrays of many texts at once; trees are grown level by level on
binned statistics with the logistic loss and then flattened into arrays of feature, threshold,
child and value, so that a batch of texts walks all trees with array indexing alone.

Defined cases: a null text is empty; an empty text has zero statistics and is scored like any
other; without rows of both labels every score is the mean label (0.5 without any); rows without
a label are not learned from; where an id has several label rows their mean is its label; equal
texts have equal scores; very long texts count whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, remainder, steps, thinned, utf8
from hustings.llm.wordhash import hashes, lowered, rolling, spans

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "punctuation", "exclaim", "symbol", "pipe", "white", "newline", "non_ascii",
    "distinct_words", "distinct_pairs", "top_word", "repeated_neighbours", "distinct_lines", "mean_line", "sentence_ends", "mixed_words", "entropy", "words_per_line", "long_words",
)
_KIND = {
    "upper": [*range(0x41, 0x5B)], "lower": [*range(0x61, 0x7B)], "digit": [*range(0x30, 0x3A)], "exclaim": [0x21], "symbol": [ord(c) for c in "#$%&*+/<=>@\\^_`~"],
    "pipe": [0x7C], "white": [0x20, *range(0x09, 0x0E)], "newline": [0x0A], "non_ascii": [*range(0xC2, 0xF5)], "punctuation": [ord(c) for c in "!\"'(),-.:;?[]{}"],
}
_CLASS = {}
for _name, _bytes in _KIND.items():
    _CLASS[_name] = np.zeros(256, bool)
    _CLASS[_name][_bytes] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values over each text's stretch."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[firsts])


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and how often its commonest one comes."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, o[at], np.diff(np.append(at, len(v))))
    return np.bincount(o[at], minlength=n).astype(float), top


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, over the whole text."""
    data, offsets = utf8(column)
    n = len(column)
    out = {name: np.zeros(n) for name in STATISTICS}
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out["log_bytes"] = np.log1p(np.diff(offsets))
    for name, table in _CLASS.items():
        out[name] = _per_text(table[data], offsets) / size
    small = lowered(data)
    starts, ends, firsts = spans(small, offsets)
    words = np.diff(firsts)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    h = hashes(small, starts, ends)
    length = ends - starts
    out["log_words"] = np.log1p(words)
    out["mean_word"] = _per_text(length, firsts) / some
    out["long_words"] = _per_text(length > 20, firsts) / some
    distinct, top = _distinct(h, owner, n)
    out["distinct_words"], out["top_word"] = distinct / some, top / some
    pairs = rolling(h, 2)
    inside = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    pairs_of = np.bincount(owner[1:][inside], minlength=n) if len(owner) > 1 else np.zeros(n)
    out["distinct_pairs"] = _distinct(pairs[inside], owner[1:][inside], n)[0] / np.maximum(pairs_of, 1) if len(owner) > 1 else np.zeros(n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & inside if len(h) > 1 else False
    out["repeated_neighbours"] = _per_text(same, firsts) / some
    if len(ends):
        last, first = data[ends - 1], data[starts]
        out["sentence_ends"] = _per_text((last == 0x2E) | (last == 0x21) | (last == 0x3F), firsts) / some
        out["mixed_words"] = _per_text(_CLASS["symbol"][last] | _CLASS["symbol"][first] | _CLASS["digit"][first], firsts) / some
    a, b, line_firsts = spans(small, offsets, _NEWLINE)
    lines = np.diff(line_firsts)
    line_owner = np.repeat(np.arange(n), lines)
    out["distinct_lines"] = _distinct(hashes(small, a, b), line_owner, n)[0] / np.maximum(lines, 1)
    out["mean_line"] = np.log1p(_per_text(b - a, line_firsts) / np.maximum(lines, 1))
    out["words_per_line"] = np.log1p(words / np.maximum(lines, 1))
    for i in range(n):  # one histogram for each text
        counts = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=1)
        p = counts[counts > 0] / size[i]
        out["entropy"][i] = -(p * np.log2(p)).sum()
    return np.stack([out[name] for name in STATISTICS], axis=1)


@dataclass
class Forest:
    """Trees end to end in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, least: int = 12, ridge: float = 1.0) -> Forest:
    """Boost `trees` trees of `depth` levels on the logistic loss."""
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        mean = min(max(mean, 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Forest(np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), 0, float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: value <= edges[b]
    n_features = x.shape[1]
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, total = [], 0
    cell = np.arange(n_features)[None, :] * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(total)
        owner = np.full(len(y), total)
        live = [total]
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", total), ("right", total), ("value", 0.0)):
            parts[k].append(v)
        total += 1
        for _ in range(depth):
            nxt = []
            for node in live:
                rows = np.flatnonzero(owner == node)
                if len(rows) < 2 * least:
                    continue
                place = (binned[rows] + cell).reshape(-1)
                g = np.bincount(place, np.repeat(grad[rows], n_features), n_features * bins).reshape(n_features, bins).cumsum(axis=1)
                h = np.bincount(place, np.repeat(hess[rows], n_features), n_features * bins).reshape(n_features, bins).cumsum(axis=1)
                c = np.bincount(place, minlength=n_features * bins).reshape(n_features, bins).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c < least) | (len(rows) - c < least)] = -1
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6:
                    continue
                children = [total, total + 1]
                parts["feature"][node], parts["threshold"][node] = int(f), float(edges[f][b])
                parts["left"][node], parts["right"][node] = children
                for child in children:
                    for k, v in (("feature", 0), ("threshold", 0.0), ("left", child), ("right", child), ("value", 0.0)):
                        parts[k].append(v)
                total += 2
                owner[rows] = np.where(binned[rows, f] <= b, *children)
                nxt += children
            live = nxt
        for node in np.unique(owner).tolist():
            rows = owner == node
            parts["value"][node] = float(-rate * grad[rows].sum() / (hess[rows].sum() + ridge))
        raw += np.array(parts["value"])[owner]
    arrays = {k: np.array(v) for k, v in parts.items()}
    return Forest(**arrays, roots=np.array(roots), depth=depth, base=base)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", *, most_rows: int = 12000) -> Forest:
    """Fit on a sample of about `most_rows` labelled rows outside the held-out fold (crc32 remainder 0 of 5).

    The sample depends on ids and texts alone; only statistics reach the driver. The sampled labels, about `most_rows`
    pairs of an id and a number, are broadcast, so that no text is shuffled to find its label.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    share = min(1.0, most_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = thinned(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id"), F.lit(1.0), most_rows, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                rows = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y double, x array<double>").toArrow()
    found = sorted(zip(got.column("doc_id").to_pylist(), got.column("y").to_pylist(), got.column("x").to_pylist()))
    x = np.array([r[2] for r in found], float).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r[1] for r in found], float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                s = shared.value.scores(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
