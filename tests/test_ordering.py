"""P values of rank correlations against the definition."""

import itertools
import math
import random

import pytest

from hustings.operators import ordering


def test_inversion_shares_count_orders():
    shares = {(n, c): x for n, c, x in ordering.inversion_shares(7)}
    for n in range(2, 8):
        counts = [0] * (n * (n - 1) // 2 + 1)
        for p in itertools.permutations(range(n)):
            counts[sum(a > b for a, b in itertools.combinations(p, 2))] += 1
        for c in range(len(counts)):
            assert shares[n, c] == pytest.approx(sum(counts[: c + 1]) / math.factorial(n))


def test_p_values_exact_tied_and_large(spark):
    rng = random.Random(2)
    rows, want = [], []
    for k, n in enumerate([3, 4, 6, 10, 33, 34, 60, 5, 9, 50, 4, 40, 200]):
        x = [rng.random() for _ in range(n)] if k < 7 else [rng.randint(0, 3) for _ in range(n)]
        if k in (10, 11):
            x = [1] * n if k == 10 else list(range(n))
        s = sum((b > a) - (b < a) for a, b in itertools.combinations(x, 2))
        sizes = [x.count(v) for v in set(x)]
        ties, tied = sum(c * (c - 1) // 2 for c in sizes), sum(c * (c - 1) * (2 * c + 5) for c in sizes)
        rows.append((k, n, s, float(ties), float(tied)))
        pairs = n * (n - 1) // 2
        few = min(pairs - s, pairs + s) // 2
        if ties == pairs:
            p = 1.0
        elif ties == 0 and n <= 33:
            table = [1]
            for m in range(2, n + 1):
                wide = [0] * (m - 1) + table + [0] * (m - 1)
                table = [sum(wide[c : c + m]) for c in range(len(table) + m - 1)]
            p = min(1.0, 2 * sum(table[: few + 1]) / math.factorial(n))  # in whole numbers
        elif ties == 0 and few <= 1:
            p = 0.0
        else:
            p = math.erfc(abs(s) / math.sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18) / math.sqrt(2))
        want.append(p)
    got = ordering.with_kendall_p(spark.createDataFrame(rows, "k long, n long, s long, ties double, tied double"), "n", "s", "ties", "tied").orderBy("k").collect()
    assert [r.kendall_p_value for r in got] == pytest.approx(want, abs=1e-9)
    assert len(got) == len(rows)
