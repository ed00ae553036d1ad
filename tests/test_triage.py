"""Evidence queues, overlap joins and running totals against plain versions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from hustings.functions.core import tidy
from hustings.operators import triage
from hustings.oracles_triage import ORACLES
from hustings.plans.overlap import overlapping
from hustings.plans.running import running_totals
from hustings.queries import SURGES
from hustings.sources.adapters import surge_catalog
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"
T0 = datetime(2024, 3, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(3)

    def spans(n, longest):
        out = []
        for k in range(n):
            a = T0 + timedelta(seconds=rng.randrange(0, 5 * 86_400))
            out.append((k, a, a + timedelta(seconds=rng.choice([0, 1, rng.randrange(longest), 14_400]))))
        return out

    left, right = spans(150, 9_000), spans(120, 3 * 86_400)
    edges = [(1000, T0, T0 + timedelta(hours=4)), (1001, T0 + timedelta(hours=4), T0 + timedelta(hours=4)), (1002, None, T0), (1003, T0, None), (1004, T0 + timedelta(hours=1), T0)]
    left, right = left + edges, right + edges
    a = spark.createDataFrame(left, "i long, a timestamp_ntz, b timestamp_ntz")
    b = spark.createDataFrame(right, "j long, c timestamp_ntz, d timestamp_ntz")
    want = {(i, j) for i, s, e in left for j, u, v in right if None not in (s, e, u, v) and s <= e and u <= v and s <= v and u <= e}
    for minutes in (1_440, 240, 60):
        met = overlapping(a, b, ("a", "b"), ("c", "d"), minutes)
        rows = [(r.i, r.j) for r in met.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert "NestedLoop" not in plan_of(met) and "Cartesian" not in plan_of(met)
    assert overlapping(a.limit(0), b, ("a", "b"), ("c", "d")).count() == 0


def test_running_totals_cross_days(spark):
    rows = [(T0 + timedelta(minutes=97 * k), k % 7 if k % 5 else None) for k in range(100)] + [(T0, 3)]
    got = {(r.t, r.n) for r in running_totals(spark.createDataFrame(rows, "t timestamp_ntz, n long"), "t", ["n"]).collect()}
    assert got == {(t, sum(n or 0 for u, n in rows if u <= t)) for t, _ in rows}


KIND = {"stat_fdr": 1.0, "heuristic": 0.6}


def plain_verdict(signals, support):
    """signals: (id, detector, kind, score, support, effect, tested, low, hint)."""
    out = {"support_n": max([support, *(s[4] for s in signals)]), "is_low_power": any(s[7] for s in signals)}
    out["score"] = sum(KIND[s[2]] * s[3] for s in signals) / sum(KIND[s[2]] for s in signals)
    votes = Counter(s[8] for s in signals).most_common()
    if len(votes) == 1:
        out["explanations"] = (votes[0][0], "none")
    else:
        mixed = votes[0][1] == votes[1][1] or votes[0][1] / len(signals) < 0.6
        out["explanations"] = ("mixed" if mixed else votes[0][0], votes[1][0])
    calibrated = any(s[2] == "stat_fdr" for s in signals)
    tier = "high" if out["score"] >= 0.8 and out["support_n"] >= 25 and calibrated else "medium" if out["score"] >= 0.6 and out["support_n"] >= 25 else "watch"
    out["tier"] = "medium" if tier == "high" and out["is_low_power"] else tier
    flags = set()
    flags |= {"low_support_n"} if any(s[4] < 25 for s in signals) else set()
    flags |= {"low_power"} if out["is_low_power"] else set()
    flags |= {"heuristic_only"} if not calibrated else set()
    flags |= {"missing_effect_size"} if any(s[2] == "stat_fdr" and not s[5] for s in signals) else set()
    flags |= {"missing_significance"} if any(s[2] == "stat_fdr" and not s[6] for s in signals) else set()
    out["flags"] = ",".join(sorted(flags))
    total = sum(KIND[s[2]] * s[3] for s in signals)
    parts = {s[0]: (KIND[s[2]] * s[3] / total if total else 1 / len(signals)) for s in signals}
    by = Counter()
    for s in signals:
        by[s[1]] += parts[s[0]]
    out["driver"] = min(by, key=lambda d: (-round(by[d], 9), d))
    return out


def test_verdicts_equal_the_plain_version(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = []
    for k in range(400):
        n = rng.randint(1, 6)
        hints = rng.choices(["potential_manipulation", "data_quality_artifact", "mixed"], k=n)
        signals = [(f"s{i}", rng.choice(["d1", "d2", f"e{i}"]), rng.choice(["stat_fdr", "heuristic"]), rng.choice([0.0, 1.0, rng.random()]), rng.randint(0, 60), rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.3, hints[i]) for i in range(n)]
        rows.append((k, rng.randint(0, 60), signals))
    frame = spark.createDataFrame(rows, "k long, known long, s array<struct<a:string,b:string,c:string,d:double,e:long,f:boolean,g:boolean,h:boolean,i:string>>")

    def made(i):
        s = F.get("s", F.lit(i))
        weight = F.when(s["c"] == "stat_fdr", 1.0).otherwise(0.6)
        fields = zip(("signal_id", "detector", "kind", "weight", "score", "support", "has_effect", "is_tested", "low", "hint"), (s["a"], s["b"], s["c"], weight, s["d"], s["e"], s["f"], s["g"], s["h"], s["i"]))
        return F.when(s.isNotNull(), F.struct(*(v.alias(n) for n, v in fields)))

    got = {r.k: r for r in triage.judged(frame, [made(i) for i in range(6)], F.col("known")).collect()}
    assert len(got) == len(rows)
    for k, known, signals in rows:
        want, r = plain_verdict(signals, known), got[k]
        assert r.score == pytest.approx(want["score"]) and (r.support_n, r.is_low_power, r.caveat_flags) == (want["support_n"], want["is_low_power"], want["flags"])
        assert (r.primary_explanation, r.secondary_explanation) == want["explanations"]
        assert (r.evidence_tier, r.score_primary_driver) == (want["tier"], want["driver"])


@pytest.fixture(scope="module")
def catalog(spark):
    return surge_catalog(spark, SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, catalog, name):
    df = tidy(catalog.get(SURGES[name])).cache()
    assert differences(df, connect(SF), ORACLES[name]) == ""
    assert df.count() > 0


def test_queue_of_all_detectors(catalog):
    rows = catalog.get(triage.window_evidence_queue).collect()
    detectors = {d for r in rows for d in r.source_detectors.split(",")}
    assert {"bursts", "procon_swings", "duplicates_near", "rare_names"} <= detectors
    order = [({"high": 0, "medium": 1, "watch": 2}[r.evidence_tier], -round(r.score, 9)) for r in rows]
    assert order == sorted(order) and len(rows) == 250


def test_no_nested_loops_but_for_one_row(catalog):
    assert "NestedLoop" not in plan_of(catalog.get(triage.window_cluster_overlaps))
    plan = plan_of(triage.measured(catalog, catalog.stored(triage.statistical_candidates)))
    assert plan.count("BroadcastNestedLoopJoin") <= 4  # the facts: aggregates of one row each
    assert "Cartesian" not in plan
