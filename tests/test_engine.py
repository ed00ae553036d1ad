"""The engine's own operators: every SQL-expressible query beside DuckDB, and small hand-checked inputs."""

import datetime as dt
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hustings import queries
from hustings.config import Config
from hustings.functions import core as f
from hustings.functions import kernels
from hustings.operators import duplicates, fusion, off_hours, ordering, organisations, periodicity, profile, registry_match, windows
from hustings.plans.catalog import Catalog
from hustings.plans.graph import connected_components
from hustings.sources import adapters
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2026, 2, 3)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert differences(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name]) == ""


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def catalog(spark, rows, **settings):
    """rows: (name, position, minute of the day, organization)."""
    config = Config(**settings)
    data = [(i, n, o, p, DAY + dt.timedelta(minutes=m)) for i, (n, p, m, o) in enumerate(rows)]
    frame = spark.createDataFrame(data, "id long, name string, organization string, position string, timestamp timestamp_ntz")
    return Catalog(spark, adapters.canonical(frame, config), config)


def test_names_and_stances(spark):
    rows = spark.createDataFrame([("Doe, Jane", "pro"), ("Jane  Q. Doe", " CON "), ("Cher", None), ("", "maybe"), (None, ""), ("O'Neil-Smith, Zoë!", "PRO")], "name string, position string")
    frame = rows.selectExpr("1 as id", "name", "'' as organization", "position", "timestamp_ntz'2026-02-03 06:15:00' as timestamp")
    got = adapters.canonical(frame, Config(nicknames={"JANE": "JANET"})).collect()
    assert [r.canonical_name for r in got] == ["DOE|JANET", "DOE|JANET", "CHER|", "|", "|", "O'NEIL-SMITH|ZOË"]
    assert [r.position_normalized for r in got] == ["Pro", "Con", "Unknown", "Unknown", "Unknown", "Pro"]
    assert got[0].name_display == "DOE, JANE" and got[0].first_initial == "J" and not got[0].is_off_hours


def test_local_time_changes(spark):
    times = ["2026-03-08 02:30:00", "2026-03-08 03:10:00", "2026-11-01 01:30:00", "2026-11-01 02:30:00", "2026-07-01 12:00:00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").orderBy("i")
    got = [r[0] for r in rows.select(f.localise(rows.t.cast("timestamp_ntz"), "America/Los_Angeles")).collect()]
    assert [str(g) if g else None for g in got] == ["2026-03-08 03:00:00", "2026-03-08 03:10:00", None, "2026-11-01 02:30:00", "2026-07-01 12:00:00"]


def test_wilson_and_low_power(spark):
    rows = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k long, n long")
    low, high = f.wilson("k", "n")
    got = rows.select(low, high).collect()
    assert got[0][0] is None and got[1][0] == pytest.approx(0.2365930905, abs=1e-5) and got[1][1] == pytest.approx(0.7634069095, abs=1e-5) and got[2][0] <= got[2][1] <= 1
    totals = spark.createDataFrame([(0.0,), (10.0,), (30.0,), (None,), (45.0,)], "n double")
    assert [r[0] for r in totals.select(f.low_power("n", 30)).collect()] == [True, True, False, True, False]


def test_q_values_equal_numpy(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.04, 1.0, None]
    got = {r.i: r.q for r in f.with_q(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q").collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    for r, (_, i) in enumerate(known):
        assert got[i] == pytest.approx(min(1.0, min(x * len(known) / (k + 1) for k, (x, _) in enumerate(known) if k >= r)))
    assert got[7] is None


def test_kernels():
    assert kernels.poisson_at_least(10, 3.0) == pytest.approx(1 - sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(10)))
    assert kernels.poisson_at_least(0, 3.0) == 1 and kernels.poisson_at_least(5, 0.0) == 0
    assert kernels.binomial_tails(3, 10, 0.5) == pytest.approx((0.171875, 0.9453125, 0.34375))
    assert kernels.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert kernels.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05)
    assert kernels.indel_ratio("JANE", "JANET") == pytest.approx(800 / 9) and kernels.lcs_length("ABCBDAB", "BDCABA") == 4
    assert kernels.set_ratio("DOE, JANE", "DOE, JANE ANN") == 100.0 and kernels.set_ratio("", "X") == 0
    x = np.concatenate([np.full(100, 5.0), np.full(100, 20.0)])
    assert kernels.pelt(x, 50.0, 30) == [100]
    rng = np.random.default_rng(0)
    assert kernels.isolation_scores(np.concatenate([rng.normal(size=(60, 3)), [[9, 9, 9]]])).argmax() == 60
    d = np.stack([np.ones(200), rng.normal(size=200)], axis=1)
    y = 1 / (1 + np.exp(-(d @ [0.3, -0.8])))
    beta, plain = kernels.fit_logit(d, y, np.full(200, 40.0))
    assert plain and beta == pytest.approx([0.3, -0.8], abs=1e-6)


def test_minute_grid_is_dense_and_deduplicated(spark):
    c = catalog(spark, [("Doe, Jane", "Pro", 60, ""), ("Doe, Jane", "Con", 60, ""), ("Roe, Al", "Pro", 63, "")])
    rows = sorted(c.get(profile.counts_per_minute).collect(), key=lambda r: r.minute_bucket)
    assert [r.n_total for r in rows] == [2, 0, 0, 1] and rows[0].n_total_dedup == 1 and rows[0].n_pro_dedup == 1 and rows[0].dup_name_fraction == 0.5 and rows[1].pro_rate is None
    empty = catalog(spark, [])
    assert empty.get(profile.counts_per_minute).count() == 0 and empty.get(windows.burst_window_tests).count() == 0


def test_exact_duplicates(spark):
    c = catalog(spark, [("Doe, Jane", "Pro", m, "") for m in (1, 1, 3, 16)] + [("Roe, Al", "Con", 2, ""), ("Poe, Bo", "Pro", 2, ""), ("Poe, Bo", "Con", 200, "")])
    found = c.get(duplicates.repeated_same_bucket).collect()
    assert {r.bucket_minutes for r in found if r.canonical_name == "DOE|JANE"} >= {1, 5, 15}
    assert [r.canonical_name for r in c.get(duplicates.position_switching_names).collect()] == ["POE|BO"]


def test_near_duplicates_and_the_cap(spark):
    people = [("Doe, Jane", "Pro", 1, ""), ("Doe, Janee", "Pro", 1, ""), ("Doe, Janet", "Con", 2, ""), ("Smith, Alan", "Pro", 3, "")]
    c = catalog(spark, people, similarity=88)
    clusters = c.get(duplicates.cluster_summary).collect()
    assert len(clusters) == 1 and clusters[0].cluster_size == 3 and clusters[0].n_records == 3
    capped = catalog(spark, people, block_cap=2)  # the block is reported as large, and compared like any other
    assert capped.get(duplicates.skipped_blocks).count() == 1
    assert {(r.left_name, r.right_name) for r in capped.get(duplicates.similarity_edges).collect()} == {("DOE|JANE", "DOE|JANEE"), ("DOE|JANE", "DOE|JANET")}


def test_components(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "a string, b string")
    assert {r.node: r.label for r in connected_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def busy(spark, count, **settings):
    rows = []
    for m in range(len(count)):
        rows += [(f"N{k}, M{m}", "Pro" if k < count[m][1] else "Con", m, "") for k in range(count[m][0])]
    return catalog(spark, rows, **settings)


def test_bursts_swings_and_levels(spark):
    c = busy(spark, [(25, 12) if 90 <= m < 95 else (1, m % 2) for m in range(180)])
    assert any(r.window_minutes == 5 for r in c.get(windows.burst_significant_windows).collect())
    c = busy(spark, [(20, 20 if 120 <= m < 140 else 10) for m in range(180)])
    assert any(r.window_minutes == 15 for r in c.get(windows.swing_significant_windows).collect())
    c = busy(spark, [(5 if m < 100 else 20, 2) for m in range(200)])
    cuts = [(r.change_minute - DAY).seconds // 60 for r in c.get(fusion.volume_changepoints).collect()]
    assert any(abs(x - 100) <= 5 for x in cuts)


def test_clockwork_period(spark):
    c = busy(spark, [(9 if m % 10 == 0 else 1, 0) for m in range(300)])
    top = c.get(periodicity.spectrum_top).orderBy("power", ascending=False).first()
    assert top.period_minutes == pytest.approx(10.0, rel=0.02) or 10 % round(top.period_minutes) == 0
    assert c.get(periodicity.clockface_distribution).count() == 60
    assert c.get(periodicity.autocorr).orderBy("autocorr", ascending=False).first().lag_minutes % 10 == 0


def test_rolling_fano_equals_sql_at_ties(spark, tmp_path):
    """5,000 minutes, of which some windows lie halfway between two values of six digits."""
    counts = np.random.default_rng(23).poisson(3.2, 5000)
    counts[[0, -1]] = 3
    minutes = np.repeat(np.arange(5000), counts)
    con = duckdb.connect()
    con.register("minutes", pd.DataFrame({"id": np.arange(len(minutes)), "m": minutes}))
    con.execute(f"COPY (SELECT id AS event_id, TIMESTAMP '2026-02-03' + to_minutes(m) AS ts, id % 50 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM minutes) TO '{tmp_path}/events.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/part.parquet' WHERE p_partkey < 50) TO '{tmp_path}/part.parquet'")
    for name in ("pe9_rolling_fano", "pe10_rolling_fano_summary"):
        assert differences(queries.QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), queries.ORACLE_SQL[name]) == ""


def test_rolling_fano_of_high_counts(spark):
    """Counts that vary by one around 1e9, and a window longer than a stretch of minutes."""
    x = 1e9 + np.random.default_rng(7).integers(0, 2, 9000)
    c = Catalog(spark, None, Config(fano_windows=(3, 50, 5000)))
    frame = spark.createDataFrame(pd.DataFrame({"i": np.arange(9000), "x": x}))
    c._built["hustings.operators.periodicity.series"] = frame.select("i", f.plus_minutes(F.lit(DAY).cast("timestamp_ntz"), F.col("i")).alias("minute_bucket"), "x")
    df = c.get(periodicity.rolling_fano)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().executedPlan().toString()
    rows = df.collect()
    assert len({(r.window_minutes, r.end_minute) for r in rows}) == len(rows) == 3 * 9001 - 5053
    for w in c.config.fano_windows:
        got = sorted((r.start_minute, r.end_minute, r.variance_count) for r in rows if r.window_minutes == w)
        assert all(b - a == dt.timedelta(minutes=w - 1) for a, b, _ in got)
        assert np.allclose([v for *_, v in got], np.lib.stride_tricks.sliding_window_view(x - 1e9, w).var(axis=1), atol=1e-6)


def test_off_hours_day_baseline(spark):
    rows = [(f"A{i}, B", "Con", 65, "") for i in range(4)] + [(f"C{i}, D", "Pro" if i < 2 else "Con", 600, "") for i in range(4)]
    c = catalog(spark, rows, window_min_total=1)
    w = [r for r in c.get(off_hours.window_limits).collect() if r.bucket_minutes == 60 and r.hour == 1][0]
    assert w.expected_pro_rate_day == 0.5 and w.is_below_95_day and not w.is_below_998_day and w.is_material_lower_day
    full = c.get(off_hours.window_control_profile).where("bucket_minutes = 60 and hour = 1").first()
    assert full.p_lower_day == pytest.approx(0.0625)


def test_blank_organisations(spark):
    c = catalog(spark, [("A, B", "Pro", m, o) for m, o in enumerate(["", "A", "", "B", "", ""])])
    got = {r.bucket_minutes: r.blank_org_rate for r in c.get(organisations.blank_rate_by_bucket).where("hour(bucket_start) = 0 and minute(bucket_start) = 0").collect()}
    assert set(got) == set(c.config.buckets) and got[240] == pytest.approx(4 / 6)


def test_registry_tiers(spark):
    c = catalog(spark, [("Doe, Jane", "Pro", 1, ""), ("Smith, Jonn", "Con", 2, ""), ("Lee, Alexander", "Pro", 3, ""), ("Poe, Zed", "Pro", 4, "")], strong_score=85, weak_score=60)
    c.registry = spark.createDataFrame([("DOE", "JANE", "DOE|JANE"), ("SMITH", "JON", "SMITH|JON"), ("LEE", "ALEX", "LEE|ALEX"), ("ROE", "AL", "ROE|AL")], "last string, first string, canonical_name string")
    tiers = {r.canonical_name: (r.match_tier, r.caveat) for r in c.get(registry_match.assignments).collect()}
    assert tiers["DOE|JANE"][0] == "exact" and tiers["SMITH|JONN"][0] == "strong_fuzzy" and tiers["LEE|ALEXANDER"][0] == "weak_fuzzy" and tiers["POE|ZED"] == ("unmatched", "no_last_name_candidates")


def test_planted_bucket_is_the_strangest(spark):
    c = busy(spark, [(60 if 150 <= m < 165 else 4, 2) for m in range(240)])
    top = c.get(fusion.top_bucket_anomalies).where("bucket_minutes = 15").orderBy("anomaly_score", ascending=False).first()
    assert top.n_total == 900


def test_ordering_equals_all_pairs(spark):
    """Every bucket of every size, one with most rows in a single minute, against each pair of its rows."""
    rng = np.random.default_rng(4)
    minutes = [*rng.integers(0, 700, 150), *[301] * 120]
    rows = [(f"N{rng.integers(9)}, M", "Pro", int(m), "") for m in minutes] + [(f"A{k:02}, B", "Con", 900 + k, "") for k in range(20)]
    c = catalog(spark, rows)
    arrived = sorted((r.timestamp, r.id, r.name_display) for r in c.records.collect())
    want = {}
    for size in c.config.buckets:
        groups = {}
        for t, _, name in arrived:
            at = t.replace(hour=0, minute=0, second=0, microsecond=0) + dt.timedelta(minutes=(t.hour * 60 + t.minute) // size * size)
            groups.setdefault(at, []).append(name)
        for at, names in groups.items():
            n = len(names)
            if n < 3:
                continue
            pairs = [(x < y) - (x > y) for x, y in itertools.combinations(names, 2)]
            ties = sum(x == y for x, y in itertools.combinations(names, 2))
            tau = sum(pairs) / math.sqrt(len(pairs) * (len(pairs) - ties)) if len(pairs) > ties else 0.0
            want[size, at] = (n, names == sorted(names), round(tau, 9))
    got = c.get(ordering.bucket_ordering).collect()
    assert {(r.bucket_minutes, r.bucket_start): (r.n_records, r.is_alphabetical, round(r.kendall_tau, 9)) for r in got} == want
    assert any(r.is_alphabetical and r.kendall_tau == 1 for r in got)


def test_fallback_of_changepoints():
    x = np.concatenate([np.full(200, 3.0), np.full(200, 9.0)])
    found = fusion.fallback(x, 30)
    assert len(found) >= 1 and min(abs(k - 200) for k in found) < 30 and fusion.fallback(np.full(400, 2.0), 30) == [] and fusion.fallback(x[:50], 30) == []
    scores = np.zeros(len(x))  # position by position, zero near the ends
    for k in range(30, len(x) - 30):
        scores[k] = abs(x[k : k + 30].mean() - x[k - 30 : k].mean())
    over = np.flatnonzero(scores >= scores.mean() + 2.5 * scores.std())
    assert found[0] == over[0] and all(b - a >= 30 for a, b in zip(found, found[1:]))
