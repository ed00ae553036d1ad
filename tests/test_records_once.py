"""Names and clusters read the records once for what is said of names and once for what is said of minutes."""

from pyspark.sql import functions as F

from hustings.config import Config
from hustings.functions import core as f
from hustings.operators import corpus, duplicates, profile, rare, triage, windows
from hustings.sources.adapters import canonical, surge_catalog, test_catalog as catalog_of

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def reads(df) -> int:
    """Scans of the records' source in a plan: part is joined in each."""
    return plan_of(df).count("p_partkey") and sum("event_id" in line and "parquet" in line for line in plan_of(df).split("\n"))


def test_clusters_read_the_records_once_after_their_names(spark):
    c = catalog_of(spark, SF)
    assert reads(c.get(profile.name_forms)) == 1
    assert reads(c.get(duplicates.cluster_members)) == 0  # from the table of names, which is written
    assert reads(c.get(duplicates.cluster_time_concentration_summary)) == 1


def test_names_are_hashed_not_sorted(spark):
    c = catalog_of(spark, SF)
    plan = c.get(profile.name_forms)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_names_of_several_forms_have_the_first_one_by_id(spark):
    c = surge_catalog(spark, SF)
    rows = [(7, "Doe, Jane", "PRO"), (3, "Doe, Jane Ann", "con"), (5, "Doe, Jane", "PRO"), (4, "Roe, Jo", "x")]
    df = spark.createDataFrame(rows, "id long, name string, position string").selectExpr("id", "name", "'' organization", "position", "timestamp_ntz'2024-03-01 10:00:00' + make_dt_interval(0, 0, cast(id as int)) timestamp")
    c.records = canonical(df, Config())
    got = {r.canonical_name: (r.display_name, r.n, r.n_pro, r.n_con, r.first_seen.minute, r.last_seen.minute) for r in c.get(profile.name_frequency).collect()}
    assert got["DOE|JANE"] == ("DOE, JANE ANN", 3, 2, 1, 3, 7)
    assert sum(x[1] for x in got.values()) == 4


def test_blanks_and_marks_leave_the_same_names(spark):
    texts = [None, "", "  ", " a . b ", "a\t.\n b", "x.y", "O'N. - z", ". a", "a .", " a !b ", "é,, ö"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for commas, kept in ((False, r"(?U)[^\w\s\-']"), (True, r"(?U)[^\w\s\-',]")):
        got = df.select(f.clean_name("t", commas).alias("x"), f.squeeze(F.regexp_replace(f.squeeze("t"), kept, "")).alias("y")).collect()
        assert all(r.x == r.y for r in got)


def test_queues_read_written_records(spark):
    c = surge_catalog(spark, SF)
    for build in (triage.measured_statistical, triage.statistical_queue_raw, triage.lenses_side_by_side, triage.window_cluster_overlaps, triage.cluster_evidence_queue, triage.triage_summary, corpus.report_vector):
        assert "p_partkey" not in plan_of(c.get(build)), build.__name__
    assert sum("id#" in line and "parquet" in line and "position_normalized" in line for line in plan_of(c.get(windows.burst_window_tests)).split("\n")) == 0  # from the written minute grid


def test_means_of_names_are_means_of_records(spark):
    c = catalog_of(spark, SF)
    scores = ("weirdness_score", "name_length", "non_alpha_fraction", "name_entropy")
    want = {r.canonical_name: r for r in c.get(profile.name_text_features).groupBy("canonical_name").agg(*(F.avg(x).alias(x) for x in scores)).collect()}
    got = c.get(rare.weird_names).collect()
    assert got and all(abs(r[x] - want[r.canonical_name][x]) < 1e-12 for r in got for x in scores)


def test_percentiles_of_counted_scores(spark):
    c = surge_catalog(spark, SF)
    rows = c.get(rare.record_rarity).select("minute_bucket", "rarity_score")
    plain = f.with_buckets(rows, "minute_bucket", (60,)).groupBy("bucket_start").agg(F.avg("rarity_score").alias("m"), F.percentile("rarity_score", F.lit(0.9)).alias("p"), F.count("*").alias("n"))
    want = {r.bucket_start: r for r in plain.collect()}
    got = c.get(rare.rarity_by_bucket).where("bucket_minutes = 60").collect()
    assert len(got) == len(want)
    assert all((r.n_total, r.rarity_p90) == (want[r.bucket_start].n, want[r.bucket_start].p) and abs(r.rarity_mean - want[r.bucket_start].m) < 1e-12 for r in got)


def test_limits_of_windows_do_not_count_the_records_again(spark):
    c = catalog_of(spark, SF)
    for build in (rare.unique_ratio_windows, rare.rarity_high_windows):
        assert "p_partkey" not in plan_of(c.get(build)), build.__name__
