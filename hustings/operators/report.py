"""Report tables: quality panels, deadlines, lenses by minute, baselines over reports and chart summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.operators.duplicates import cluster_summary
from hustings.operators.fusion import all_changepoints, evidence_bundle_windows, ranked_windows
from hustings.operators.organisations import blank_rate_by_bucket
from hustings.operators.profile import basic_quality, counts_per_minute, minute_totals
from hustings.operators.windows import burst_window_tests, burst_windows
from hustings.plans.catalog import Catalog

#: Bins of minutes to the cutoff: key, label, above, up to.
DEADLINES = (
    ("after_cutoff", "After cutoff", None, 0.0),
    ("0_30m_before_cutoff", "0-30m before cutoff", 0.0, 30.0),
    ("30_120m_before_cutoff", "30-120m before cutoff", 30.0, 120.0),
    ("2h_24h_before_cutoff", "2h-24h before cutoff", 120.0, 1440.0),
    ("over_24h_before_cutoff", ">24h before cutoff", 1440.0, None),
)

# quality -----------------------------------------------------------------------------------------


def raw_vs_dedup_metrics(c: Catalog) -> DataFrame:
    """Totals and rates of the raw and the deduplicated lens, their deltas, and which of them matter."""
    m = c.get(minute_totals)
    one = m.agg(*(F.sum(x).cast("double").alias(x) for x in ("n_total", "n_pro", "n_con", "n_unique_names", "n_total_dedup", "n_pro_dedup", "n_con_dedup")))
    rows = [
        ("total_submissions", "count", F.col("n_total"), F.col("n_total_dedup")),
        ("pro_rate", "rate", f.ratio("n_pro", "n_total"), f.ratio("n_pro_dedup", "n_total_dedup")),
        ("con_rate", "rate", f.ratio("n_con", "n_total"), f.ratio("n_con_dedup", "n_total_dedup")),
        ("duplicate_name_fraction", "rate", 1.0 - f.ratio("n_unique_names", "n_total"), F.when(F.col("n_total_dedup") > 0, 0.0)),
    ]
    long = one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("metric"), F.lit(k).alias("kind"), x.alias("raw_value"), y.alias("exact_row_dedup_value")) for a, k, x, y in rows))).alias("r")).select("r.*")
    long = long.withColumn("absolute_delta", F.col("exact_row_dedup_value") - F.col("raw_value"))
    long = long.withColumn("relative_delta", F.when(F.col("raw_value") != 0, F.col("absolute_delta") / F.col("raw_value")))
    d, r = F.abs("absolute_delta"), F.abs(F.coalesce("relative_delta", F.lit(0.0)))
    matters = F.when(F.col("kind") == "count", (d >= 5) & (r >= 0.10)).when(F.col("kind") == "rate", d >= 0.03).otherwise(d >= 0.05)
    return long.withColumn("material_change", F.coalesce(matters, F.lit(False))).drop("kind")


def data_quality_warnings(c: Catalog) -> DataFrame:
    """Warnings of the quality panel with what was seen and the limit it passed."""
    q = c.get(basic_quality).groupBy().pivot("metric", ["rows_total", "missing_name", "unknown_position", "duplicate_ids", "non_monotonic_timestamp_vs_id"]).agg(F.first("value"))
    spikes = c.get(blank_rate_by_bucket).where(F.col("n_total") >= c.config.min_cell)
    middle = spikes.groupBy("bucket_minutes").agg(F.percentile("blank_org_rate", F.lit(0.5)).alias("middle"))
    n_spikes = spikes.join(middle, "bucket_minutes").agg(f.count_where(F.col("blank_org_rate") >= F.greatest(F.lit(0.35), F.col("middle") + 0.15)).alias("n_blank_spikes"))
    one = q.join(F.broadcast(n_spikes))  # one row each
    share = lambda x: F.coalesce(f.ratio(x, "rows_total"), F.lit(0.0))
    checks = [
        ("unknown_positions", share("unknown_position"), 0.10),
        ("missing_names", share("missing_name"), 0.05),
        ("duplicate_ids", share("duplicate_ids"), 0.01),
        ("non_monotonic_timestamps", F.col("non_monotonic_timestamp_vs_id").cast("double"), 1.0),
        ("blank_organization_spikes", F.col("n_blank_spikes").cast("double"), 1.0),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("warning"), x.alias("observed"), F.lit(limit).alias("threshold")) for n, x, limit in checks))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("is_raised", F.col("observed") >= F.col("threshold"))


# deadlines ---------------------------------------------------------------------------------------


def cutoff(c: Catalog) -> Column:
    return F.lit(c.config.cutoff).cast("timestamp_ntz")


def stance_by_deadline(c: Catalog) -> DataFrame:
    """Counts in five fixed bins before the cutoff; bins without rows stay."""
    m = F.col("m")
    rows = c.get(minute_totals).withColumn("m", f.minutes_between(cutoff(c), "minute_bucket"))
    case = F.lit(None).cast("string")
    for key, _, above, upto in reversed(DEADLINES):
        inside = (m <= upto) if above is None else (m > above) if upto is None else (m > above) & (m <= upto)
        case = F.when(inside, key).otherwise(case)
    sums = rows.groupBy(case.alias("deadline_window_key")).agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con")))
    spine = c.spark.createDataFrame([(k, label) for k, label, _, _ in DEADLINES], "deadline_window_key string, deadline_window string")
    df = spine.join(F.broadcast(sums), "deadline_window_key", "left").na.fill(0, ["n_total", "n_pro", "n_con"])  # five rows
    df = df.withColumns({"pro_rate": f.ratio("n_pro", "n_total"), "con_rate": f.ratio("n_con", "n_total"), "is_low_power": f.low_power("n_total", c.config.min_cell)})
    low, high = f.wilson("n_pro", "n_total")
    return df.withColumns({"pro_rate_wilson_low": low, "pro_rate_wilson_high": high})


def deadline_ramp_metrics(c: Catalog) -> DataFrame:
    """The last hour before the cutoff against the hour before, in one row."""
    back = f.minutes_between(cutoff(c), "minute_bucket")
    rows = c.get(minute_totals)
    sums = []
    for tag, inside in (("recent", (back >= 0) & (back < 60)), ("prior", (back >= 60) & (back < 120))):
        sums += [F.coalesce(F.sum(F.when(inside, F.col(x))), F.lit(0)).alias(f"{tag}_{x}") for x in ("n_total", "n_pro", "n_con")]
    df = rows.agg(*sums)
    for tag in ("recent", "prior"):
        df = df.withColumns({f"{tag}_pro_rate": f.ratio(f"{tag}_n_pro", f"{tag}_n_total"), f"{tag}_con_rate": f.ratio(f"{tag}_n_con", f"{tag}_n_total"), f"{tag}_is_low_power": f.low_power(f"{tag}_n_total", c.config.min_cell)})
    df = df.withColumns({"ramp_ratio_recent_vs_prior": f.ratio("recent_n_total", "prior_n_total"), "pro_rate_delta_recent_minus_prior": F.col("recent_pro_rate") - F.col("prior_pro_rate")})
    return df.drop("recent_n_pro", "recent_n_con", "prior_n_pro", "prior_n_con")


# lenses and markers ------------------------------------------------------------------------------


def lens_comparison(c: Catalog) -> DataFrame:
    """Every minute's raw and deduplicated counts and rates side by side, with their deltas."""
    m = c.get(minute_totals)
    df = m.select("minute_bucket", "n_total", "n_total_dedup", f.ratio("n_pro", "n_total").alias("pro_rate_raw"), f.ratio("n_pro_dedup", "n_total_dedup").alias("pro_rate_dedup"))
    return df.withColumns({"delta_n_total": F.col("n_total_dedup") - F.col("n_total"), "delta_pro_rate": F.col("pro_rate_dedup") - F.col("pro_rate_raw")})


#: Times that a hearing's side-car may give.
MARKERS = {"sign_in_open": "sign_in_open", "sign_in_cutoff": "cutoff", "meeting_start": "meeting_start", "written_testimony_deadline": "written_testimony_deadline"}


def hearing_markers(c: Catalog) -> DataFrame:
    """Process times of the side-car that are given, with the volume up to each: one pass over the minutes, a row for each marker."""
    given = {name: getattr(c.config, key) for name, key in MARKERS.items() if getattr(c.config, key)}
    at = {name: F.lit(t).cast("timestamp_ntz") for name, t in given.items()}
    sums = c.get(minute_totals).agg(*(F.coalesce(F.sum(F.when(F.col("minute_bucket") <= t, F.col("n_total"))), F.lit(0)).alias(name) for name, t in at.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("marker"), t.alias("marker_time"), F.col(name).alias("n_before")) for name, t in at.items()))
    return sums.select(F.explode(rows).alias("r")).select("r.*").orderBy("marker_time", "marker")


def hearing_minutes(c: Catalog) -> DataFrame:
    """Minutes of each record to the cutoff and since sign-in opened and the meeting began."""
    return c.records.select("id", *(x for x in ("minutes_to_cutoff", "minutes_since_sign_in_open", "minutes_since_meeting_start") if x in c.records.columns))


# baselines over reports --------------------------------------------------------------------------


def day_vectors(c: Catalog) -> DataFrame:
    """A feature vector for each day, in long form: what a corpus of reports holds, with days as reports."""
    names = c.records.groupBy("date", "canonical_name").agg(F.count(F.lit(1)).alias("n"), *f.stance_counts()[:2], f.count_where(F.col("is_off_hours")).alias("off"))
    v = names.groupBy("date").agg(F.sum("n").cast("double").alias("n_records"), f.ratio(F.sum("n_pro"), F.sum("n")).alias("pro_rate"), f.ratio(F.sum("off"), F.sum("n")).alias("off_hours_ratio"), (1.0 - F.count(F.lit(1)) / F.sum("n")).alias("dup_name_fraction"), F.max("n").cast("double").alias("max_name_records"))
    metrics = ["n_records", "pro_rate", "off_hours_ratio", "dup_name_fraction", "max_name_records"]
    return v.withColumn("report_id", F.date_format("date", "yyyy-MM-dd")).unpivot(["report_id"], metrics, "metric", "value")


def global_baselines(c: Catalog) -> DataFrame:
    """Mid-rank percentile of each report within each metric, and the metric's deciles."""
    v = c.get(day_vectors).where("value is not null")
    every, ties = Window.partitionBy("metric"), Window.partitionBy("metric", "value")
    n = F.count(F.lit(1)).over(every)
    less = F.rank().over(every.orderBy("value")) - 1
    v = v.withColumn("percentile", (less + F.count(F.lit(1)).over(ties) * 0.5) / n)
    q = v.groupBy("metric").agg(*(F.percentile("value", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)), F.count(F.lit(1)).alias("n_reports"))
    return v.join(q, "metric")


def name_cues(c: Catalog) -> DataFrame:
    """Names that repeat within a report: in how many reports, and how often at most."""
    per_day = c.records.groupBy("date", "canonical_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_day.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n_reports"), F.max("n").alias("max_n"))


# charts ------------------------------------------------------------------------------------------


def burst_significance_by_window(c: Catalog) -> DataFrame:
    return c.get(burst_window_tests).groupBy("window_minutes").agg(F.count(F.lit(1)).alias("n_windows"), f.count_where(F.col("is_significant")).alias("n_significant"), F.percentile("rate_ratio", F.lit(0.5)).alias("median_rate_ratio"))


def burst_ratio_by_window(c: Catalog) -> DataFrame:
    return c.get(burst_windows).groupBy("window_minutes").agg(F.count(F.lit(1)).alias("n_windows"), F.percentile("rate_ratio", F.lit(0.5)).alias("median_rate_ratio"), F.max("rate_ratio").alias("max_rate_ratio"))


def changepoints_by_hour(c: Catalog) -> DataFrame:
    return c.get(all_changepoints).groupBy("metric", F.hour("change_minute").alias("hour")).agg(F.count(F.lit(1)).alias("n_changepoints"), F.avg("abs_delta").alias("mean_abs_delta"))


def cluster_size_histogram(c: Catalog) -> DataFrame:
    return c.get(cluster_summary).groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n_clusters"))


def evidence_flag_counts(c: Catalog) -> DataFrame:
    return c.get(evidence_bundle_windows).select(F.explode(F.split("evidence_flags", ",")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n_windows"))


def changepoint_timeline(c: Catalog) -> DataFrame:
    """Every minute of the grid, marked where a level shift of volume or pro rate begins."""
    changes = c.get(all_changepoints).select(F.col("change_minute").alias("minute_bucket")).distinct().withColumn("is_changepoint", F.lit(True))
    minutes = c.get(counts_per_minute).select("minute_bucket", "n_total", "n_unique_names", "pro_rate", "is_low_power")
    return minutes.join(changes, "minute_bucket", "left").na.fill(False, ["is_changepoint"])


def composite_timeline(c: Catalog) -> DataFrame:
    return c.get(ranked_windows).select("minute_bucket", "composite_score", "n_total", "pro_rate", "evidence_count")


def day_slot_heat(c: Catalog) -> DataFrame:
    """Pro rates by date and half hour, every slot of every date present."""
    m = c.get(minute_totals).select("n_total", "n_pro", F.date_format("minute_bucket", "yyyy-MM-dd").alias("date"), F.floor(f.minute_of_day("minute_bucket") / 30).cast("int").alias("slot"))
    cells = m.groupBy("date", "slot").agg(F.sum("n_total").alias("n_total"), F.sum("n_pro").alias("n_pro"))
    spine = cells.select("date").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    return spine.join(cells, ["date", "slot"], "left").na.fill(0, ["n_total", "n_pro"]).withColumn("pro_rate", f.ratio("n_pro", "n_total"))


def rolling_pro_rate(c: Catalog) -> DataFrame:
    """Volume-weighted pro rate over five half-hour buckets."""
    m = c.get(minute_totals).select(f.floor_bucket("minute_bucket", 30).alias("bucket_start"), "n_total", "n_pro").groupBy("bucket_start").agg(F.sum("n_total").alias("n_total"), F.sum("n_pro").alias("n_pro"))
    w = Window.orderBy("bucket_start").rowsBetween(-4, 0)  # one row a half hour
    return m.withColumn("rolling_pro_rate", f.ratio(F.sum("n_pro").over(w), F.sum("n_total").over(w)))
