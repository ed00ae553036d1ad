"""Feature vectors of reports, the corpus they are stored in, and baselines across it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.operators import triage
from hustings.operators.duplicates import cluster_summary, top_repeated_names
from hustings.operators.profile import name_frequency
from hustings.operators.rare import weird_names
from hustings.plans.catalog import Catalog

#: Metrics of a report's vector, and those by which reports are compared.
METRICS = (
    "total_submissions overall_pro_rate overall_con_rate window_queue_size record_queue_size cluster_queue_size window_high_count window_medium_count window_watch_count "
    "window_high_share window_top_score window_top_abs_z window_top_dup_fraction window_min_q_value top_name_max_records top_cluster_max_records off_hours_ratio dedup_drop_fraction"
).split()
COMPARED = {
    "total_submissions": "Total submissions",
    "overall_pro_rate": "Overall pro rate",
    "window_high_share": "High-tier window share",
    "window_top_score": "Top window score",
    "window_top_abs_z": "Top window |z|",
    "window_top_dup_fraction": "Top window duplicate fraction",
    "top_name_max_records": "Top repeated-name records",
    "top_cluster_max_records": "Top near-dup cluster records",
    "off_hours_ratio": "Off-hours submission ratio",
    "dedup_drop_fraction": "Dedup drop fraction",
}
#: Names and clusters that a vector carries at most, and those of a report's summary.
CARRIED, LEADING = 20, 5
UNAVAILABLE = "global_baselines_unavailable"

# one report --------------------------------------------------------------------------------------


def report_metrics(c: Catalog) -> DataFrame:
    """One row: the metrics of METRICS, from the queues of the raw lens and the totals of both."""
    triage.shared(c)
    c.stored(name_frequency)
    c.stored(weird_names)
    w = c.stored(triage.statistical_queue_raw)
    of_tier = lambda t: f.count_where(F.col("evidence_tier") == t)
    windows = w.agg(
        F.count(F.lit(1)).alias("window_queue_size"),
        *(of_tier(t).alias(f"window_{t}_count") for t in ("high", "medium", "watch")),
        (of_tier("high") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("window_high_share"),
        F.max("score").alias("window_top_score"),
        F.max(F.abs("z")).alias("window_top_abs_z"),
        F.max("dup_fraction").alias("window_top_dup_fraction"),
        F.min(F.when(F.col("q_value") >= 0, F.col("q_value"))).alias("window_min_q_value"),
    )
    totals = c.get(triage.lens_summary).select(
        F.col("total_submissions_raw").alias("total_submissions"), F.col("overall_pro_rate_raw").alias("overall_pro_rate"), F.col("overall_con_rate_raw").alias("overall_con_rate"), F.greatest(f.ratio(F.col("total_submissions_raw") - F.col("total_submissions_exact_row_dedup"), "total_submissions_raw"), F.lit(0.0)).alias("dedup_drop_fraction")
    )
    one = [
        windows,
        c.get(triage.record_evidence_queue).agg(F.count(F.lit(1)).alias("record_queue_size")),
        c.get(triage.cluster_evidence_queue).agg(F.count(F.lit(1)).alias("cluster_queue_size")),
        c.get(top_repeated_names).orderBy(F.desc("n"), "canonical_name").limit(LEADING).agg(F.coalesce(F.max("n"), F.lit(0)).alias("top_name_max_records")),
        c.stored(cluster_summary).orderBy("cluster_id").limit(LEADING).agg(F.coalesce(F.max("n_records"), F.lit(0)).alias("top_cluster_max_records")),
        c.records.agg(f.ratio(f.count_where(F.col("is_off_hours")), F.count(F.lit(1))).alias("off_hours_ratio")),
    ]
    for part in one:
        totals = totals.join(F.broadcast(part))  # one row each
    return totals.select(*(F.col(x).cast("double").alias(x) for x in METRICS))


def report_vector(c: Catalog) -> DataFrame:
    """The metrics in long form: metric, value; a metric without a value has no row."""
    return c.get(report_metrics).unpivot([], METRICS, "metric", "value").where("value is not null")


# stored vectors ----------------------------------------------------------------------------------

_NAME = "canonical_name string, display_name string, n_records string, n string, count string, n_pro string, n_con string"
_CLUSTER = "cluster_id string, cluster_size string, n_records string"
_LISTS = f"top_repeated_names array<struct<{', '.join(x.replace(' ', ':') for x in _NAME.split(', '))}>>, top_near_dup_clusters array<struct<{', '.join(x.replace(' ', ':') for x in _CLUSTER.split(', '))}>>"
VECTOR = f"report_id string, schema_version string, metrics map<string,string>, {', '.join(f'{x} string' for x in METRICS)}, {_LISTS}"
SUMMARY = f"total_submissions string, total_submissions_raw string, total_submissions_exact_row_dedup string, overall_pro_rate string, overall_con_rate string, queue_counts map<string,string>, window_tier_counts map<string,string>, off_hours_summary map<string,string>, {_LISTS}"

STORED = "report_id string, schema_version int, metrics map<string,double>, names array<struct<canonical_name:string,display_name:string,n_records:long,n_pro:long,n_con:long>>, clusters array<struct<cluster_id:string,cluster_size:long,n_records:long>>, has_vector boolean, has_summary boolean"


def number(c: Column) -> Column:
    """A finite number from JSON of any type, else null."""
    text = F.lower(F.trim(c.cast("string")))
    x = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def first_number(*cs: Column) -> Column:
    return F.coalesce(*(number(c) for c in cs))


def corpus_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """report_id, metrics (map), names, clusters, has_vector, has_summary of every report in the folder.

    Reports are folders with summary/feature_vector.json, summary/investigation_summary.json or both: one scan reads all
    files of both kinds, whatever version of the schema they have. What a vector lacks comes from the summary: metrics from
    its totals, counts of its queues, tiers and off-hours share, lists from its lists. A file that is no JSON object counts as absent; folders
    that begin with a dot are no reports.
    """
    pattern = f"{folder.rstrip('/')}/*/summary/{{feature_vector,investigation_summary}}.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)):
        return spark.createDataFrame([], STORED)
    files = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    files = files.select("value", F.element_at(parts, -3).alias("report"), F.element_at(parts, -1).startswith("feature_vector").alias("is_vector")).where(~F.col("report").startswith("."))
    one = files.groupBy("report").agg(F.max(F.when(F.col("is_vector"), F.col("value"))).alias("v"), F.max(F.when(~F.col("is_vector"), F.col("value"))).alias("s"))
    one = one.select("report", F.from_json("v", VECTOR).alias("v"), F.from_json("s", SUMMARY).alias("s"))
    some = lambda x: F.coalesce(F.to_json(x), F.lit("{}")) != "{}"  # noqa: E731  (nulls are left out)
    one = one.withColumns({"has_vector": some("v"), "has_summary": some("s")}).where("has_vector or has_summary")
    v, s = F.col("v"), F.col("s")
    names, clusters = carried_names(v["top_repeated_names"], s["top_repeated_names"]), carried_clusters(v["top_near_dup_clusters"], s["top_near_dup_clusters"])
    one = one.withColumns({"names": names, "clusters": clusters})
    have = lambda m: F.coalesce(v["metrics"][m], v[m])
    queues, tiers, off = s["queue_counts"], s["window_tier_counts"], s["off_hours_summary"]
    behind = {
        "total_submissions": [s["total_submissions"], F.lit("0")],
        "overall_pro_rate": [s["overall_pro_rate"]],
        "overall_con_rate": [s["overall_con_rate"]],
        "window_queue_size": [queues["window"], F.lit("0")],
        "record_queue_size": [queues["record"], F.lit("0")],
        "cluster_queue_size": [queues["cluster"], F.lit("0")],
        "window_high_count": [tiers["high"], F.lit("0")],
        "off_hours_ratio": [off["off_hours_ratio"]],
    }
    values = {m: first_number(have(m), *behind.get(m, [])) for m in METRICS}
    share = F.coalesce(f.ratio(values["window_high_count"], values["window_queue_size"]), F.lit(0.0))
    raw, dedup = first_number(s["total_submissions_raw"], s["total_submissions"], v["total_submissions"]), first_number(s["total_submissions_exact_row_dedup"], s["total_submissions"])
    most = lambda rows: F.coalesce(F.array_max(F.transform(rows, lambda r: r["n_records"])), F.lit(0)).cast("double")
    values["window_high_share"] = F.coalesce(number(have("window_high_share")), share)
    values["top_name_max_records"] = F.coalesce(number(have("top_name_max_records")), most("names"))
    values["top_cluster_max_records"] = F.coalesce(number(have("top_cluster_max_records")), most("clusters"))
    values["dedup_drop_fraction"] = F.coalesce(number(have("dedup_drop_fraction")), F.when(dedup.isNotNull(), F.greatest(f.ratio(raw - dedup, raw), F.lit(0.0))))
    metrics = F.map_filter(F.create_map(*(x for m in METRICS for x in (F.lit(m), values[m].cast("double")))), lambda k, x: x.isNotNull())
    return one.select(F.col("report").alias("report_id"), F.coalesce(F.expr("try_cast(v.schema_version as int)"), F.lit(2)).alias("schema_version"), metrics.alias("metrics"), "names", "clusters", "has_vector", "has_summary")


def _whole(c: Column) -> Column:
    return F.coalesce(number(c), F.lit(0.0)).cast("long")


def _listed(first: Column, second: Column) -> Column:
    return F.when(F.size(F.coalesce(first, F.array())) > 0, first).otherwise(F.coalesce(second, F.array()))


def carried_names(first: Column, second: Column) -> Column:
    """Names of the first list that holds any: with a name, the most records first, CARRIED at most."""
    rows = F.filter(_listed(first, second), lambda r: F.trim(F.coalesce(r["canonical_name"], F.lit(""))) != "")
    made = F.transform(rows, lambda r: F.struct((-_whole(F.coalesce(r["n_records"], r["n"], r["count"]))).alias("k"), F.trim(r["canonical_name"]).alias("canonical_name"), F.trim(F.coalesce(r["display_name"], F.lit(""))).alias("display_name"), _whole(r["n_pro"]).alias("n_pro"), _whole(r["n_con"]).alias("n_con")))
    return F.transform(F.slice(F.array_sort(made), 1, CARRIED), lambda r: F.struct(r["canonical_name"].alias("canonical_name"), r["display_name"].alias("display_name"), (-r["k"]).alias("n_records"), r["n_pro"].alias("n_pro"), r["n_con"].alias("n_con")))


def carried_clusters(first: Column, second: Column) -> Column:
    rows = F.filter(_listed(first, second), lambda r: F.trim(F.coalesce(r["cluster_id"], F.lit(""))) != "")
    made = F.transform(rows, lambda r: F.struct((-_whole(r["n_records"])).alias("k"), (-_whole(r["cluster_size"])).alias("s"), F.trim(r["cluster_id"]).alias("cluster_id")))
    return F.transform(F.slice(F.array_sort(made), 1, CARRIED), lambda r: F.struct(r["cluster_id"].alias("cluster_id"), (-r["s"]).alias("cluster_size"), (-r["k"]).alias("n_records")))


# baselines ---------------------------------------------------------------------------------------


def mid_ranks(rows: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """Add the share of the key's rows below each value, half of the equal ones counted. Distinct values are ranked, not rows."""
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key)
    upto = F.sum("__n").over(w.orderBy(value))
    ranks = counts.select(*key, value, ((upto - F.col("__n") + F.col("__n") * 0.5) / F.sum("__n").over(w)).alias(out))
    return rows.join(ranks, [*key, value])


def metric_comparators(vectors: DataFrame) -> DataFrame:
    """report_id, metric, label, value, percentile, band_p10, band_p50, band_p90, n_reports for each compared metric that a report has."""
    long = vectors.select("report_id", F.explode("metrics").alias("metric", "value")).where(F.col("metric").isin(*COMPARED))
    bands = long.groupBy("metric").agg(*(F.percentile("value", F.lit(p)).alias(f"band_p{round(p * 100)}") for p in (0.1, 0.5, 0.9)), F.count(F.lit(1)).alias("n_reports"))
    labels = F.create_map(*(F.lit(x) for kv in COMPARED.items() for x in kv))
    return mid_ranks(long, ["metric"], "value", "percentile").join(bands, "metric").select("report_id", "metric", labels[F.col("metric")].alias("label"), "value", "percentile", "band_p10", "band_p50", "band_p90", "n_reports")


def name_cues(vectors: DataFrame) -> DataFrame:
    """For each name that a vector carries: in how many reports it is, and how its most records rank among all names'."""
    rows = vectors.select("report_id", F.explode("names").alias("r")).select("report_id", "r.*")
    corpus = rows.groupBy("canonical_name").agg(F.count_distinct("report_id").alias("report_count"), F.max("n_records").alias("max_n_records_across_reports"))
    ranked = mid_ranks(corpus.where("max_n_records_across_reports > 0").withColumn("__one", F.lit(1)), ["__one"], "max_n_records_across_reports", "max_n_records_percentile")
    corpus = corpus.join(ranked.select("canonical_name", "max_n_records_percentile"), "canonical_name", "left")
    total = vectors.agg(F.count(F.lit(1)).alias("n"))
    df = rows.join(corpus, "canonical_name").join(F.broadcast(total))  # one row
    return df.select("report_id", "canonical_name", "display_name", F.col("n_records").alias("current_n_records"), "report_count", f.ratio("report_count", "n").alias("report_share"), "max_n_records_across_reports", "max_n_records_percentile")


def cluster_cues(vectors: DataFrame) -> DataFrame:
    rows = vectors.select("report_id", F.explode("clusters").alias("r")).select("report_id", "r.*").withColumn("__one", F.lit(1))
    for value in ("cluster_size", "n_records"):
        rows = mid_ranks(rows, ["__one"], value, f"{value}_percentile")
    return rows.drop("__one")


def baselines(vectors: DataFrame) -> DataFrame:
    """One row a report: report_id, report_count, and its comparators and cues as lists."""
    listed = lambda rows, name: rows.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct(*(x for x in rows.columns if x != "report_id")))).alias(name))
    total = vectors.agg(F.count(F.lit(1)).alias("report_count"))
    df = vectors.select("report_id").join(F.broadcast(total))  # one row
    for rows, name in ((metric_comparators(vectors), "metric_comparators"), (name_cues(vectors), "top_name_cues"), (cluster_cues(vectors), "top_cluster_cues")):
        df = df.join(listed(rows, name), "report_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return df


def write_baselines(df: DataFrame, folder: str) -> None:
    """A new version of the corpus baselines beside the old ones; the last whole one is read."""
    version = len(_versions(df.sparkSession, folder))
    df.write.json(f"{folder.rstrip('/')}/global_baselines/v{version:06d}")


def _versions(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/global_baselines")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(x.getPath().toString() for x in fs.listStatus(path)) if fs.exists(path) else []
    return [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS"))]


BASELINE = "report_id string, report_count long, metric_comparators array<struct<metric:string,label:string,value:double,percentile:double,band_p10:double,band_p50:double,band_p90:double,n_reports:long>>, top_name_cues array<struct<canonical_name:string,display_name:string,current_n_records:long,report_count:long,report_share:double,max_n_records_across_reports:long,max_n_records_percentile:double>>, top_cluster_cues array<struct<cluster_id:string,cluster_size:long,n_records:long,cluster_size_percentile:double,n_records_percentile:double>>"


def baseline_of(spark: SparkSession, report_id: str, folders: list[str]) -> DataFrame:
    """One row: the report's baseline from the first of the folders that has one, with source_path; else available is false and reason says why."""
    for folder in folders:
        for path in reversed(_versions(spark, folder)[-1:]):
            row = spark.read.schema(BASELINE).json(path).where(F.col("report_id") == report_id)
            if row.limit(1).count():
                return row.limit(1).select(F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"), F.lit(path).alias("source_path"), "*")
    empty = spark.createDataFrame([(report_id, 0, [], [], [])], BASELINE)
    return empty.select(F.lit(False).alias("available"), F.lit(UNAVAILABLE).alias("reason"), F.lit(None).cast("string").alias("source_path"), "*")
