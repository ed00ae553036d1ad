"""Exact and near duplicates of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.operators.profile import name_forms, name_frequency
from hustings.operators.similar_names import similar_pairs
from hustings.plans.catalog import Catalog
from hustings.plans.graph import connected_components

# exact -------------------------------------------------------------------------------------------


def repeated_names(c: Catalog) -> DataFrame:
    return c.get(name_frequency).where("n > 1").select("canonical_name", "n", "n_pro", "n_con", "first_seen", "last_seen", "display_name", "time_span_minutes")


def top_repeated_names(c: Catalog) -> DataFrame:
    """A report: the `top_n` names that come most often."""
    return c.get(repeated_names).orderBy(F.desc("n"), "canonical_name").limit(c.config.top_n)


def name_minutes(c: Catalog) -> DataFrame:
    """Counts by name and minute, from which every bucket size follows."""
    return c.records.groupBy("canonical_name", "minute_bucket").agg(F.count(F.lit(1)).alias("n"), *f.stance_counts())


def repeated_same_bucket(c: Catalog) -> DataFrame:
    df = f.with_buckets(c.get(name_minutes), "minute_bucket", c.config.buckets)
    df = df.groupBy("bucket_minutes", "canonical_name", "bucket_start").agg(*(F.sum(x).alias(x) for x in ("n", "n_pro", "n_con", "n_unknown"))).where("n > 1")
    return df.withColumn("bucket_end", f.plus_minutes("bucket_start", F.col("bucket_minutes") - 1))


def repeated_same_minute(c: Catalog) -> DataFrame:
    return c.get(name_minutes).where("n > 1")


def position_switching_names(c: Catalog) -> DataFrame:
    return c.get(repeated_names).where("n_pro > 0 and n_con > 0")


def repeated_same_bucket_summary(c: Catalog) -> DataFrame:
    return c.get(repeated_same_bucket).groupBy("bucket_minutes").agg(
        F.count(F.lit(1)).alias("n_instances"), F.count_distinct("canonical_name").alias("n_names"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n")
    )


# near --------------------------------------------------------------------------------------------


def blocked_names(c: Catalog) -> DataFrame:
    """Distinct names with their block: the start of the last name and the first initial."""
    names = c.get(name_forms).groupBy("canonical_name").agg(F.min("name_display").alias("name_display"), F.min("last").alias("last"), F.min("first_canonical").alias("first_canonical"))
    return names.withColumn("block_key", f.block_key("last", "first_canonical"))


def candidate_blocks(c: Catalog) -> DataFrame:
    return c.get(blocked_names).groupBy("block_key").agg(F.count(F.lit(1)).alias("n_unique_names")).where("n_unique_names > 1")


def skipped_blocks(c: Catalog) -> DataFrame:
    """Blocks beyond the cap that comparing all pairs needs. They are reported as large; similarity_edges compares them like any other."""
    return c.get(candidate_blocks).where(F.col("n_unique_names") > c.config.block_cap).withColumn("reason", F.lit("block_size_exceeds_limit"))


def similarity_edges(c: Catalog) -> DataFrame:
    """Pairs of one block whose token-set ratio, cut to an integer, reaches the threshold; blocks of any size."""
    blocks = c.get(candidate_blocks).select("block_key")
    return similar_pairs(c.get(blocked_names).join(blocks, "block_key"), c.config.similarity)


def cluster_members(c: Catalog) -> DataFrame:
    """Names of each component with their activity; the smallest name stands for a cluster."""
    c.stored(name_forms)  # read by blocks, edges and frequencies
    edges = c.get(similarity_edges).select(F.col("left_name").alias("a"), F.col("right_name").alias("b"))
    found = connected_components(edges).withColumnsRenamed({"node": "canonical_name", "label": "cluster_root"})
    names = c.get(name_frequency).select("canonical_name", F.col("n").alias("n_records"), "first_seen", "last_seen", "n_pro", "n_con", "display_name")
    members = found.join(names, "canonical_name")
    sizes = found.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("size"))
    ranked = sizes.withColumn("cluster_id", F.format_string("cluster_%04d", F.row_number().over(Window.orderBy(F.desc("size"), "cluster_root"))))  # one row a cluster
    return members.join(ranked.select("cluster_root", "cluster_id"), "cluster_root").drop("cluster_root")


def cluster_time_concentration(c: Catalog) -> DataFrame:
    """Records of each cluster by minute. Members are a small table: records meet it where they are read and are counted there, before anything is shuffled."""
    members = c.stored(cluster_members).select("cluster_id", "canonical_name")
    df = c.records.join(members, "canonical_name").groupBy("cluster_id", "minute_bucket").agg(F.count(F.lit(1)).alias("n_records"), *f.stance_counts()[:2])
    return df.withColumn("bucket_fraction", F.col("n_records") / F.sum("n_records").over(Window.partitionBy("cluster_id")))


def cluster_time_concentration_summary(c: Catalog) -> DataFrame:
    df = c.get(cluster_time_concentration)
    peak = F.max_by(F.struct("minute_bucket", "bucket_fraction", "n_records"), F.struct("bucket_fraction", "n_records", -F.unix_timestamp(F.col("minute_bucket").cast("timestamp"))))
    out = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_active_buckets"), F.sum(F.pow("bucket_fraction", F.lit(2))).alias("concentration_hhi"), peak.alias("p"))
    return out.select("cluster_id", "n_active_buckets", "concentration_hhi", F.col("p.minute_bucket").alias("peak_bucket"), F.col("p.bucket_fraction").alias("peak_fraction"), F.col("p.n_records").alias("peak_records"))


def cluster_summary(c: Catalog) -> DataFrame:
    members = c.stored(cluster_members)
    out = members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"),
        F.sum("n_records").alias("n_records"),
        F.sum("n_pro").alias("n_pro"),
        F.sum("n_con").alias("n_con"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_join(F.slice(F.array_sort(F.collect_set("display_name")), 1, 10), " | ").alias("names_preview"),
    )
    out = out.withColumn("time_span_minutes", f.minutes_between("last_seen", "first_seen"))
    return out.join(c.get(cluster_time_concentration_summary), "cluster_id", "left").na.fill(0, ["n_active_buckets", "concentration_hhi", "peak_fraction", "peak_records"])
