"""Organisation fields: how often each comes, bursts within a minute, and how often the field is blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.plans.catalog import Catalog

STANCES = {"pro": "Pro", "con": "Con", "unknown": "Unknown"}


def cleaned(c: Catalog) -> DataFrame:
    org = F.upper(F.trim("organization"))
    return c.records.select("id", "timestamp", "minute_bucket", "position_normalized", org.alias("organization_clean")).withColumn("is_blank", F.col("organization_clean") == "")


def organization_counts(c: Catalog) -> DataFrame:
    return c.get(cleaned).where("not is_blank").groupBy("organization_clean").agg(
        F.count(F.lit(1)).alias("n"), *f.stance_counts()[:2], F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def organization_minute_bursts(c: Catalog) -> DataFrame:
    counts = c.get(cleaned).where("not is_blank").groupBy("minute_bucket", "organization_clean").agg(F.count(F.lit(1)).alias("n"))
    limit = counts.agg(F.percentile("n", F.lit(0.99)).alias("threshold"))  # one row
    return counts.join(F.broadcast(limit)).where(F.col("n") >= F.greatest(F.lit(2.0), F.col("threshold")))


def blank_minutes(c: Catalog) -> DataFrame:
    return c.get(cleaned).groupBy("minute_bucket", "position_normalized").agg(F.count(F.lit(1)).alias("n_total"), f.count_where(F.col("is_blank")).alias("n_blank_org"))


def blank_rate_by_bucket_position(c: Catalog) -> DataFrame:
    df = f.with_buckets(c.get(blank_minutes), "minute_bucket", c.config.buckets)
    df = df.groupBy("bucket_minutes", "bucket_start", "position_normalized").agg(F.sum("n_total").alias("n_total"), F.sum("n_blank_org").alias("n_blank_org"))
    df = df.withColumns({"n_nonblank_org": F.col("n_total") - F.col("n_blank_org"), "blank_org_rate": f.ratio("n_blank_org", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_blank_org", "n_total", "blank_org_rate")


def blank_rate_by_bucket(c: Catalog) -> DataFrame:
    """Overall and for each stance, from one aggregation; all columns are there even if a stance never occurs."""
    df = f.with_buckets(c.get(blank_minutes), "minute_bucket", c.config.buckets)
    sums = [F.sum("n_total").alias("n_total"), F.sum("n_blank_org").alias("n_blank_org")]
    for short, name in STANCES.items():
        is_it = F.col("position_normalized") == name
        sums += [F.sum(F.when(is_it, F.col("n_total")).otherwise(0)).alias(f"n_{short}"), F.sum(F.when(is_it, F.col("n_blank_org")).otherwise(0)).alias(f"n_blank_org_{short}")]
    df = df.groupBy("bucket_minutes", "bucket_start").agg(*sums)
    df = df.withColumns({"n_nonblank_org": F.col("n_total") - F.col("n_blank_org"), "blank_org_rate": f.ratio("n_blank_org", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    df = f.with_wilson(df, "n_blank_org", "n_total", "blank_org_rate")
    for short in STANCES:
        df = df.withColumns({f"{short}_blank_org_rate": f.ratio(f"n_blank_org_{short}", f"n_{short}"), f"{short}_is_low_power": f.low_power(f"n_{short}", c.config.low_power_min)})
        df = f.with_wilson(df, f"n_blank_org_{short}", f"n_{short}", f"{short}_blank_org_rate")
    return df


def blank_rate_summary(c: Catalog) -> DataFrame:
    rate = F.col("blank_org_rate")
    return c.get(blank_rate_by_bucket).groupBy("bucket_minutes").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        f.count_where(F.col("is_low_power")).alias("n_low_power_buckets"),
        F.avg(rate).alias("avg_blank_org_rate"),
        F.percentile(rate, F.lit(0.5)).alias("median_blank_org_rate"),
        F.max(rate).alias("max_blank_org_rate"),
        F.min(rate).alias("min_blank_org_rate"),
        F.avg("blank_org_rate_wilson_half_width").alias("avg_blank_org_rate_wilson_half_width"),
    )
