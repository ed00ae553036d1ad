"""Rare, unusual and unlisted names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.operators.duplicates import name_minutes
from hustings.operators.profile import name_features, name_forms, name_frequency
from hustings.plans.catalog import Catalog


def singleton_names(c: Catalog) -> DataFrame:
    return c.get(name_frequency).where("n = 1")


def name_windows(c: Catalog) -> DataFrame:
    """Counts and distinct names by bucket: names are grouped within buckets first, so nothing counts distinct rows."""
    df = f.with_buckets(c.get(name_minutes), "minute_bucket", c.config.buckets)
    names = df.groupBy("bucket_minutes", "bucket_start", "canonical_name").agg(*(F.sum(x).alias(x) for x in ("n", "n_pro", "n_con")))
    df = names.groupBy("bucket_minutes", "bucket_start").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_unique_names"), F.sum("n_pro").alias("n_pro"), F.sum("n_con").alias("n_con"))
    df = df.withColumns({"unique_ratio": f.ratio("n_unique_names", "n_total"), "pro_rate": f.ratio("n_pro", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


def unique_ratio_windows(c: Catalog) -> DataFrame:
    """Windows with enough rows; the flag marks the top hundredth of each bucket size, unflagged rows stay. Limits and rows read one written table."""
    df = c.stored(name_windows).where(F.col("n_total") >= c.config.rare_min_total)
    limits = df.groupBy("bucket_minutes").agg(F.percentile("unique_ratio", F.lit(0.99)).alias("threshold_unique_ratio"))
    return df.join(limits, "bucket_minutes").withColumn("is_flagged_unique_ratio", F.col("unique_ratio") >= F.col("threshold_unique_ratio"))


def weird_names(c: Catalog) -> DataFrame:
    """A report: the `top_n` names with the highest mean weirdness."""
    mean = lambda x: (F.sum(F.col(x) * F.col("records")) / F.sum("records")).alias(x)  # noqa: E731  (over records)
    df = c.get(name_features).groupBy("canonical_name").agg(*map(mean, ("weirdness_score", "name_length", "non_alpha_fraction", "name_entropy")), F.min("name_normalized").alias("sample_name"))
    return df.orderBy(F.desc(F.round("weirdness_score", 9)), "canonical_name").limit(c.config.top_n)


def record_rarity(c: Catalog) -> DataFrame:
    return with_rarity(c, c.records.select("id", "minute_bucket", "canonical_name", "first_canonical", "last"))


def name_rarity(c: Catalog) -> DataFrame:
    """The same for each first and last name that records have: tokens are cleaned and looked up once a name."""
    return with_rarity(c, c.get(name_forms).select("first_canonical", "last").distinct(), "first_canonical", "last").select("first_canonical", "last", "rarity_score")


def with_rarity(c: Catalog, rows: DataFrame, *keep: str) -> DataFrame:
    """-ln of the product of token probabilities; a token that a lookup lacks counts as the smallest probability. Names go unless kept."""
    first, last = c.frequencies
    r = rows.withColumns({"first_token": f.clean_token("first_canonical"), "last_token": f.clean_token("last")}).drop(*({"first_canonical", "last"} - set(keep)))
    r = r.join(first.select(F.col("token").alias("first_token"), F.col("probability").alias("p_first")), "first_token", "left")
    r = r.join(last.select(F.col("token").alias("last_token"), F.col("probability").alias("p_last")), "last_token", "left")
    eps = F.lit(c.config.epsilon)
    product = F.coalesce("p_first", eps) * F.coalesce("p_last", eps)
    return r.withColumn("rarity_score", -F.log(F.greatest(product, eps)))


def rarity_by_bucket(c: Catalog) -> DataFrame:
    """Mean and percentiles of scores by bucket. Equal scores of a minute are counted first: names have few, records many."""
    scores = c.get(record_rarity).groupBy("minute_bucket", "rarity_score").agg(F.count(F.lit(1)).alias("n"))
    df = f.with_buckets(scores, "minute_bucket", c.config.buckets).groupBy("bucket_minutes", "bucket_start", "rarity_score").agg(F.sum("n").alias("n"))
    s, n = F.col("rarity_score"), F.col("n")
    df = df.groupBy("bucket_minutes", "bucket_start").agg(
        F.sum(n).alias("n_total"),
        (F.sum(s * n) / F.sum(n)).alias("rarity_mean"),
        F.percentile(s, F.lit(0.5), n).alias("rarity_median"),
        F.percentile(s, F.lit(0.9), n).alias("rarity_p90"),
        F.percentile(s, F.lit(0.95), n).alias("rarity_p95"),
    )
    return df.withColumn("is_low_power", f.low_power("n_total", c.config.low_power_min))


def rarity_high_windows(c: Catalog) -> DataFrame:
    df = c.stored(rarity_by_bucket).where(F.col("n_total") >= c.config.rare_min_total)
    limits = df.groupBy("bucket_minutes").agg(F.percentile("rarity_median", F.lit(0.99)).alias("threshold_rarity_median"))
    return df.join(limits, "bucket_minutes").where("rarity_median >= threshold_rarity_median")


def rarity_top_records(c: Catalog) -> DataFrame:
    """A report: the `top_n` records with the rarest names."""
    return c.get(record_rarity).select("id", "canonical_name", "rarity_score").orderBy(F.desc(F.round("rarity_score", 9)), "id").limit(c.config.top_n)


def unmatched_tokens(c: Catalog, side: str) -> DataFrame:
    lookup = c.frequencies[0 if side == "first" else 1].select(F.col("token").alias(f"{side}_token"))
    df = c.get(record_rarity).where(F.col(f"{side}_token") != "").join(lookup, f"{side}_token", "left_anti")
    return df.groupBy(f"{side}_token").agg(F.count(F.lit(1)).alias("n"))


def rarity_unmatched_first_tokens(c: Catalog) -> DataFrame:
    return unmatched_tokens(c, "first").orderBy(F.desc("n"), "first_token").limit(c.config.top_n)


def rarity_unmatched_last_tokens(c: Catalog) -> DataFrame:
    return unmatched_tokens(c, "last").orderBy(F.desc("n"), "last_token").limit(c.config.top_n)


def rarity_lookup_coverage(c: Catalog) -> DataFrame:
    df = c.get(record_rarity)
    sides = []
    for side, lookup in zip(("first", "last"), c.frequencies):
        token = F.col(f"{side}_token")
        one = df.agg(f.count_where(token != "").alias("n_tokens"), f.count_where((token != "") & F.col(f"p_{side}").isNotNull()).alias("n_matched"))
        size = lookup.agg(F.count(F.lit(1)).alias("lookup_size"))
        sides.append(one.join(F.broadcast(size)).select(F.lit(side).alias("lookup"), "lookup_size", "n_tokens", "n_matched", f.ratio("n_matched", "n_tokens").alias("match_rate")))  # one row each
    return sides[0].unionByName(sides[1])
