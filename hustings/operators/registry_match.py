"""Linkage of names to a voter registry: exact, strong, weak or none, with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import string_ratio
from hustings.plans.catalog import Catalog

TIERS = ("exact", "strong_fuzzy", "weak_fuzzy", "unmatched")


def scaled(score: Column, low: float, high: float, out_low: float, out_high: float) -> Column:
    """Linear between two scores, cut at both ends."""
    share = F.least(F.greatest((score - low) / max(high - low, 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.lit(out_low) + share * (out_high - out_low)


def assignments(c: Catalog) -> DataFrame:
    """One row for each distinct name: tier, confidence, best candidate and caveat.

    Candidates share the last name; only names without an exact match are compared. The best
    candidate and the number of close ones come from aggregations, not from sorting candidates.
    """
    names = c.records.groupBy("canonical_name").agg(F.min("last").alias("last"), F.min("first_canonical").alias("first"), F.max("canonical_name").alias("same"))
    names = names.where("same <> '|'").drop("same")  # of the group: a test of the key would move below all that makes names of rows
    registry = c.registry
    exact = registry.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n_registry"))
    known = names.join(exact, "canonical_name", "left")
    rest = known.where("n_registry is null")
    people = registry.select("last", F.col("first").alias("candidate")).distinct()
    scored = rest.join(people, "last").withColumn("score", string_ratio("first", "candidate"))
    # scored once: candidates of equal score are counted before they meet, and a name has few different scores
    levels = scored.groupBy("canonical_name", "score").agg(F.count(F.lit(1)).alias("n"), F.max("candidate").alias("candidate"))
    top = levels.groupBy("canonical_name").agg(F.max(F.struct("score", "candidate")).alias("best"), F.collect_list(F.struct("score", "n")).alias("levels"))
    close = F.filter("levels", lambda x: x["score"] >= F.col("best.score") - c.config.ambiguous_gap)
    top = top.select("canonical_name", "best", F.aggregate(close, F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("n_close"))
    df = known.join(top, "canonical_name", "left")
    s = F.col("best.score")
    strong, weak = c.config.strong_score, c.config.weak_score
    ambiguous = F.coalesce(F.col("n_close") > 1, F.lit(False)) & (s >= weak)
    is_exact = F.col("n_registry").isNotNull()
    tier = F.when(is_exact, "exact").when((s >= strong) & ~ambiguous, "strong_fuzzy").when(s >= weak, "weak_fuzzy").otherwise("unmatched")
    high = scaled(s, strong, 100.0, 0.80, 0.95)
    low = scaled(s, weak, strong, 0.55, 0.79)
    confidence = F.when(is_exact, 1.0).when((s >= strong) & ~ambiguous, high).when(s >= strong, F.least(F.lit(0.78), high)).when(s >= weak, F.least(F.lit(0.78), low)).otherwise(0.0)
    caveat = F.when(is_exact, "").when(s.isNull(), "no_last_name_candidates").when(ambiguous, "ambiguous_candidates").when(s < weak, "below_threshold").otherwise("fuzzy_match")
    return df.select("canonical_name", "last", tier.alias("match_tier"), confidence.alias("match_confidence"), F.when(is_exact, F.col("canonical_name")).when(s >= weak, F.concat("last", F.lit("|"), F.col("best.candidate"))).alias("matched_name"), caveat.alias("caveat"))


def linked(c: Catalog) -> DataFrame:
    """Records by minute, stance and name with their tier; names are grouped before they are joined."""
    names = c.records.groupBy("minute_bucket", "position_normalized", "canonical_name").agg(F.count(F.lit(1)).alias("n"))
    df = names.join(c.get(assignments).select("canonical_name", "match_tier", "match_confidence", "caveat", "matched_name"), "canonical_name", "left")
    return df.withColumns({"match_tier": F.coalesce("match_tier", F.lit("unmatched")), "match_confidence": F.coalesce("match_confidence", F.lit(0.0))})


def tier_sums() -> list[Column]:
    n = F.col("n")
    sums = [F.sum("n").alias("n_total"), F.sum(F.when(F.col("match_tier") != "unmatched", n).otherwise(0)).alias("n_matches")]
    sums += [F.sum(F.when(F.col("match_tier") == t, n).otherwise(0)).alias(f"n_{t}") for t in TIERS]
    return [*sums, F.sum(n * F.col("match_confidence")).alias("expected_matches")]


def with_rates(df: DataFrame, c: Catalog) -> DataFrame:
    df = df.withColumns({"match_rate": f.ratio("n_matches", "n_total"), "expected_match_rate": f.ratio("expected_matches", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_matches", "n_total", "match_rate")


def match_overview(c: Catalog) -> DataFrame:
    df = c.get(linked)
    unique = c.get(assignments).agg(F.count(F.lit(1)).alias("n_unique_names"), f.count_where(F.col("match_tier") != "unmatched").alias("n_unique_matched"))
    size = c.registry.agg(F.count(F.lit(1)).alias("registry_rows"))
    return with_rates(df.agg(*tier_sums()), c).join(F.broadcast(unique)).join(F.broadcast(size))  # one row each


def match_by_position(c: Catalog) -> DataFrame:
    return with_rates(c.get(linked).groupBy("position_normalized").agg(*tier_sums()), c)


def match_by_bucket_position(c: Catalog) -> DataFrame:
    df = f.with_buckets(c.get(linked), "minute_bucket", (c.config.registry_bucket, 240))
    return with_rates(df.groupBy("bucket_minutes", "bucket_start", "position_normalized").agg(*tier_sums()), c)


def match_by_bucket(c: Catalog) -> DataFrame:
    df = f.with_buckets(c.get(linked), "minute_bucket", (c.config.registry_bucket, 240))
    sums = tier_sums()
    for stance in ("Pro", "Con"):
        is_it = F.col("position_normalized") == stance
        sums += [F.sum(F.when(is_it, F.col("n")).otherwise(0)).alias(f"n_total_{stance.lower()}"), F.sum(F.when(is_it & (F.col("match_tier") != "unmatched"), F.col("n")).otherwise(0)).alias(f"n_matches_{stance.lower()}")]
    df = with_rates(df.groupBy("bucket_minutes", "bucket_start").agg(*sums), c)
    return df.withColumns({f"match_rate_{s}": f.ratio(f"n_matches_{s}", f"n_total_{s}") for s in ("pro", "con")})


def name_tiers(c: Catalog) -> DataFrame:
    return c.get(linked).groupBy("canonical_name", "match_tier", "match_confidence", "matched_name", "caveat").agg(F.sum("n").alias("n"))


def matched_names(c: Catalog) -> DataFrame:
    """A report of the 500 most frequent matched names."""
    return c.get(name_tiers).where("match_tier <> 'unmatched'").orderBy(F.desc("n"), "canonical_name").limit(500)


def unmatched_names(c: Catalog) -> DataFrame:
    """A report of the 500 most frequent names without a match."""
    return c.get(name_tiers).where("match_tier = 'unmatched'").select("canonical_name", "n", "caveat").orderBy(F.desc("n"), "canonical_name").limit(500)


def match_tier_summary(c: Catalog) -> DataFrame:
    tiers = c.spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "match_tier string, tier_order int")
    counts = c.get(linked).groupBy("match_tier").agg(F.sum("n").alias("n_records"), F.count_distinct("canonical_name").alias("n_names"), f.ratio(F.sum(F.col("n") * F.col("match_confidence")), F.sum("n")).alias("mean_confidence"))
    df = tiers.join(F.broadcast(counts), "match_tier", "left").na.fill(0, ["n_records", "n_names"])  # four rows
    return df.withColumn("share", f.ratio("n_records", F.sum("n_records").over(Window.partitionBy(F.lit(1)))))


def match_uncertainty_summary(c: Catalog) -> DataFrame:
    found = c.get(name_tiers).where("caveat <> ''").groupBy("caveat").agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_records"))
    none = c.spark.createDataFrame([("none_detected", 0, 0)], "caveat string, n_names long, n_records long")
    some = found.agg(F.count(F.lit(1)).alias("some"))
    return found.unionByName(none.join(F.broadcast(some)).where("some = 0").drop("some"))  # one row each


def exact_by_position(c: Catalog) -> DataFrame:
    """Exact matches by stance: a semi-join of distinct names, without any string score."""
    exact = c.registry.select("canonical_name").distinct().withColumn("hit", F.lit(True))
    names = c.records.groupBy("position_normalized", "canonical_name").agg(F.count(F.lit(1)).alias("n")).join(exact, "canonical_name", "left")
    df = names.groupBy("position_normalized").agg(F.sum("n").alias("n_total"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("n_exact"))
    return df.withColumn("exact_rate", f.ratio("n_exact", "n_total"))
