"""Profile tables: the dense minute series and what is counted per hour, name and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.plans.catalog import Catalog


def minute_totals(c: Catalog) -> DataFrame:
    """Observed minutes only. Names are grouped first, so one shuffle on (minute, name) serves all columns."""
    first = F.min_by("position_normalized", F.struct("timestamp", "id"))
    names = c.records.groupBy("minute_bucket", "canonical_name").agg(F.count(F.lit(1)).alias("n"), *f.stance_counts(), first.alias("kept"))
    return names.groupBy("minute_bucket").agg(
        F.sum("n").alias("n_total"),
        F.count(F.lit(1)).alias("n_unique_names"),
        *(F.sum(x).alias(x) for x in ("n_pro", "n_con", "n_unknown")),
        F.count(F.lit(1)).alias("n_total_dedup"),
        f.count_where(F.col("kept") == "Pro").alias("n_pro_dedup"),
        f.count_where(F.col("kept") == "Con").alias("n_con_dedup"),
        f.count_where(F.col("kept") == "Unknown").alias("n_unknown_dedup"),
    )


def with_dedup_columns(df: DataFrame) -> DataFrame:
    """A minute table of any origin with the columns of the deduplicated lens: what is there, else what can stand for it.

    Totals fall back on distinct names, these on totals, stances on raw stances; counts that are no numbers are zero, none is below it.
    Rates are null where nothing is counted; the duplicate share is 1 - names / total where it is not given, within 0 and 1.
    """

    def number(name: str, *instead: str) -> Column:
        there = next((x for x in (name, *instead) if x in df.columns), None)
        return F.lit(0.0) if there is None else F.coalesce(F.nanvl(F.col(there).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))

    floor = lambda x: F.greatest(x, F.lit(0.0))
    raw, names = number("n_total"), number("n_unique_names", "n_total")
    total, pro, con = floor(number("n_total_dedup", "n_unique_names", "n_total")), floor(number("n_pro_dedup", "n_pro")), floor(number("n_con_dedup", "n_con"))
    some = total > 0
    given = number("dup_name_fraction_dedup") if "dup_name_fraction_dedup" in df.columns else F.lit(0.0)
    out = {
        "n_total_dedup": total,
        "n_pro_dedup": pro,
        "n_con_dedup": con,
        "pro_rate_dedup": F.when(some, pro / total),
        "con_rate_dedup": F.when(some, con / total),
        "dup_name_fraction_dedup": F.least(floor(F.coalesce(F.when(some, given), F.when(some, 1.0 - names / total), F.lit(0.0))), F.lit(1.0)),
        "dedup_drop_fraction": F.when(raw > 0, (raw - total) / raw),
        "dedup_multiplier": F.when(some, raw / total),
    }
    return df.withColumns(out)


def counts_per_minute(c: Catalog) -> DataFrame:
    """One row for every minute from the first to the last, zero where nothing came."""
    seen = c.get(minute_totals)
    ends = c.records.agg(F.min("minute_bucket").alias("a"), F.max("minute_bucket").alias("b"))
    # hours first, minutes within them second: no task holds the whole span as one array
    hours = ends.where("a is not null").select(F.explode(F.sequence(F.date_trunc("HOUR", "a").cast("timestamp_ntz"), F.col("b"), F.expr("INTERVAL 1 HOUR"))).alias("h"), "a", "b")
    grid = hours.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda m: f.plus_minutes("h", m))).alias("minute_bucket"), "a", "b").where("minute_bucket between a and b").select("minute_bucket")
    counts = [x for x in seen.columns if x != "minute_bucket"]
    df = grid.join(seen, "minute_bucket", "left").select("minute_bucket", *(F.coalesce(x, F.lit(0)).alias(x) for x in counts))
    df = df.withColumns(
        {
            "dup_name_fraction": F.coalesce(1.0 - f.ratio("n_unique_names", "n_total"), F.lit(0.0)),
            "pro_rate": f.ratio("n_pro", "n_total"),
            "con_rate": f.ratio("n_con", "n_total"),
            "unique_ratio": f.ratio("n_unique_names", "n_total"),
            "pro_rate_dedup": f.ratio("n_pro_dedup", "n_total_dedup"),
            "con_rate_dedup": f.ratio("n_con_dedup", "n_total_dedup"),
            "dup_name_fraction_dedup": F.lit(0.0),
            "unique_ratio_dedup": f.ratio("n_total_dedup", "n_total_dedup"),
            "dedup_drop_fraction": f.ratio(F.col("n_total") - F.col("n_total_dedup"), "n_total"),
            "dedup_multiplier": f.ratio("n_total", "n_total_dedup"),
            "is_low_power": f.low_power("n_total", c.config.low_power_min),
        }
    )
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


def name_forms(c: Catalog) -> DataFrame:
    """Each form in which a name is shown, with its activity: one pass over the records, which hashes them as no text is aggregated.

    What is said of names follows from this table, which has a row for each form, not for each record.
    """
    return c.records.groupBy("canonical_name", "name_display", "last", "first_canonical").agg(
        F.count(F.lit(1)).alias("n"), *f.stance_counts(), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("id").alias("first_id")
    )


def name_frequency(c: Catalog) -> DataFrame:
    df = c.get(name_forms).groupBy("canonical_name").agg(
        *(F.sum(x).alias(x) for x in ("n", "n_pro", "n_con", "n_unknown")),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min_by("name_display", "first_id").alias("display_name"),
    )
    labels = F.concat_ws(",", F.when(F.col("n_con") > 0, "Con"), F.when(F.col("n_pro") > 0, "Pro"), F.when(F.col("n_unknown") > 0, "Unknown"))
    return df.withColumns({"time_span_minutes": f.minutes_between("last_seen", "first_seen"), "positions": labels})


def counts_per_hour(c: Catalog) -> DataFrame:
    df = c.records.groupBy("day_of_week", "hour").agg(F.count(F.lit(1)).alias("n_total"), *f.stance_counts()[:2])
    df = df.withColumns({"pro_rate": f.ratio("n_pro", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


def basic_quality(c: Catalog) -> DataFrame:
    """Metric and value. Steps back in time compare neighbours by id: ids are ranged, so that each range sorts by itself."""
    r = c.records
    ids = r.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_ids"))
    base = r.agg(
        F.count(F.lit(1)).alias("rows_total"),
        f.count_where(F.trim(F.coalesce("name", F.lit(""))) == "").alias("missing_name"),
        f.count_where(F.trim("organization") == "").alias("missing_organization"),
        f.count_where(F.col("position_normalized") == "Unknown").alias("unknown_position"),
        f.count_where(F.col("timestamp").isNull()).alias("invalid_timestamp"),
    )
    wide = base.join(F.broadcast(ids)).join(F.broadcast(steps_back(r)))  # one row each
    metrics = [x for x in wide.columns]
    return wide.unpivot([], metrics, "metric", "value").select("metric", F.col("value").cast("long").alias("value"))


def steps_back(records: DataFrame, width: int = 1 << 16) -> DataFrame:
    """How often the timestamp falls from one row to the next in (id, timestamp) order, in one row.

    Ranges of ids are ordered by themselves; the ends of ranges meet in a second, far smaller step.
    """
    rows = records.select(F.col("id").cast("long").alias("id"), "timestamp").where("timestamp is not null").withColumn("range", F.floor(F.col("id") / width))
    own = Window.partitionBy("range").orderBy("id", "timestamp")
    inner = rows.withColumn("back", (F.lag("timestamp").over(own) > F.col("timestamp")).cast("long"))
    ranges = inner.groupBy("range").agg(F.sum("back").alias("back"), F.min(F.struct("id", "timestamp")).alias("head"), F.max(F.struct("id", "timestamp")).alias("tail"))
    seams = Window.orderBy("range")
    met = ranges.withColumn("seam", (F.lag("tail.timestamp").over(seams) > F.col("head.timestamp")).cast("long"))
    return met.agg((F.coalesce(F.sum("back"), F.lit(0)) + F.coalesce(F.sum("seam"), F.lit(0))).alias("non_monotonic_timestamp_vs_id"))


def name_features(c: Catalog) -> DataFrame:
    """What depends on the text of a name alone, once for each, with the number of its records."""
    name = F.col("name_normalized")
    n = F.length(name)
    names = c.records.groupBy("name_normalized", "first", "canonical_name").agg(F.count(F.lit(1)).alias("records"))
    letters = F.length(F.regexp_replace(name, "[^A-Za-z ]", ""))
    chars = F.split(name, "")
    shares = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    size = F.size(chars).cast("double")
    entropy = F.when(n > 0, -F.aggregate(shares, F.lit(0.0), lambda t, k: t + k / size * F.log2(k / size))).otherwise(0.0)
    names = names.withColumns(
        {
            "name_length": n,
            "non_alpha_fraction": F.coalesce(f.ratio(n - letters, n), F.lit(0.0)),
            "name_entropy": entropy,
            "is_initial_only": F.col("first").rlike(r"^[A-Z]\.?$"),
        }
    )
    middle = names.agg(F.percentile("name_length", F.lit(0.5), F.col("records")).alias("median_length"))
    names = names.join(F.broadcast(middle))  # one row
    score = F.col("name_length") / (F.col("median_length") + 1) + 2.0 * F.col("non_alpha_fraction") + F.col("name_entropy") / 8.0 + F.col("is_initial_only").cast("double")
    return names.withColumn("weirdness_score", score).drop("median_length")


def name_text_features(c: Catalog) -> DataFrame:
    """One row for each record."""
    names = c.get(name_features).drop("records")
    return c.records.select("id", "canonical_name", "name_display", "name_normalized", "first").join(names, ["name_normalized", "first", "canonical_name"])


def bucket_profiles(c: Catalog) -> DataFrame:
    """Minute counts summed to every bucket size."""
    minutes = c.get(minute_totals).select("minute_bucket", "n_total", "n_pro", "n_con")
    df = f.with_buckets(minutes, "minute_bucket", c.config.buckets).groupBy("bucket_minutes", "bucket_start").agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con")))
    df = df.withColumns({"pro_rate": f.ratio("n_pro", "n_total"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


def day_hour_profiles(c: Catalog) -> DataFrame:
    """Counts by bucket size, day name and hour of the bucket."""
    minutes = c.get(minute_totals).select("minute_bucket", "n_total", "n_pro", "n_con")
    df = f.with_buckets(minutes, "minute_bucket", c.config.buckets)
    df = df.groupBy("bucket_minutes", F.date_format("bucket_start", "EEEE").alias("day_name"), F.hour("bucket_start").alias("hour")).agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con")))
    return f.with_wilson(df.withColumn("pro_rate", f.ratio("n_pro", "n_total")), "n_pro", "n_total", "pro_rate")


def name_lengths(c: Catalog) -> DataFrame:
    return c.records.groupBy(F.length("name_normalized").alias("name_length")).agg(F.count(F.lit(1)).alias("n"))
