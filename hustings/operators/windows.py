"""Scans of the minute series: bursts of volume and swings of the pro rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import normal_p, poisson_p
from hustings.operators.profile import counts_per_hour, counts_per_minute
from hustings.plans.catalog import Catalog

# both --------------------------------------------------------------------------------------------


def rolling_windows(c: Catalog) -> DataFrame:
    """Sums of every window of every size on the dense minute grid.

    Running totals come first, in one ordered pass over the minutes (one row a minute, so decades
    are a few million rows); each window is then the difference of two of them.
    """
    minutes = c.get(counts_per_minute).select("minute_bucket", "n_total", "n_pro", "n_con")
    order = Window.orderBy("minute_bucket")
    sums = minutes.select("minute_bucket", F.row_number().over(order).alias("i"), *(F.sum(x).over(order).alias(x) for x in ("n_total", "n_pro", "n_con")))
    ends = sums.withColumn("window_minutes", F.explode(F.array(*map(F.lit, c.config.buckets)))).where("i >= window_minutes").withColumn("j", F.col("i") - F.col("window_minutes"))
    before = sums.select(F.col("i").alias("j"), *(F.col(x).alias(f"{x}_before") for x in ("n_total", "n_pro", "n_con")))
    df = ends.join(before, "j", "left")
    return df.select(
        "window_minutes",
        f.plus_minutes("minute_bucket", 1 - F.col("window_minutes")).alias("start_minute"),
        F.col("minute_bucket").alias("end_minute"),
        *((F.col(x) - F.coalesce(f"{x}_before", F.lit(0))).alias(x) for x in ("n_total", "n_pro", "n_con")),
    )


def overall(c: Catalog) -> DataFrame:
    """One row: mean per minute and overall pro rate."""
    return c.get(counts_per_minute).agg(F.avg("n_total").alias("rate_per_minute"), f.ratio(F.sum("n_pro"), F.sum("n_total")).alias("overall_pro_rate"))


# bursts ------------------------------------------------------------------------------------------


def burst_windows(c: Catalog) -> DataFrame:
    """What can be said of a window without tail probabilities."""
    df = c.get(rolling_windows).withColumnRenamed("n_total", "observed_count").join(F.broadcast(c.get(overall)))  # one row
    df = df.withColumn("expected_count", F.col("rate_per_minute") * F.col("window_minutes"))
    df = df.withColumns({"rate_ratio": f.ratio("observed_count", "expected_count"), "pro_rate": f.ratio("n_pro", "observed_count"), "is_low_power": f.low_power("observed_count", c.config.low_power_min)})
    df = df.withColumn("delta_pro_rate", F.col("pro_rate") - F.col("overall_pro_rate")).withColumn("abs_delta_pro_rate", F.abs("delta_pro_rate"))
    return f.with_wilson(df, "n_pro", "observed_count", "pro_rate").drop("rate_per_minute")


def burst_window_tests(c: Catalog) -> DataFrame:
    """Poisson tail of each window and its q over all sizes together."""
    df = c.get(burst_windows).withColumn("p_value", poisson_p("observed_count", "expected_count"))
    df = f.with_q(df, "p_value", "q_value")
    return df.withColumn("is_significant", F.col("q_value") <= c.config.burst_alpha)


def burst_significant_windows(c: Catalog) -> DataFrame:
    return c.get(burst_window_tests).where("is_significant")


def burst_null_distribution(c: Catalog) -> DataFrame:
    """Largest window sums of simulated Poisson minutes, by size and iteration; every iteration has its own seed."""
    sizes, seed = c.config.buckets, c.config.seed
    facts = c.get(counts_per_minute).agg(F.count(F.lit(1)).alias("n"), F.avg("n_total").alias("rate"))
    jobs = c.spark.range(c.config.iterations).repartition(8).join(F.broadcast(facts))  # one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, n, rate in zip(pdf["id"], pdf["n"], pdf["rate"]):
                total = np.concatenate([[0], np.cumsum(np.random.default_rng((seed, int(i))).poisson(rate, int(n)))])
                out += [(w, int(i), float((total[w:] - total[:-w]).max())) for w in sizes if w <= n]
            yield pd.DataFrame(out, columns=["window_minutes", "iteration", "max_window_count"])

    return jobs.mapInPandas(run, "window_minutes int, iteration long, max_window_count double")


def calibrated(c: Catalog, tests: DataFrame, null: DataFrame, statistic: str, against: str, alpha: float) -> DataFrame:
    """Permutation p of each window against the null maxima of its size, its q, and significance by the policy.

    Policies: parametric_fdr, permutation_fdr, either_fdr. Without simulated maxima the parametric one holds.
    """
    maxima = null.groupBy("window_minutes").agg(F.collect_list(against).alias("null"))  # one row a size, `iterations` numbers
    df = tests.join(F.broadcast(maxima), "window_minutes", "left")
    n = F.coalesce(F.size("null"), F.lit(0))
    p = F.when(n > 0, (F.size(F.filter("null", lambda v: v >= F.col(statistic))) + 1) / (n + 1.0)).otherwise(1.0)
    df = f.with_q(df.withColumns({"permutation_p_value": p, "n_null": n}).drop("null"), "permutation_p_value", "permutation_q_value")
    supported = F.col("permutation_p_value") <= F.greatest(F.lit(alpha), F.lit(0.1), 1.0 / (F.col("n_null") + 1.0))
    df = df.withColumns({"is_permutation_supported": supported, "is_permutation_significant": F.col("permutation_q_value") <= alpha})
    by_policy = {"parametric_fdr": F.col("is_significant"), "permutation_fdr": F.col("is_permutation_significant"), "either_fdr": F.col("is_significant") | F.col("is_permutation_significant")}
    chosen = F.when(F.col("n_null") > 0, by_policy[c.config.significance_policy]).otherwise(F.col("is_significant"))
    return df.withColumn("is_significant_by_policy", chosen)


def burst_calibrated_windows(c: Catalog) -> DataFrame:
    return calibrated(c, c.get(burst_window_tests), c.get(burst_null_distribution), "observed_count", "max_window_count", c.config.burst_alpha)


def swing_calibrated_windows(c: Catalog) -> DataFrame:
    return calibrated(c, c.get(swing_window_tests), c.get(swing_null_distribution), "abs_delta_pro_rate", "max_abs_delta", c.config.swing_alpha)


def hourly_rates(c: Catalog) -> DataFrame:
    """Mean count a minute for each hour of the day; hours never seen have the global mean."""
    seen = c.get(counts_per_minute).groupBy(F.hour("minute_bucket").alias("hour")).agg(F.avg("n_total").alias("rate"))
    spine = c.spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(F.broadcast(seen), "hour", "left").join(F.broadcast(c.get(overall))).select("hour", F.coalesce("rate", "rate_per_minute").alias("rate_per_minute"))


def day_hour_rates(c: Catalog) -> DataFrame:
    """Mean count a minute for each day of the week (0 is Monday) and hour; cells never seen have the global mean."""
    seen = c.get(counts_per_minute).groupBy(F.weekday("minute_bucket").alias("day_of_week"), F.hour("minute_bucket").alias("hour")).agg(F.avg("n_total").alias("rate"))
    spine = c.spark.range(168).select(F.floor(F.col("id") / 24).cast("int").alias("day_of_week"), (F.col("id") % 24).cast("int").alias("hour"))
    cells = spine.join(F.broadcast(seen), ["day_of_week", "hour"], "left").join(F.broadcast(c.get(overall)))  # 168 rows, one row
    return cells.select("day_of_week", "hour", F.coalesce("rate", "rate_per_minute").alias("rate_per_minute"))


def burst_summary(c: Catalog) -> DataFrame:
    t = c.get(burst_window_tests)
    middle = t.where("is_significant").agg(F.percentile("abs_delta_pro_rate", F.lit(0.5)).alias("middle"))
    t = t.join(F.broadcast(middle))  # one row
    shift = F.col("is_significant") & (F.col("abs_delta_pro_rate") >= F.greatest(F.lit(0.10), F.coalesce("middle", F.lit(0.0))))
    return t.agg(
        F.count(F.lit(1)).alias("n_tests"),
        f.count_where(F.col("is_significant")).alias("n_significant_windows"),
        F.max(F.when(F.col("is_significant"), F.col("rate_ratio"))).alias("max_rate_ratio"),
        F.min("q_value").alias("min_q_value"),
        f.count_where(shift).alias("n_composition_shifts"),
    )


# swings ------------------------------------------------------------------------------------------


def baseline(c: Catalog) -> Column:
    return F.least(F.greatest(F.col("overall_pro_rate"), F.lit(1e-6)), F.lit(1.0 - 1e-6))


def swing_windows(c: Catalog) -> DataFrame:
    """Windows with enough rows, their distance from the overall pro rate and its z."""
    df = c.get(rolling_windows).where(F.col("n_total") >= c.config.swing_min_total).join(F.broadcast(c.get(overall)))  # one row
    df = df.withColumns({"pro_rate": f.ratio("n_pro", "n_total"), "baseline_pro_rate": baseline(c)}).drop("rate_per_minute", "overall_pro_rate", "n_con")
    df = df.withColumn("delta_pro_rate", F.col("pro_rate") - F.col("baseline_pro_rate"))
    se = F.sqrt(F.col("baseline_pro_rate") * (1.0 - F.col("baseline_pro_rate")) / F.col("n_total"))
    df = df.withColumns({"abs_delta_pro_rate": F.abs("delta_pro_rate"), "z_score": F.when(se > 0, F.col("delta_pro_rate") / se).otherwise(0.0)})
    df = df.withColumns({"direction": direction("delta_pro_rate"), "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


def direction(delta: str) -> Column:
    return F.when(F.col(delta) >= 0, "pro_heavy").otherwise("con_heavy")


def swing_window_tests(c: Catalog) -> DataFrame:
    df = f.with_q(c.get(swing_windows).withColumn("p_value", normal_p("z_score")), "p_value", "q_value")
    return df.withColumn("is_significant", F.col("q_value") <= c.config.swing_alpha)


def swing_significant_windows(c: Catalog) -> DataFrame:
    return c.get(swing_window_tests).where("is_significant")


def swing_null_distribution(c: Catalog) -> DataFrame:
    """Largest |delta| of windows of simulated binomial minutes at the overall rate."""
    sizes, seed, least = c.config.buckets, c.config.seed, c.config.swing_min_total
    vector = c.get(counts_per_minute).select(F.struct("minute_bucket", "n_total").alias("s")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["n_total"]).alias("v"))
    jobs = c.spark.range(c.config.iterations).repartition(8).join(F.broadcast(vector.join(F.broadcast(c.get(overall)))))  # one row: a number for each minute

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, v, p in zip(pdf["id"], pdf["v"], pdf["overall_pro_rate"]):
                v = np.asarray(v, np.int64)
                pro = np.random.default_rng((seed, int(i))).binomial(v, min(max(p, 1e-6), 1 - 1e-6))
                a, b = (np.concatenate([[0], np.cumsum(x)]) for x in (v, pro))
                for w in sizes:
                    if w > len(v):
                        continue
                    n, k = a[w:] - a[:-w], b[w:] - b[:-w]
                    ok = n >= least
                    out.append((w, int(i), float(np.abs(k[ok] / n[ok] - p).max()) if ok.any() else 0.0))
            yield pd.DataFrame(out, columns=["window_minutes", "iteration", "max_abs_delta"])

    return jobs.mapInPandas(run, "window_minutes int, iteration long, max_abs_delta double")


def pro_rate_by_hour(c: Catalog) -> DataFrame:
    return c.get(counts_per_hour)


def stable_bands(df: DataFrame, rate: str, keys: list[str], least_half: float) -> DataFrame:
    """Median of the rates of each group, 2.5 robust deviations (at least `least_half`) around it, cut to [0, 1]."""
    centre = df.groupBy(*keys).agg(F.percentile(rate, F.lit(0.5)).alias("centre"))
    spread = df.join(centre, keys).groupBy(*keys).agg(F.first("centre").alias("stable_center"), F.percentile(F.abs(F.col(rate) - F.col("centre")), F.lit(0.5)).alias("mad"))
    half = F.when(F.col("stable_center").isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(least_half), F.col("mad") * 1.4826 * 2.5))
    out = spread.withColumns({"stable_half_width": half, "stable_center": F.coalesce("stable_center", F.lit(0.5))})
    return out.withColumns({"stable_lower": F.greatest(F.lit(0.0), F.col("stable_center") - F.col("stable_half_width")), "stable_upper": F.least(F.lit(1.0), F.col("stable_center") + F.col("stable_half_width"))}).drop("mad")


def enriched(c: Catalog, df: DataFrame, least_half: float = 0.05) -> DataFrame:
    """Rates, z against the overall rate, and the stable band of the bucket size."""
    df = df.withColumn("n_con", F.col("n_total") - F.col("n_pro")).join(F.broadcast(c.get(overall).select(baseline(c).alias("baseline_pro_rate"))))  # one row
    df = df.withColumn("pro_rate", f.ratio("n_pro", "n_total")).withColumn("delta_pro_rate", F.col("pro_rate") - F.col("baseline_pro_rate"))
    se = F.sqrt(F.col("baseline_pro_rate") * (1.0 - F.col("baseline_pro_rate")) / F.col("n_total"))
    df = df.withColumns(
        {
            "abs_delta_pro_rate": F.abs("delta_pro_rate"),
            "z_score": F.when((F.col("n_total") > 0) & F.col("delta_pro_rate").isNotNull(), F.col("delta_pro_rate") / se).otherwise(0.0),
            "direction": direction("delta_pro_rate"),
            "is_low_power": f.low_power("n_total", c.config.low_power_min),
        }
    )
    df = f.with_wilson(df, "n_pro", "n_total", "pro_rate")
    df = df.join(stable_bands(df, "pro_rate", ["bucket_minutes"], least_half), "bucket_minutes")
    outside = F.coalesce((F.col("pro_rate") < F.col("stable_lower")) | (F.col("pro_rate") > F.col("stable_upper")), F.lit(False))
    return df.withColumn("outside_stable_range", outside)


def tested(c: Catalog, df: DataFrame) -> DataFrame:
    """Normal p, q within the bucket size, and the flag: outside the band and significant or far off."""
    df = df.withColumn("p_value", F.when(F.col("n_total") > 0, normal_p("z_score")).otherwise(1.0))
    df = f.with_q(df, "p_value", "q_value", ["bucket_minutes"]).withColumn("is_significant", F.col("q_value") <= c.config.swing_alpha)
    far = F.col("abs_delta_pro_rate") >= F.greatest(F.lit(0.10), F.col("stable_half_width"))
    return df.withColumn("is_flagged", F.col("outside_stable_range") & (F.col("is_significant") | F.coalesce(far, F.lit(False))))


def grid_buckets(c: Catalog) -> DataFrame:
    minutes = c.get(counts_per_minute).select("minute_bucket", "n_total", "n_pro")
    df = f.with_buckets(minutes, "minute_bucket", c.config.swing_profile_buckets)
    return df.groupBy("bucket_minutes", "bucket_start").agg(F.sum("n_total").alias("n_total"), F.sum("n_pro").alias("n_pro"))


def slot_label(slot: str) -> Column:
    start = F.col(slot) * F.col("bucket_minutes")
    return F.format_string("%02d:%02d", F.floor(start / 60).cast("int"), (start % 60).cast("int"))


def time_bucket_bands(c: Catalog) -> DataFrame:
    return enriched(c, c.get(grid_buckets))


def time_bucket_profiles(c: Catalog) -> DataFrame:
    return tested(c, c.get(time_bucket_bands))


def time_of_day_bands(c: Catalog) -> DataFrame:
    slot = F.floor(f.minute_of_day("bucket_start") / F.col("bucket_minutes")).cast("int")
    df = c.get(grid_buckets).groupBy("bucket_minutes", slot.alias("slot")).agg(F.sum("n_total").alias("n_total"), F.sum("n_pro").alias("n_pro"))
    return enriched(c, df.withColumn("slot_start", slot_label("slot")))


def time_of_day_bucket_profiles(c: Catalog) -> DataFrame:
    return tested(c, c.get(time_of_day_bands))


def day_bucket_bands(c: Catalog) -> DataFrame:
    """Buckets of each day against what their slot of the day has over all days."""
    slot = F.floor(f.minute_of_day("bucket_start") / F.col("bucket_minutes")).cast("int")
    df = c.get(grid_buckets).withColumns({"date": F.date_format("bucket_start", "yyyy-MM-dd"), "slot": slot})
    df = enriched(c, df.withColumn("slot_start", slot_label("slot")), 0.07)
    slots = c.get(time_of_day_bands).select("bucket_minutes", "slot", F.col("pro_rate").alias("slot_expected_pro_rate"), F.col("stable_half_width").alias("slot_half_width"))
    df = df.join(slots, ["bucket_minutes", "slot"], "left").withColumn("slot_delta_pro_rate", F.col("pro_rate") - F.col("slot_expected_pro_rate"))
    p = F.col("slot_expected_pro_rate")
    se = F.sqrt(p * (1.0 - p) / F.col("n_total"))
    return df.withColumn("slot_z_score", F.when((F.col("n_total") > 0) & (se > 0), F.col("slot_delta_pro_rate") / se).otherwise(0.0))


def day_bucket_profiles(c: Catalog) -> DataFrame:
    df = tested(c, c.get(day_bucket_bands)).withColumn("slot_p_value", F.when(F.col("n_total") > 0, normal_p("slot_z_score")).otherwise(1.0))
    df = f.with_q(df, "slot_p_value", "slot_q_value", ["bucket_minutes"])
    far = F.abs("slot_delta_pro_rate") >= F.greatest(F.lit(0.10), F.col("slot_half_width"))
    return df.withColumn("is_slot_outlier", (F.col("slot_q_value") <= c.config.swing_alpha) & F.coalesce(far, F.lit(False)) & ~F.col("is_low_power"))


def direction_runs(c: Catalog) -> DataFrame:
    """Runs of buckets on one side of the overall rate; neutral or empty buckets break a run."""
    d = F.coalesce("delta_pro_rate", F.lit(0.0))
    df = c.get(time_bucket_bands).withColumn("side", F.when(F.abs(d) <= 1e-9, "neutral").when(d > 0, "pro_heavy").otherwise("con_heavy"))
    order = Window.partitionBy("bucket_minutes").orderBy("bucket_start")
    df = df.withColumn("new", (F.col("side") != F.coalesce(F.lag("side").over(order), F.lit(""))).cast("int")).withColumn("run", F.sum("new").over(order))
    runs = df.where("side <> 'neutral'").groupBy("bucket_minutes", "run", F.col("side").alias("direction")).agg(
        F.min("bucket_start").alias("start_bucket"),
        F.max("bucket_start").alias("end_bucket"),
        F.count(F.lit(1)).alias("run_length"),
        F.sum("n_total").alias("n_total"),
        F.avg("delta_pro_rate").alias("mean_delta_pro_rate"),
        F.avg("abs_delta_pro_rate").alias("mean_abs_delta_pro_rate"),
        F.max("abs_delta_pro_rate").alias("max_abs_delta_pro_rate"),
    )
    number = F.row_number().over(Window.partitionBy("bucket_minutes").orderBy("start_bucket"))
    return runs.withColumn("run_id", F.concat(F.col("bucket_minutes").cast("string"), F.lit("m-r"), number.cast("string"))).withColumn("is_long_run", F.col("run_length") >= 3).drop("run")


def direction_runs_summary(c: Catalog) -> DataFrame:
    return c.get(direction_runs).groupBy("bucket_minutes").agg(
        F.count(F.lit(1)).alias("n_runs"),
        f.count_where(F.col("is_long_run")).alias("n_long_runs"),
        F.max("run_length").alias("max_run_length"),
        F.avg("run_length").alias("mean_run_length"),
        F.avg(F.col("is_long_run").cast("double")).alias("long_run_ratio"),
    )
