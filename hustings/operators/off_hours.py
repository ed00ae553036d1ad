"""Off-hours control charts: pro rates of windows against what on-hours of the day, or a model, would give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import binomial_p, fit_logit
from hustings.plans.catalog import Catalog

BASELINES = ("day", "global", "model", "primary")
TESTED = ("day", "model", "primary")


def off_minutes(c: Catalog) -> DataFrame:
    """Counts by minute; every bucket size adds them up."""
    off = F.col("is_off_hours")
    p = F.col("position_normalized")
    return c.records.where("timestamp is not null").groupBy("minute_bucket").agg(
        F.count(F.lit(1)).alias("n_total"),
        *f.stance_counts(),
        f.count_where(off).alias("n_off_hours"),
        f.count_where(~off & (p == "Pro")).alias("on_pro"),
        f.count_where(~off & p.isin("Pro", "Con")).alias("on_known"),
    )


def rates(df: DataFrame, c: Catalog, prefix: str = "pro_rate") -> DataFrame:
    df = df.withColumn("n_known", F.col("n_pro") + F.col("n_con"))
    df = df.withColumns({prefix: f.ratio("n_pro", "n_known"), "is_low_power": f.low_power("n_known", c.config.window_min_total)})
    return f.with_wilson(df, "n_pro", "n_known", prefix)


def hourly_distribution(c: Catalog) -> DataFrame:
    df = c.get(off_minutes).groupBy(F.hour("minute_bucket").alias("hour")).agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_unknown", "n_off_hours")))
    return rates(df, c)


def hour_of_week_distribution(c: Catalog) -> DataFrame:
    df = c.get(off_minutes).groupBy(F.date_format("minute_bucket", "EEEE").alias("day_of_week"), F.weekday("minute_bucket").alias("day_of_week_index"), F.hour("minute_bucket").alias("hour")).agg(
        *(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_unknown", "n_off_hours"))
    )
    return rates(df.withColumn("off_hours_fraction", f.ratio("n_off_hours", "n_total")), c)


def date_hour_distribution(c: Catalog) -> DataFrame:
    df = c.get(off_minutes).groupBy(F.date_format("minute_bucket", "yyyy-MM-dd").alias("date"), F.hour("minute_bucket").alias("hour")).agg(
        *(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_unknown", "n_off_hours"))
    )
    return rates(df.withColumn("off_hours_fraction", f.ratio("n_off_hours", "n_total")), c)


def baselines(c: Catalog) -> DataFrame:
    """One row: pro share among known stances overall and in on-hours."""
    return c.get(off_minutes).agg(
        f.ratio(F.sum("n_pro"), F.sum("n_pro") + F.sum("n_con")).alias("overall_rate"), f.ratio(F.sum("on_pro"), F.sum("on_known")).alias("on_rate")
    )


def window_base(c: Catalog) -> DataFrame:
    """Windows of every bucket size with the baseline of their day; thin days take the global on-hours share."""
    df = f.with_buckets(c.get(off_minutes), "minute_bucket", c.config.buckets)
    df = df.groupBy("bucket_minutes", "bucket_start").agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_unknown", "n_off_hours")))
    df = rates(df, c).withColumn("event_date_key", F.date_format("bucket_start", "yyyy-MM-dd"))
    fraction = F.col("n_off_hours") / F.col("n_total")
    df = df.withColumns(
        {
            "day_of_week": F.date_format("bucket_start", "EEEE"),
            "hour": F.hour("bucket_start"),
            "off_hours_fraction": fraction,
            "is_off_hours_window": fraction >= 0.5,
            "is_pure_off_hours_window": F.col("n_off_hours") == F.col("n_total"),
            "is_alert_off_hours_window": fraction >= c.config.alert_off_fraction,
        }
    )
    days = c.get(off_minutes).groupBy(F.date_format("minute_bucket", "yyyy-MM-dd").alias("event_date_key")).agg(F.sum("on_known").alias("day_on_hours_known"), F.sum("on_pro").alias("day_on_hours_pro")).where("day_on_hours_known > 0")
    df = df.join(days, "event_date_key", "left").join(F.broadcast(c.get(baselines)))  # baselines: one row
    everywhere = F.coalesce("on_rate", "overall_rate")
    thin = F.coalesce(F.col("day_on_hours_known") < c.config.window_min_total, F.lit(True))
    source = F.when(F.col("overall_rate").isNull(), "unavailable").when(F.col("on_rate").isNull(), "overall_known").when(thin, "global_on_hours").otherwise("day_on_hours")
    df = df.withColumns(
        {
            "day_on_hours_pro_rate": f.ratio("day_on_hours_pro", "day_on_hours_known"),
            "expected_pro_rate_global": everywhere,
            "expected_pro_rate_day": F.when(thin | F.col("on_rate").isNull(), everywhere).otherwise(f.ratio("day_on_hours_pro", "day_on_hours_known")),
            "baseline_source": source,
        }
    )
    return df.drop("on_rate", "overall_rate")


def model_rates(c: Catalog) -> DataFrame:
    """Expected rates of a binomial fit with day effects and hour harmonics, one fit for each bucket size.

    A fit takes the windows of one bucket size: at most one row a bucket, whatever the records.
    """
    least, waves, minimum = c.config.model_min_rows, c.config.harmonics, c.config.window_min_total

    def design(pdf: pd.DataFrame, days: list[str]) -> np.ndarray:
        angle = 2 * np.pi * pdf["hour"].to_numpy(float) / 24
        parts = [np.ones(len(pdf))]
        for k in range(1, waves + 1):
            parts += [np.sin(k * angle), np.cos(k * angle)]
        parts += [(pdf["event_date_key"] == d).to_numpy(float) for d in days[1:]]
        return np.stack(parts, axis=1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["bucket_minutes", "bucket_start"]].copy()
        out["expected_pro_rate_model"], out["model_status"], out["model_rows"] = np.nan, "", 0
        known = pdf[pdf["n_known"] > 0]
        out["model_rows"] = len(known)
        if known.empty:
            out["model_status"] = "no_known_rows"
        elif len(known) < least:
            out["model_status"] = "too_few_rows"
        elif known["hour"].nunique() < 3:
            out["model_status"] = "too_few_hours"
        else:
            days = sorted(known["event_date_key"].unique())
            y = np.clip((known["n_pro"] / known["n_known"]).to_numpy(float), 1e-6, 1 - 1e-6)
            beta, plain = fit_logit(design(known, days), y, known["n_known"].to_numpy(float))
            out["expected_pro_rate_model"] = 1 / (1 + np.exp(-np.clip(design(pdf, days) @ beta, -30, 30)))
            out["model_status"] = "fit" if plain else "fit_ridge"
        return out

    rows = c.get(window_base).select("bucket_minutes", "bucket_start", "hour", "event_date_key", "n_pro", "n_known")
    return rows.groupBy("bucket_minutes").applyInPandas(fit, "bucket_minutes int, bucket_start timestamp_ntz, expected_pro_rate_model double, model_status string, model_rows long")


def limits(df: DataFrame, name: str) -> DataFrame:
    """Control limits at 95 and 99.8 per cent around an expected rate, z, and which limits the rate breaks."""
    p, n = F.col(f"expected_pro_rate_{name}"), F.col("n_known")
    se = F.when((n > 0) & p.isNotNull(), F.sqrt(p * (1.0 - p) / n))
    new: dict[str, Column] = {}
    for tag, z in (("95", f.Z95), ("998", f.Z998)):
        new[f"control_low_{tag}_{name}"] = F.greatest(p - se * z, F.lit(0.0))
        new[f"control_high_{tag}_{name}"] = F.least(p + se * z, F.lit(1.0))
    df = df.withColumns(new)
    new = {f"delta_pro_rate_{name}": F.col("pro_rate") - p, f"z_score_{name}": F.when(se > 0, (F.col("pro_rate") - p) / se)}
    for tag in ("95", "998"):
        new[f"is_below_{tag}_{name}"] = F.coalesce(F.col("pro_rate") < F.col(f"control_low_{tag}_{name}"), F.lit(False))
        new[f"is_above_{tag}_{name}"] = F.coalesce(F.col("pro_rate") > F.col(f"control_high_{tag}_{name}"), F.lit(False))
    return df.withColumns(new)


def material(df: DataFrame, c: Catalog, name: str) -> DataFrame:
    return df.withColumn(f"is_material_lower_{name}", F.coalesce(F.col(f"delta_pro_rate_{name}") <= -c.config.min_delta, F.lit(False)))


def window_limits(c: Catalog) -> DataFrame:
    """Day and global control charts: all of a window that needs neither model nor tail probabilities."""
    df = c.get(window_base)
    for name in ("day", "global"):
        df = limits(df, name)
    df = material(df, c, "day")
    return df.withColumns({"is_tested": (F.col("n_known") > 0) & F.col("expected_pro_rate_day").isNotNull(), "is_eligible": F.col("is_alert_off_hours_window") & ~F.col("is_low_power")})


TAILS = ("lower", "upper", "two_sided")


def with_tests(df: DataFrame, c: Catalog, names: tuple[str, ...]) -> DataFrame:
    """Exact binomial tails against each baseline, q values over eligible windows of a bucket size, and alerts.

    The q values are found on a narrow table of eligible windows alone and joined back.
    """
    for name in names:
        df = df.withColumn("__p", binomial_p("n_pro", "n_known", f"expected_pro_rate_{name}"))
        df = df.withColumns({f"p_{t}_{name}": F.col(f"__p.{t}") for t in TAILS}).drop("__p")
    q = df.where("is_eligible").select("bucket_minutes", "bucket_start", *(f"p_{t}_{name}" for name in names for t in TAILS))
    for name in names:
        for t in TAILS:
            q = f.with_q(q, f"p_{t}_{name}", f"q_{t}_{name}", ["bucket_minutes"])
    df = df.join(q.select("bucket_minutes", "bucket_start", *(f"q_{t}_{name}" for name in names for t in TAILS)), ["bucket_minutes", "bucket_start"], "left")
    for name in names:
        alert = F.col("is_tested") & F.col("is_eligible") & F.col(f"is_below_998_{name}") & F.coalesce(F.col(f"q_lower_{name}") <= c.config.window_alpha, F.lit(False)) & F.col(f"is_material_lower_{name}")
        df = df.withColumn(f"is_alert_{name}", alert)
    return df


def day_alerts(c: Catalog) -> DataFrame:
    """The chart against the day baseline alone, with tails, q values and alerts."""
    return with_tests(c.get(window_limits), c, ("day",))


def window_control_profile(c: Catalog) -> DataFrame:
    """The whole chart: day, global, model and primary baselines, exact tails, q values and alerts."""
    df = c.get(window_limits).join(c.get(model_rates), ["bucket_minutes", "bucket_start"], "left")
    df = df.withColumns({"expected_pro_rate_model": F.nanvl("expected_pro_rate_model", F.lit(None).cast("double"))})
    df = df.withColumns({"is_model_baseline_available": F.col("expected_pro_rate_model").isNotNull(), "expected_pro_rate_primary": F.coalesce("expected_pro_rate_model", "expected_pro_rate_day")})
    for name in ("model", "primary"):
        df = material(limits(df, name), c, name)
    df = with_tests(df, c, TESTED)
    return df.withColumns({"is_alert_any": F.col("is_alert_day") | F.col("is_alert_model"), "is_alert_both": F.col("is_alert_day") & F.col("is_alert_model")})


def off_hours_totals(c: Catalog) -> DataFrame:
    """One row: volumes and known pro rates in and out of off-hours, with the 2x2 chi-squared statistic."""
    m = c.get(off_minutes).agg(
        F.sum("n_total").alias("n_total"),
        F.sum("n_off_hours").alias("n_off_hours"),
        F.sum("on_known").alias("on_known"),
        F.sum("on_pro").alias("on_pro"),
        (F.sum("n_pro") + F.sum("n_con") - F.sum("on_known")).alias("off_known"),
        (F.sum("n_pro") - F.sum("on_pro")).alias("off_pro"),
    )
    m = m.withColumns({"off_hours_ratio": f.ratio("n_off_hours", "n_total"), "on_pro_rate": f.ratio("on_pro", "on_known"), "off_pro_rate": f.ratio("off_pro", "off_known")})
    m = f.with_wilson(f.with_wilson(m, "on_pro", "on_known", "on_pro_rate"), "off_pro", "off_known", "off_pro_rate")
    n = (F.col("on_known") + F.col("off_known")).cast("double")
    pro = (F.col("on_pro") + F.col("off_pro")).cast("double")
    cross = F.col("on_pro").cast("double") * (F.col("off_known") - F.col("off_pro")) - F.col("off_pro").cast("double") * (F.col("on_known") - F.col("on_pro"))
    margin = pro * (n - pro) * F.col("on_known").cast("double") * F.col("off_known").cast("double")
    return m.withColumn("chi_square", F.when(margin > 0, n * cross * cross / margin).otherwise(0.0))


def date_hour_residuals(c: Catalog) -> DataFrame:
    """Day residuals of windows by bucket size, date and hour."""
    df = c.get(window_limits)
    w = F.col("n_known")
    z = F.col("z_score_day")
    return df.groupBy("bucket_minutes", F.col("event_date_key").alias("date"), "hour").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("n_known").alias("n_known"),
        f.count_where(F.col("is_low_power")).alias("n_low_power_windows"),
        f.ratio(F.sum(F.col("pro_rate") * w), F.sum(F.when(F.col("pro_rate").isNotNull(), w))).alias("pro_rate_weighted"),
        f.ratio(F.sum(F.col("expected_pro_rate_day") * w), F.sum(F.when(F.col("expected_pro_rate_day").isNotNull(), w))).alias("expected_pro_rate_weighted"),
        F.avg(z).alias("mean_z_score"),
        F.percentile(z, F.lit(0.5)).alias("median_z_score"),
        F.max(F.abs(z)).alias("max_abs_z_score"),
    )


def model_fit_diagnostics(c: Catalog) -> DataFrame:
    return c.get(model_rates).groupBy("bucket_minutes").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("model_rows").alias("n_model_rows"), F.min("model_status").alias("model_status"), F.avg((~F.isnan("expected_pro_rate_model")).cast("double")).alias("available_share")
    )


def flag_channel_summary(c: Catalog) -> DataFrame:
    """How many eligible windows of the primary bucket each alert channel flags."""
    df = c.get(window_control_profile).where((F.col("bucket_minutes") == c.config.primary_bucket) & F.col("is_tested") & F.col("is_eligible"))
    channels = ["is_below_95_day", "is_below_998_day", "is_alert_day", "is_alert_model", "is_alert_any", "is_alert_both"]
    counts = df.agg(F.count(F.lit(1)).alias("n_tested"), *(f.count_where(F.col(x)).alias(x) for x in channels))
    long = counts.unpivot(["n_tested"], channels, "channel", "n_flagged")
    return long.withColumns({"flagged_share": f.ratio("n_flagged", "n_tested"), "rank": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_flagged"), "channel"))})  # six rows


def flagged_windows(c: Catalog) -> DataFrame:
    """Windows below the 95 per cent limit of their day that were in off-hours throughout and not thin."""
    return c.get(window_limits).where("is_tested and is_eligible and is_below_95_day")


def alert_runs(c: Catalog, flag: str = "is_below_95_day") -> DataFrame:
    """Runs of flagged windows of one bucket size; a gap of over two buckets or an unflagged window ends a run."""
    df = c.get(window_limits).select("bucket_minutes", "bucket_start", flag, "n_known")
    order = Window.partitionBy("bucket_minutes").orderBy("bucket_start")
    gap = f.minutes_between("bucket_start", F.lag("bucket_start").over(order))
    new = F.coalesce(~F.lag(flag).over(order) | (gap > 2 * F.col("bucket_minutes")), F.lit(True))
    df = df.withColumn("new", (F.col(flag) & new).cast("int")).withColumn("run", F.sum("new").over(order)).where(flag)
    runs = df.groupBy("bucket_minutes", "run").agg(F.min("bucket_start").alias("start_bucket"), F.max("bucket_start").alias("end_bucket"), F.count(F.lit(1)).alias("run_length"), F.sum("n_known").alias("n_known"))
    return runs.withColumn("run_minutes", F.col("run_length") * F.col("bucket_minutes")).drop("run")
