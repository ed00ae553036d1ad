"""Changepoints, multivariate anomalies and the composite score that joins all signals by minute."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import isolation_scores, pelt
from hustings.operators.organisations import blank_minutes
from hustings.operators.profile import counts_per_minute
from hustings.operators.rare import rarity_high_windows, unique_ratio_windows
from hustings.operators.windows import burst_significant_windows, swing_significant_windows
from hustings.plans.catalog import Catalog

# changepoints ------------------------------------------------------------------------------------


def fallback(x: np.ndarray, span: int) -> list[int]:
    """Where the mean of the next `span` minutes differs most from that of the last: far above the usual, spaced by `span`.

    What is usual covers the whole vector; minutes nearer than `span` to an end differ by nothing.
    """
    if len(x) < 2 * span or np.allclose(x, x[0]):
        return []
    s = np.concatenate([[0], np.cumsum(x)])
    at = np.arange(span, len(x) - span)
    score = np.zeros(len(x))
    score[at] = np.abs((s[at + span] - s[at]) - (s[at] - s[at - span])) / span
    limit = score.mean() + 2.5 * score.std()
    out: list[int] = []
    for k in np.flatnonzero((score >= limit) & (score > 0)).tolist():
        if not out or k - out[-1] >= span:
            out.append(k)
    return out


def all_changepoints(c: Catalog) -> DataFrame:
    """Level shifts of volume and pro rate. The minute vector is one row a minute and goes through one task a metric."""
    span, weight = c.config.min_segment, c.config.penalty
    minutes = c.get(counts_per_minute)
    total = minutes.agg(f.ratio(F.sum("n_pro"), F.sum("n_total")).alias("overall"))
    rows = minutes.join(F.broadcast(total)).select("minute_bucket", F.explode(F.array(F.struct(F.lit("volume").alias("metric"), F.col("n_total").cast("double").alias("x")), F.struct(F.lit("pro_rate").alias("metric"), F.coalesce("pro_rate", "overall", F.lit(0.0)).alias("x")))).alias("m")).select("m.metric", "minute_bucket", "m.x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute_bucket")
        x = pdf["x"].to_numpy(float)
        found = pelt(x, weight * max(float(x.var()), 1.0) * np.log(max(len(x), 2)), span) if len(x) >= 2 * span else []
        found = found or fallback(x, span)
        out = []
        for k in found:
            a, b = x[max(0, k - span) : k].mean(), x[k : k + span].mean()
            out.append((pdf["metric"].iloc[0], pdf["minute_bucket"].iloc[k], float(a), float(b), float(b - a), float(abs(b - a))))
        return pd.DataFrame(out, columns=["metric", "change_minute", "mean_before", "mean_after", "delta", "abs_delta"])

    return rows.groupBy("metric").applyInPandas(run, "metric string, change_minute timestamp_ntz, mean_before double, mean_after double, delta double, abs_delta double")


def volume_changepoints(c: Catalog) -> DataFrame:
    return c.get(all_changepoints).where("metric = 'volume'")


def pro_rate_changepoints(c: Catalog) -> DataFrame:
    return c.get(all_changepoints).where("metric = 'pro_rate'")


# multivariate ------------------------------------------------------------------------------------


def anomaly_features(c: Catalog) -> DataFrame:
    """Features of buckets on the dense grid, with differences from the bucket before."""
    sizes = tuple(sorted({c.config.anomaly_bucket, 240}))
    minutes = c.get(counts_per_minute).select("minute_bucket", "n_total", "n_pro", "n_con", F.col("n_unique_names").alias("n_unique"))
    blank = c.get(blank_minutes).groupBy("minute_bucket").agg(F.sum("n_blank_org").alias("n_blank_org"))
    minutes = minutes.join(blank, "minute_bucket", "left").na.fill(0, ["n_blank_org"])
    df = f.with_buckets(minutes, "minute_bucket", sizes).groupBy("bucket_minutes", "bucket_start").agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_unique", "n_blank_org")))
    # a volume-weighted mean of 1 - unique / total over minutes is 1 - sum(unique) / sum(total)
    df = df.withColumns({"dup_name_fraction_weighted": F.coalesce(1.0 - f.ratio("n_unique", "n_total"), F.lit(0.0)), "pro_rate": f.ratio("n_pro", "n_total"), "blank_org_rate": f.ratio("n_blank_org", "n_total"), "log_n_total": F.log1p("n_total")}).drop("n_unique")
    order = Window.partitionBy("bucket_minutes").orderBy("bucket_start")
    df = df.withColumns({"delta_log_n_total": F.coalesce(F.col("log_n_total") - F.lag("log_n_total").over(order), F.lit(0.0)), "delta_pro_rate": F.coalesce(F.col("pro_rate") - F.lag("pro_rate").over(order), F.lit(0.0))})
    df = df.withColumns({"abs_delta_pro_rate": F.abs("delta_pro_rate"), "is_model_eligible": F.col("n_total") >= c.config.anomaly_min_total, "is_low_power": f.low_power("n_total", c.config.low_power_min)})
    return f.with_wilson(df, "n_pro", "n_total", "pro_rate")


FEATURES = ["log_n_total", "dup_name_fraction_weighted", "pro_rate", "blank_org_rate", "delta_log_n_total", "abs_delta_pro_rate"]


def robust_features(c: Catalog) -> DataFrame:
    """Eligible buckets with features centred on the median and scaled by the 10-90 range; gaps take the median."""
    df = c.get(anomaly_features).where("is_model_eligible")
    facts = df.groupBy("bucket_minutes").agg(*(F.percentile(x, [0.1, 0.5, 0.9]).alias(f"q_{x}") for x in FEATURES))
    df = df.join(facts, "bucket_minutes")

    def one(x: str) -> Column:
        q = F.col(f"q_{x}")
        width = q[2] - q[0]
        return (F.coalesce(F.col(x), q[1]) - q[1]) / F.when(width > 0, width).otherwise(1.0)

    return df.select("bucket_minutes", "bucket_start", *(one(x).alias(f"scaled_{x}") for x in FEATURES))


def bucket_anomaly_scores(c: Catalog) -> DataFrame:
    """Isolation forest over eligible buckets of one size (eight at least), one task for each size."""
    share, seed = c.config.anomaly_share, c.config.seed
    columns = [f"scaled_{x}" for x in FEATURES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket_start")
        out = pdf[["bucket_minutes", "bucket_start"]].copy()
        if len(pdf) < 8:
            out["anomaly_score"], out["anomaly_score_percentile"], out["is_anomaly"] = np.nan, np.nan, False
            return out
        s = isolation_scores(pdf[columns].to_numpy(float), seed=seed)
        out["anomaly_score"] = s - np.quantile(s, 1 - share)
        out["anomaly_score_percentile"] = pd.Series(s).rank(pct=True).to_numpy()
        out["is_anomaly"] = out["anomaly_score"] > 0
        return out

    scores = c.get(robust_features).groupBy("bucket_minutes").applyInPandas(run, "bucket_minutes int, bucket_start timestamp_ntz, anomaly_score double, anomaly_score_percentile double, is_anomaly boolean")
    return c.get(anomaly_features).join(scores, ["bucket_minutes", "bucket_start"], "left").na.fill(False, ["is_anomaly"])


def top_bucket_anomalies(c: Catalog) -> DataFrame:
    """A report: flagged buckets, or the best scored of a size without any; `anomaly_top` over all."""
    df = c.get(bucket_anomaly_scores).where("anomaly_score is not null and not isnan(anomaly_score)")
    any_flag = F.max(F.col("is_anomaly").cast("int")).over(Window.partitionBy("bucket_minutes"))
    return df.withColumn("any", any_flag).where("is_anomaly or any = 0").drop("any").orderBy(F.desc("anomaly_score"), "bucket_minutes", "bucket_start").limit(c.config.anomaly_top)


# composite ---------------------------------------------------------------------------------------


def painted(windows: DataFrame, value: str, out: str) -> DataFrame:
    """Minutes inside any window (at most 240 long) with the smallest value there: windows become minutes, then join on equality."""
    span = F.sequence(F.lit(0), f.minutes_between("end_minute", "start_minute").cast("int"))
    minutes = windows.select(F.explode(span).alias("k"), "start_minute", value)
    return minutes.select(f.plus_minutes("start_minute", F.col("k")).alias("minute_bucket"), value).groupBy("minute_bucket").agg(F.min(value).alias(out))


def base_signals(c: Catalog) -> DataFrame:
    """Volume and duplicate ranks of every minute: the part that needs no other detector."""
    df = c.get(counts_per_minute).select("minute_bucket", "n_total", "n_pro", "n_con", "dup_name_fraction", "pro_rate")
    df = df.withColumn("volume_percentile", f.average_rank_share("n_total"))
    return df.withColumn("dup_percentile", f.average_rank_share("dup_name_fraction"))


def ranked_minutes(c: Catalog) -> DataFrame:
    """Every minute with its signals and score; window starts alone carry the name signals, as in the reference semantics."""
    df = c.get(base_signals)
    for windows, tag in ((c.get(burst_significant_windows), "burst"), (c.get(swing_significant_windows), "swing")):
        df = df.join(painted(windows, "q_value", f"{tag}_min_q"), "minute_bucket", "left").withColumn(f"{tag}_signal", F.col(f"{tag}_min_q").isNotNull())
    near = c.get(all_changepoints).select(F.explode(F.sequence(F.lit(-15), F.lit(15))).alias("k"), "change_minute").select(f.plus_minutes("change_minute", F.col("k")).alias("minute_bucket")).distinct().withColumn("changepoint_signal", F.lit(True))
    unique = c.get(unique_ratio_windows).select(F.col("bucket_start").alias("minute_bucket")).distinct().withColumn("unique_signal", F.lit(True))
    rare = c.get(rarity_high_windows).select(F.col("bucket_start").alias("minute_bucket")).distinct().withColumn("rarity_signal", F.lit(True))
    for extra in (near, unique, rare):
        df = df.join(extra, "minute_bucket", "left")
    ml = c.get(bucket_anomaly_scores).where(F.col("bucket_minutes") == c.config.anomaly_bucket).select(F.col("bucket_start").alias("anomaly_bucket"), F.col("anomaly_score_percentile").alias("ml_percentile"), F.col("is_anomaly").alias("ml_signal"))
    df = df.withColumn("anomaly_bucket", f.floor_bucket("minute_bucket", c.config.anomaly_bucket)).join(ml, "anomaly_bucket", "left").drop("anomaly_bucket")
    flags = ["burst_signal", "swing_signal", "changepoint_signal", "unique_signal", "rarity_signal", "ml_signal"]
    df = df.na.fill(False, flags).withColumn("ml_percentile", F.coalesce(F.nanvl("ml_percentile", F.lit(0.0)), F.lit(0.0)))
    on = {x: F.col(x).cast("double") for x in flags}
    score = (
        F.col("volume_percentile") * 0.26
        + F.col("dup_percentile") * 0.18
        + on["burst_signal"] * 0.14
        + on["swing_signal"] * 0.14
        + on["changepoint_signal"] * 0.09
        + on["unique_signal"] * 0.05
        + on["rarity_signal"] * 0.05
        + F.col("ml_percentile") * 0.09
    )
    count = sum((F.col(x).cast("int") for x in flags), F.lit(0))
    names = F.concat_ws(",", *(F.when(F.col(x), F.lit(x.removesuffix("_signal"))) for x in flags))
    return df.withColumns({"composite_score": score, "evidence_count": count, "evidence_flags": names})


def ranked_windows(c: Catalog) -> DataFrame:
    """A report: the 500 minutes with the highest score."""
    return c.get(ranked_minutes).orderBy(F.desc("composite_score"), "minute_bucket").limit(500)


def high_priority_windows(c: Catalog) -> DataFrame:
    return c.get(ranked_minutes).where("composite_score >= 0.85").orderBy(F.desc("composite_score"), "minute_bucket").limit(500)


def evidence_bundle_windows(c: Catalog) -> DataFrame:
    return c.get(ranked_minutes).where("evidence_count > 0").orderBy(F.desc("evidence_count"), F.desc("composite_score"), "minute_bucket").limit(500)
