"""Regular spacing in time: autocorrelation, spectrum, the clock face and rolling dispersion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import chi2_sf
from hustings.operators.profile import counts_per_minute
from hustings.plans.catalog import Catalog
from hustings.plans.running import running_totals


def series(c: Catalog) -> DataFrame:
    """The minute series with an index: one row a minute, so even decades are a few million rows."""
    df = c.get(counts_per_minute).select("minute_bucket", F.col("n_total").cast("double").alias("x"))
    origin = df.agg(F.min("minute_bucket").alias("t0"))
    return df.join(F.broadcast(origin)).select(f.minutes_between("minute_bucket", "t0").cast("long").alias("i"), "minute_bucket", "x")  # origin: one row


def autocorr(c: Catalog) -> DataFrame:
    """Pearson correlation of the series with itself at each lag; 0 where either side does not vary."""
    s = c.get(series)
    lagged = s.select(F.explode(F.sequence(F.lit(1), F.lit(c.config.max_lag))).alias("lag_minutes"), "i", F.col("x").alias("left"))
    right = s.select(F.col("i").alias("j"), F.col("x").alias("right"))
    pairs = lagged.join(right, F.col("j") == F.col("i") + F.col("lag_minutes"))
    varies = (F.count(F.lit(1)) > 1) & (F.max("left") > F.min("left")) & (F.max("right") > F.min("right"))
    df = pairs.groupBy("lag_minutes").agg(F.when(varies, F.corr("left", "right")).otherwise(0.0).alias("autocorr"))
    return df.withColumn("autocorr", F.coalesce("autocorr", F.lit(0.0))).withColumn("abs_autocorr", F.abs("autocorr"))


def _vector(batches: Iterator[pd.DataFrame]) -> np.ndarray:
    rows = pd.concat(list(batches))
    return rows.sort_values("i")["x"].to_numpy(float) if len(rows) else np.zeros(0)


def spectrum(c: Catalog) -> DataFrame:
    """Power at every frequency whose period is in range; the minute vector is one row a minute and fits one task."""
    low, high = c.config.period_range

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = _vector(batches)
        if len(x) < 3:
            return
        power = np.abs(np.fft.rfft(x - x.mean())) ** 2
        k = np.arange(1, len(power))
        period = len(x) / k
        ok = (period >= low) & (period <= high)
        yield pd.DataFrame({"frequency_index": k[ok], "frequency_per_minute": k[ok] / len(x), "period_minutes": period[ok], "power": power[1:][ok]})

    return c.get(series).select("i", "x").coalesce(1).mapInPandas(run, "frequency_index long, frequency_per_minute double, period_minutes double, power double")


def spectrum_top(c: Catalog) -> DataFrame:
    return c.get(spectrum).orderBy(F.desc("power"), "frequency_index").limit(c.config.top_periods)


def null_distribution(c: Catalog) -> DataFrame:
    """Largest |autocorrelation| and power of shuffled series; each iteration has its own seed and task share."""
    low, high, lags, seed = *c.config.period_range, c.config.max_lag, c.config.seed
    vector = c.get(series).select("i", "x").groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.transform("v", lambda s: s["x"]).alias("v"))
    jobs = c.spark.range(c.config.iterations).repartition(8).join(F.broadcast(vector))  # vector: one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["v"]):
                x = np.random.default_rng((seed, int(i))).permutation(np.asarray(v, float))
                if len(x) < 3:
                    continue
                y = x - x.mean()
                n = 1 << (2 * len(y) - 1).bit_length()
                acf = np.fft.irfft(np.abs(np.fft.rfft(y, n)) ** 2)[1 : min(lags, len(y) - 1) + 1]
                power = np.abs(np.fft.rfft(y)) ** 2
                period = len(y) / np.arange(1, len(power))
                ok = (period >= low) & (period <= high)
                out.append((int(i), float(np.abs(acf).max() / max((y**2).sum(), 1e-12)), float(power[1:][ok].max()) if ok.any() else 0.0))
            yield pd.DataFrame(out, columns=["iteration", "max_abs_autocorr", "max_power"])

    return jobs.mapInPandas(run, "iteration long, max_abs_autocorr double, max_power double")


def _permuted(observed: DataFrame, null: DataFrame, statistic: str, against: str, c: Catalog) -> DataFrame:
    """Empirical p (share of null maxima at least as large, one added to both) and its q."""
    maxima = null.agg(F.collect_list(against).alias("null"))  # one row of `iterations` numbers
    df = observed.join(F.broadcast(maxima))
    df = df.withColumn("permutation_p", (F.size(F.filter("null", lambda v: v >= F.col(statistic))) + 1) / (F.size("null") + 1.0)).drop("null")
    return f.with_q(df, "permutation_p", "permutation_q").withColumn("is_significant", F.col("permutation_q") <= 0.05)


def autocorr_significant(c: Catalog) -> DataFrame:
    return _permuted(c.get(autocorr), c.get(null_distribution), "abs_autocorr", "max_abs_autocorr", c)


def spectrum_significant(c: Catalog) -> DataFrame:
    return _permuted(c.get(spectrum_top), c.get(null_distribution), "power", "max_power", c)


def clockface_distribution(c: Catalog) -> DataFrame:
    counts = c.get(counts_per_minute).groupBy(F.minute("minute_bucket").alias("minute_of_hour")).agg(F.sum("n_total").alias("n"))
    spine = c.spark.range(60).select(F.col("id").cast("int").alias("minute_of_hour"))
    df = spine.join(F.broadcast(counts), "minute_of_hour", "left").select("minute_of_hour", F.coalesce("n", F.lit(0)).alias("n_events"))
    total = F.sum("n_events").over(Window.partitionBy(F.lit(1)))  # 60 rows
    df = df.withColumn("expected_n_events_uniform", total / 60.0)
    df = df.withColumn("deviation_from_uniform", F.col("n_events") - F.col("expected_n_events_uniform"))
    e = F.col("expected_n_events_uniform")
    return df.withColumns({"share": F.coalesce(f.ratio("n_events", e * 60.0), F.lit(0.0)), "z_score_uniform": F.when(e > 0, F.col("deviation_from_uniform") / F.sqrt(e)).otherwise(0.0)})


def clockface_test(c: Catalog) -> DataFrame:
    """Chi-squared of the clock face against uniform, 59 degrees of freedom."""
    stat = c.get(clockface_distribution).agg(F.coalesce(F.sum(F.when(F.col("expected_n_events_uniform") > 0, F.pow("deviation_from_uniform", F.lit(2)) / F.col("expected_n_events_uniform"))), F.lit(0.0)).alias("chi_square"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(p_value=[chi2_sf(x, 59) for x in pdf["chi_square"]])

    return stat.mapInPandas(run, "chi_square double, p_value double")


def clockface_top_minutes(c: Catalog) -> DataFrame:
    return c.get(clockface_distribution).orderBy(F.desc("n_events"), "minute_of_hour").limit(min(c.config.top_periods, 60))


def clockface_null(c: Catalog) -> DataFrame:
    """Chi-squared and largest minute of clock faces drawn evenly from the total, an iteration a row."""
    seed = c.config.seed
    total = c.get(clockface_distribution).agg(F.sum("n_events").alias("n"))
    jobs = c.spark.range(c.config.iterations).repartition(8).join(F.broadcast(total))  # one row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, n in zip(pdf["id"], pdf["n"]):
                x = np.random.default_rng((seed, 60, int(i))).multinomial(int(n), np.full(60, 1 / 60))
                out.append((int(i), float(((x - n / 60) ** 2).sum() / max(n / 60, 1e-12)), int(x.max())))
            yield pd.DataFrame(out, columns=["iteration", "chi_square", "max_minute_events"])

    return jobs.mapInPandas(run, "iteration long, chi_square double, max_minute_events long")


def rolling_fano(c: Catalog) -> DataFrame:
    """Variance over mean in every window. Counts are whole numbers, so sums and sums of squares are differences of exact running totals, and the variance is (w * S2 - S1 * S1) / w**2."""
    whole = lambda x: F.col(x).cast("decimal(38,0)")
    s = c.get(series).select("i", "minute_bucket", whole("x").alias("s1"), (whole("x") * whole("x")).cast("decimal(38,0)").alias("s2"))
    totals = running_totals(s.drop("i"), "minute_bucket", ["s1", "s2"])
    ends = totals.join(s.select("minute_bucket", "i"), "minute_bucket").withColumn("window_minutes", F.explode(F.array(*map(F.lit, c.config.fano_windows)))).where("i >= window_minutes - 1")
    ends = ends.withColumn("before", f.plus_minutes("minute_bucket", -F.col("window_minutes")))
    df = ends.join(totals.select(F.col("minute_bucket").alias("before"), F.col("s1").alias("a1"), F.col("s2").alias("a2")), "before", "left")
    w, s1, s2 = F.col("window_minutes"), (F.col("s1") - F.coalesce("a1", F.lit(0))).cast("decimal(38,0)"), (F.col("s2") - F.coalesce("a2", F.lit(0))).cast("decimal(38,0)")
    df = df.select("window_minutes", f.plus_minutes("minute_bucket", 1 - w).alias("start_minute"), F.col("minute_bucket").alias("end_minute"), w.alias("n_points"), (s1.cast("double") / w).alias("mean_count"), ((w * s2 - s1 * s1).cast("double") / (w * w).cast("double")).alias("variance_count"))
    df = df.withColumn("fano_factor", F.when(F.col("mean_count") > 0, F.col("variance_count") / F.col("mean_count")).otherwise(0.0))
    return df.withColumn("is_high_fano", F.col("fano_factor") >= c.config.high_fano)


def rolling_fano_summary(c: Catalog) -> DataFrame:
    x = F.col("fano_factor")
    return c.get(rolling_fano).groupBy("window_minutes").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.percentile(x, F.lit(0.5)).alias("median_fano_factor"),
        F.percentile(x, F.lit(0.95)).alias("p95_fano_factor"),
        F.max(x).alias("max_fano_factor"),
        F.avg(F.col("is_high_fano").cast("double")).alias("high_fano_ratio"),
    )
