"""Interval-overlap join on time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(time: str, minutes: int) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time)) / F.lit(60 * minutes)).cast("long")


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], minutes: int = 240) -> DataFrame:
    """Pairs of rows whose closed intervals share a time, each pair once; column names must differ.

    Both sides are dealt to the bins of `minutes` that they touch and meet by equality of the bin, which
    Spark hashes or sorts (and splits where one bin is frequent); a pair that meets in several bins is kept in
    the first, where the later of both starts lies. A bin is best near the usual length of the shorter side: wider
    ones compare rows that do not meet, narrower ones copy rows. Intervals with a null end, or that end before
    they start, meet nothing.
    """
    (a, b), (c, d) = left_span, right_span

    def dealt(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(_bin(start, minutes), _bin(end, minutes))))

    met = dealt(left, a, b, "__l").join(dealt(right, c, d, "__r"), F.col("__l") == F.col("__r"))
    met = met.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("__l") == F.greatest(_bin(a, minutes), _bin(c, minutes))))
    return met.drop("__l", "__r")
