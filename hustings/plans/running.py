"""Running totals over time without one task for all rows: within days, and over days before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def running_totals(rows: DataFrame, time: str, columns: list[str]) -> DataFrame:
    """time and for each column the sum of all rows up to that time (rows of one time have the same total).

    Each day is summed by itself; what lies before a day comes from a table of one row a day. Nulls
    count as zero, so integers and decimals add up exactly whatever the order. Totals of decimals have 37 digits and the
    scale of the column: a sum of two with 38 would lose the last digit, and so would a difference of two totals.
    """
    scales = {x.name: x.dataType.scale for x in rows.schema if isinstance(x.dataType, DecimalType)}
    exact = lambda name, x: F.col(name).cast(DecimalType(37, scales[x]))
    day = F.to_date(time).alias("__day")
    rows = rows.select(time, day, *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in columns))
    own, earlier = Window.partitionBy("__day").orderBy(time), Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("__day").agg(*(F.sum(x).alias(x) for x in columns))
    days = days.select("__day", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"__{x}") for x in columns))  # one row a day
    within = rows.select(time, "__day", *(F.sum(x).over(own).alias(x) for x in columns))
    total = lambda x: (exact(x, x) + exact(f"__{x}", x)).cast(DecimalType(37, scales[x])) if x in scales else F.col(x) + F.col(f"__{x}")
    return within.join(days, "__day").select(time, *(total(x).alias(x) for x in columns))
