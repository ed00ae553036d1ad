"""Running totals of decimals keep every digit, and so do their differences."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from hustings.plans.running import running_totals

T0 = datetime(2024, 3, 1)


def test_totals_and_differences_keep_the_last_digit(spark):
    rows = [(T0 + timedelta(hours=7 * k), Decimal(20_723_265_836_946 + k).scaleb(-12)) for k in range(12)]
    got = running_totals(spark.createDataFrame(rows, "t timestamp_ntz, d decimal(31,12)"), "t", ["d"]).orderBy("t").collect()
    assert [r.d for r in got] == [sum(d for _, d in rows[: k + 1]) for k in range(12)]
    totals = spark.createDataFrame([(got[7].d, got[6].d)], "b decimal(37,12), a decimal(37,12)")
    assert totals.select((F.col("b") - F.coalesce("a", F.lit(0))).alias("x")).first().x == rows[7][1]
