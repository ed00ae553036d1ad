"""The scale of rarity is divided as the means that it is compared with."""

import random
from datetime import datetime
from decimal import Decimal

from hustings.operators import triage
from hustings.plans.catalog import Catalog


def test_a_minute_at_the_scale_has_a_share_of_one(spark):
    rng = random.Random(1)
    sums = [(Decimal(rng.randrange(10**12, 10**15)).scaleb(-12), rng.randrange(3, 60)) for _ in range(200)]
    total, n = next((d, n) for d, n in sums if float(d) / n != float(d / n))  # the order of dividing and rounding shows
    c = Catalog(spark, spark.range(0))
    c._built[f"{triage.rarity_by_minute.__module__}.rarity_by_minute"] = spark.createDataFrame([(datetime(2024, 3, 1), total, n)], "minute_bucket timestamp_ntz, rarity decimal(31,12), n_rarity long")
    c._stored[f"{triage.cluster_summary.__module__}.cluster_summary"] = spark.range(3)
    row = triage.window_facts(c).first()
    assert row.rarity_scale == float(total) / n and row.n_clusters == 3
