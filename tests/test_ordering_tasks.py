"""The records that one task orders do not grow with the records."""

import re

from hustings.operators import ordering
from hustings.sources.adapters import test_catalog as catalog_of

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_records_and_results_stay(spark, monkeypatch):
    keys = lambda c: sorted(map(tuple, c.get(ordering.bucket_ordering).select("bucket_minutes", "bucket_start", "n_records", "kendall_tau", "is_alphabetical").collect()))
    few = catalog_of(spark, SF)
    want = keys(few)
    monkeypatch.setattr(ordering, "ROWS", 50)
    many = catalog_of(spark, SF)
    n = -(-many.records.where("minute_bucket is not null").count() // 50)
    assert ordering.tasks(many) == n > ordering.tasks(few)
    plan = many.get(ordering.bucket_ordering)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(rf"hashpartitioning\(.*, {n}\), REPARTITION_BY_NUM", plan)) >= 3
    assert keys(many) == want
