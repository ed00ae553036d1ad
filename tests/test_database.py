"""Stored submissions over JDBC, from a Derby database that ships with Spark."""

import datetime as dt

from hustings.sources import files

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def test_scan_in_ranges_with_pushed_filter(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    at = dt.datetime(2026, 2, 3, 17, 7)
    rows = [(f"f{k % 2}.csv", k + 1, "" if k % 3 else f"id{k}", f"Doe {k}, Jane", "", "PRO", at + dt.timedelta(minutes=k) if k % 5 else None) for k in range(100)] + [("it's.csv", 7, "", "Roe, Al", "Org", "CON", at)]
    table = spark.createDataFrame(rows, "source_file string, source_row_number long, source_id string, name_raw string, organization_raw string, position_raw string, signed_at timestamp_ntz")
    table.write.format("jdbc").options(url=url, driver=DRIVER, dbtable="subs", createTableColumnTypes="source_file VARCHAR(64), source_id VARCHAR(64), name_raw VARCHAR(64), organization_raw VARCHAR(64), position_raw VARCHAR(64)").save()
    for source in ("f1.csv", None, "it's.csv", "none.csv"):
        df = files.database_submissions(spark, url, "subs", source, partitions=4, driver=DRIVER)
        want = files.stored_submissions(table, source)
        assert df.dtypes == want.dtypes
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    df = files.database_submissions(spark, url, "subs", "f1.csv", partitions=4, driver=DRIVER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "source_file" in pushed.lower() and "f1.csv" in pushed
    assert "numPartitions=4" in plan
