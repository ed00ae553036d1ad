"""Names are made of rows once: no filter below repeats the steps that make them."""

from hustings.operators import duplicates, ordering, registry_match
from hustings.sources.adapters import canonical, test_catalog as catalog_of
from hustings.config import Config


def longest_filter(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return max((line.count("regexp_replace") for line in plan.split("\n") if "Filter" in line), default=0)


def test_no_filter_spells_names_out(spark):
    c = catalog_of(spark, "/root/testdata/sf0.001")
    for build in (registry_match.match_uncertainty_summary, registry_match.matched_names, ordering.sortedness_metrics, duplicates.candidate_blocks, duplicates.repeated_names):
        assert longest_filter(c.get(build)) == 0, build.__name__
    for table in (c.registry, *c.frequencies):
        assert longest_filter(table) == 0


def test_blank_names_are_empty_and_take_no_part_in_linkage(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, " , ", "x", "PRO", None), (3, "Doe, Jane", "x", "PRO", None)], "id long, name string, organization string, position string, timestamp timestamp_ntz")
    records = canonical(rows, Config())
    assert sorted((r.id, r.last, r.first, r.canonical_name) for r in records.collect()) == [(1, "", "", "|"), (2, "", "", "|"), (3, "DOE", "JANE", "DOE|JANE")]
    c = catalog_of(spark, "/root/testdata/sf0.001")
    c.records = records
    assert [(r.canonical_name, r.match_tier) for r in registry_match.assignments(c).collect()] == [("DOE|JANE", "unmatched")]
