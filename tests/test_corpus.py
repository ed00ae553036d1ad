"""A corpus of stored vectors of two schemas: one scan, back-fill, baselines and lookups."""

import json
import os

import pytest

from hustings.operators import corpus


def put(root, report, name, payload):
    os.makedirs(f"{root}/{report}/summary", exist_ok=True)
    with open(f"{root}/{report}/summary/{name}.json", "w") as file:
        file.write(payload if isinstance(payload, str) else json.dumps(payload, indent=1))


@pytest.fixture(scope="module")
def reports(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("reports"))
    name = lambda who, n, **more: {"canonical_name": who, "display_name": who.title(), "n_records": n} | more
    put(root, "A-1", "feature_vector", {"schema_version": 2, "report_id": "A-1", "metrics": {"total_submissions": 100, "overall_pro_rate": 0.35, "window_high_share": 0.2, "window_top_score": 0.82, "off_hours_ratio": 0.12, "top_name_max_records": 8}, "top_repeated_names": [name("DOE|JANE", 8)], "top_near_dup_clusters": [{"cluster_id": "c1", "cluster_size": 3, "n_records": 7}]})
    put(root, "B 2", "feature_vector", {"report_id": "B 2", "metrics": {"total_submissions": 250, "overall_pro_rate": "0.61", "window_top_score": float("nan")}, "top_repeated_names": [name("SMITH|JOHN", 9), name("DOE|JANE", 15), name(" ", 99)], "top_near_dup_clusters": [{"cluster_id": "c9", "cluster_size": 5, "n_records": 11}]})
    # an old vector without metrics, and a summary to fill it from
    put(root, "C", "feature_vector", {"total_submissions": 40, "overall_pro_rate": 0.5, "window_queue_size": 10, "window_high_count": 4, "extra": {"deep": [1, {"x": 2}]}})
    put(root, "C", "investigation_summary", {"total_submissions": 44, "total_submissions_raw": 50, "total_submissions_exact_row_dedup": 40, "off_hours_summary": {"off_hours_ratio": 0.25}, "top_repeated_names": [{"canonical_name": "ROE|AL", "n": 6}]})
    put(root, "D", "investigation_summary", {"total_submissions": 7, "overall_con_rate": 1, "queue_counts": {"window": 2}, "window_tier_counts": {"high": 1}})  # a summary alone
    put(root, "E", "feature_vector", "{broken")
    put(root, ".hidden", "feature_vector", {"metrics": {"total_submissions": 1}})
    os.makedirs(f"{root}/F")
    return root


def test_vectors_of_all_versions_in_one_scan(spark, reports):
    df = corpus.corpus_vectors(spark, reports)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    got = {r.report_id: r for r in df.collect()}
    assert set(got) == {"A-1", "B 2", "C", "D"}
    assert got["A-1"].metrics["total_submissions"] == 100 and "overall_con_rate" not in got["A-1"].metrics and got["A-1"].metrics["top_cluster_max_records"] == 7
    assert got["B 2"].metrics["overall_pro_rate"] == 0.61 and "window_top_score" not in got["B 2"].metrics and got["B 2"].metrics["top_name_max_records"] == 15
    assert [(n.canonical_name, n.n_records) for n in got["B 2"].names] == [("DOE|JANE", 15), ("SMITH|JOHN", 9)]
    c = got["C"].metrics
    assert (c["total_submissions"], c["window_high_share"], c["off_hours_ratio"], c["dedup_drop_fraction"], c["top_name_max_records"]) == (40, 0.4, 0.25, 0.2, 6)
    d = got["D"].metrics
    assert (d["total_submissions"], d["overall_con_rate"], d["window_queue_size"], d["window_high_share"], d["dedup_drop_fraction"]) == (7, 1, 2, 0.5, 0) and not got["D"].has_vector


def test_baselines_and_lookup(spark, reports, tmp_path):
    vectors = corpus.corpus_vectors(spark, reports).cache()
    rows = {(r.report_id, r.metric): r for r in corpus.metric_comparators(vectors).collect()}
    totals = sorted([100, 250, 40, 7])
    for report, value in (("A-1", 100), ("B 2", 250), ("C", 40), ("D", 7)):
        r = rows[report, "total_submissions"]
        assert r.percentile == (totals.index(value) + 0.5) / 4 and r.n_reports == 4 and r.band_p50 == 70 and r.label == "Total submissions"
    assert ("D", "overall_pro_rate") not in rows and rows["A-1", "overall_pro_rate"].n_reports == 3
    cues = {(r.report_id, r.canonical_name): r for r in corpus.name_cues(vectors).collect()}
    jane = cues["A-1", "DOE|JANE"]
    assert (jane.current_n_records, jane.report_count, jane.report_share, jane.max_n_records_across_reports, jane.max_n_records_percentile) == (8, 2, 0.5, 15, pytest.approx(2.5 / 3))
    clusters = {r.cluster_id: r for r in corpus.cluster_cues(vectors).collect()}
    assert clusters["c9"].n_records_percentile == 0.75 and clusters["c1"].cluster_size_percentile == 0.25

    near, far = str(tmp_path / "out"), str(tmp_path)
    corpus.write_baselines(corpus.baselines(vectors.where("report_id = 'A-1'")), far)
    corpus.write_baselines(corpus.baselines(vectors), far)
    found = corpus.baseline_of(spark, "B 2", [near, far]).first()
    assert found.available and found.report_count == 4 and found.source_path.endswith("v000001") and {m.metric for m in found.metric_comparators} >= {"total_submissions", "overall_pro_rate"}
    os.makedirs(f"{near}/global_baselines")
    corpus.write_baselines(corpus.baselines(vectors.where("report_id = 'B 2'")), near)
    assert corpus.baseline_of(spark, "B 2", [near, far]).first().report_count == 1  # the nearer folder goes first
    none = corpus.baseline_of(spark, "Z", [near, far]).first()
    assert not none.available and none.reason == "global_baselines_unavailable" and none.report_count == 0 and none.metric_comparators == []
    assert corpus.baselines(vectors.limit(0)).count() == 0
