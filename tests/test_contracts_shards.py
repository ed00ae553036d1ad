"""Contracts with quarantine, shards with manifests, and what reads them back."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation

from hustings.functions import core
from hustings.plans import contracts
from hustings.sources import shards, store

SIGNAL = "signal_id string, evidence_kind string, signal_score double, support_n long, effect_size double, p_value double, q_value double, explanation_hint string"
NAN, INF = float("nan"), float("inf")
GOOD = [("a", "stat_fdr", 0.0, 0, None, 1.0, 0.0, None), ("b", "heuristic", 1.0, 5, -2.5, None, None, "none"), ("b", "heuristic", 1.0, 5, -2.5, None, None, "none")]
BAD = [
    ((" ", "stat_fdr", 0.5, 1, None, None, None, None), ["signal_id_blank"]),
    (("c", "odd", 0.5, 1, None, None, None, "odd"), ["evidence_kind_unknown", "explanation_hint_unknown"]),
    (("d", "stat_fdr", NAN, -1, INF, 1.5, -0.1, "mixed"), ["signal_score_range", "support_n_negative", "p_value_range", "q_value_range", "effect_size_finite"]),
    ((None, None, None, None, NAN, NAN, NAN, None), ["signal_id_blank", "evidence_kind_unknown", "signal_score_range", "support_n_negative", "p_value_range", "q_value_range", "effect_size_finite"]),
]


def test_rules_quarantine_and_counts(spark, tmp_path):
    df = spark.createDataFrame(GOOD + [r for r, _ in BAD], SIGNAL)
    seen = Observation()
    good, bad = contracts.SIGNALS.split(df, seen)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(GOOD, key=repr)
    counts = seen.get
    assert counts["rows"] == 7 and counts["signal_id_blank"] == 2 and counts["effect_size_finite"] == 2
    assert sorted(r.broken_rules for r in bad.collect()) == sorted(rules for _, rules in BAD)
    assert contracts.SIGNALS.violations(df, "signal_id").count() == sum(len(rules) for _, rules in BAD)
    assert contracts.SIGNALS.enforce(df, f"{tmp_path}/q").count() == 3
    contracts.SIGNALS.enforce(df, f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").where("contract = 'evidence signals'").count() == 8
    assert contracts.SIGNALS.violations(df.limit(0), "signal_id").count() == 0


def test_guards_name_what_is_missing(spark):
    with pytest.raises(ValueError, match="p_value is missing; q_value is missing; support_n is int, not bigint"):
        contracts.SIGNALS.guard(spark.createDataFrame([], SIGNAL.replace(", p_value double, q_value double", "").replace("support_n long", "support_n int")))
    from hustings.sources.adapters import surge_catalog

    assert contracts.CANONICAL.guard(surge_catalog(spark, "/root/testdata/sf0.001").records) is not None


def test_stored_tables_keep_their_contracts(spark, tmp_path):
    from hustings.sources import files

    rows = spark.createDataFrame([("1", "Doe, Jane", "", "PRO", "2/3/2026 5:07 PM"), ("2", "Roe, Al", "Org", "x", "never")], "id string, name string, organization string, position string, time_signed_in string")
    found = files.normalize_submissions(rows, "f.csv")
    assert contracts.SUBMISSIONS.violations(found, "submission_key").count() == 0
    s = store.Store(spark, f"file://{tmp_path}")
    s.record_import("k", "t", "h", "1", "completed", 2)
    assert contracts.IMPORTS.violations(s.imports(), "import_id").count() == 0


def test_bucket_minutes_of_anything(spark):
    cases = {"string": [("15", 15), (" 15.4 ", 15), ("2.5", 2), ("3.5", 4), ("0.4", None), ("-5", None), ("", None), ("abc", None), ("nan", None), ("inf", None), ("1e2", 100), (None, None)], "double": [(15.0, 15), (0.5, None), (1.5, 2), (NAN, None), (INF, None), (-1.0, None), (None, None)], "int": [(30, 30), (0, None), (-5, None)], "boolean": [(True, None), (False, None)]}
    for kind, pairs in cases.items():
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], f"i int, bucket_minutes {kind}")
        assert [r[0] for r in df.orderBy("i").select(core.bucket_minutes_of(df, "bucket_minutes")).collect()] == [w for _, w in pairs], kind


def test_lenses_by_name():
    assert core.lens_of(None) == "raw" and core.lens_of(" Side_By_Side ") == "side_by_side" and core.lens_of("", "exact_row_dedup") == "exact_row_dedup"
    with pytest.raises(ValueError):
        core.lens_of("both")


def test_shards_come_back_as_they_were(spark, tmp_path):
    at = dt.datetime(2026, 2, 3, 9)
    volume = spark.createDataFrame([(15, at, 1.5, [1, 2]), (30, at, NAN, []), (None, at, None, None), (0, at, 2.0, [3])], "bucket_minutes int, minute timestamp_ntz, x double, ids array<int>")
    names = spark.createDataFrame([("15.0", 'O\'Neil "Q"'), ("x", "Zoë")], "bucket_minutes string, name string")
    plain = spark.createDataFrame([(1, "a")], "n int, t string")
    s = shards.Shards(spark, f"file://{tmp_path}/shards")
    m = s.write({"volume": volume, "names": names, "other chart": plain, "extra": plain}, {"Bursts!": ["volume", "missing", "volume"], "bursts": ["names"]})
    assert m["analysis"]["Bursts!"]["slug"] == "bursts" and m["analysis"]["bursts"]["slug"] == "bursts-2"
    assert m["analysis"]["__shared__"]["chart_ids"] == ["extra", "other chart"] and m["chart_to_analysis"]["volume"] == "Bursts!"
    assert m["analysis"]["Bursts!"]["chart_bucket_options"] == {"volume": [15, 30], "missing": []}
    assert json.loads(json.dumps(s.manifest())) == json.loads(json.dumps(m))
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    want = [(15, at, 1.5, [1, 2]), (30, at, None, []), (None, at, None, None), (0, at, 2.0, [3])]
    back = s.read("volume")
    assert back.schema == volume.schema and key(back.collect()) == key(want)
    one = s.read("volume", 30)
    assert key(one.collect()) == key(want[1:2]) and all("shard=30" in f for f in one.inputFiles())
    assert key(s.read("volume", base_only=True).collect()) == key(want[2:])
    assert key(s.read("names").collect()) == key(names.collect()) and s.read("names", 15).count() == 1 and s.read("missing").count() == 0
    assert s.read("volume", 60).count() == 0

    def broken(*_):
        raise OSError("disk full")

    s._publish = broken  # all shards are written, the manifest is not
    with pytest.raises(OSError):
        s.write({"volume": volume.limit(1)}, {"bursts": ["volume"]})
    assert key(shards.Shards(spark, f"file://{tmp_path}/shards").read("volume").collect()) == key(want)
    with pytest.raises(FileNotFoundError):
        shards.Shards(spark, f"file://{tmp_path}/none").manifest()


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_artifacts_come_back(spark, tmp_path, kind):
    at = dt.datetime(2026, 2, 3, 9, 5)
    store.write_table(spark.createDataFrame([(at, 1), (None, 2)], "minute_bucket timestamp_ntz, n int"), f"{tmp_path}/counts.{kind}", kind)
    store.write_table(spark.createDataFrame([("soon", 1)], "first_seen string, n int"), f"{tmp_path}/odd.{kind}", kind)
    got = shards.load_artifacts(spark, str(tmp_path), kind)
    assert set(got) == {"counts", "odd"}
    assert {r.minute_bucket for r in got["counts"].collect()} == {at, None} and got["odd"].first().first_seen == "soon"
    assert shards.load_artifacts(spark, f"{tmp_path}/none", kind) == {}
    with pytest.raises(ValueError):
        shards.load_artifacts(spark, str(tmp_path), "xls")
