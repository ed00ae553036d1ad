"""File scans, normalisation, upserts, the ledger and streams on small inputs."""

import datetime as dt

import pytest

from hustings.config import Config
from hustings.sources import adapters, files, store
from hustings.streaming import minutes

HEADER = "Count,Name,Organization,Position,Time Signed In\n"


def test_sign_in_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿".encode() + (HEADER + '1,"Doe, Jane",,Pro,2/3/2026 5:07 PM\n2,"Smith, John",Org A,Con,02/03/2026 06:15 AM\n3,Brown Ava,,Pro,\n').encode())
    assert files.encoding(path) == "utf-8-sig"
    rows = adapters.canonical(files.sign_ins(spark, str(path)), Config()).orderBy("id").collect()
    assert [r.timestamp for r in rows] == [dt.datetime(2026, 2, 3, 17, 7), dt.datetime(2026, 2, 3, 6, 15), None]
    assert rows[0].organization == "" and rows[2].canonical_name == "AVA|BROWN"
    with pytest.raises(ValueError):
        files.normalize_columns(files.scan_csv(spark, str(path)), {"id": "Nope"})


def test_encodings(tmp_path):
    (tmp_path / "u").write_bytes("né".encode())
    (tmp_path / "c").write_bytes("né".encode("cp1252"))
    assert files.encoding(tmp_path / "u") == "utf-8" and files.encoding(tmp_path / "c") == "cp1252"


def test_row_numbers_follow_the_file(spark):
    df = spark.range(0, 100, 1, 7).selectExpr("cast(id as string) as id", "'x, y' as name", "'' as organization", "'Pro' as position", "'2/3/2026 1:15 AM' as time_signed_in")
    out = files.normalize_submissions(df, "f.csv", offset=10).orderBy("source_row_number").collect()
    assert [r.source_row_number for r in out] == list(range(11, 111)) and [r.source_id for r in out] == [str(i) for i in range(100)]
    assert out[0].submission_key == "f.csv:11" and len(out[0].source_hash) == 40 and out[0].organization_is_blank and out[0].signed_at == dt.datetime(2026, 2, 3, 1, 15)


def test_registry_extract(spark):
    df = spark.createDataFrame([("12345", "Jane", "Q", "Doe", "1980", "Active"), ("", "Al", "", "Roe", "", "Inactive"), ("9", "", "", "X", "", "")], "StateVoterID string, FName string, MName string, LName string, Birthyear string, StatusCode string")
    out = files.normalize_registry(df, "v.txt").orderBy("canonical_name").collect()
    assert [r.canonical_name for r in out] == ["DOE|JANE", "ROE|AL"] and out[0].voter_key == "STATE:12345" and out[1].voter_key.startswith("NAME:") and len(out[1].voter_key) == 45
    assert files.active_registry(files.normalize_registry(df, "v.txt")).count() == 1
    with pytest.raises(ValueError):
        files.normalize_registry(df.select("Birthyear"), "v.txt")


def test_frequencies_and_nicknames(spark):
    df = spark.createDataFrame([("Jane", "100"), ("JANE", "25"), ("John", "150"), ("", "9"), ("X", "bad")], "Name string, Count string")
    got = {r["name"]: (r["count"], r.probability) for r in files.frequency_baseline(df).collect()}
    assert set(got) == {"JANE", "JOHN"} and got["JOHN"][1] > got["JANE"][1] and sum(p for _, p in got.values()) == pytest.approx(1)
    names = spark.createDataFrame([("bob", "robert"), ("al", "alan"), ("al", "albert")], "alias string, canonical string")
    assert {r.alias: r.canonical for r in files.nickname_map(names, {"JO": "JOSEPH"}).collect()} == {"BOB": "ROBERT", "JO": "JOSEPH"}


def test_side_car():
    text = "schema_version: 1\nhearing_id: H1\ntimezone: America/Los_Angeles\nmeeting_start: 2026-02-06T13:30:00-08:00\nsign_in_open: 2026-02-03T09:00:00-08:00\nsign_in_cutoff: 2026-02-06T20:30:00+00:00\n"
    assert files.side_car(text)["sign_in_cutoff"] == dt.datetime(2026, 2, 6, 12, 30)
    for bad in (text.replace("schema_version: 1", "schema_version: 2"), text.replace("H1", ""), text.replace("2026-02-03T09", "2026-02-09T09"), "schema_version: 1\nhearing_id: x"):
        with pytest.raises(ValueError):
            files.side_car(bad)


def test_upserts_and_ledger(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, seq int")
    assert s.import_rows("submissions", "t", rows(("a", 1, 1), ("b", 2, 1)), "k", "h1")["rows_upserted"] == 2
    first = {r.k: r.created_at for r in s.read("t").collect()}
    assert s.import_rows("submissions", "t", rows(("a", 9, 9)), "k", "h1")["status"] == "skipped"
    s.import_rows("submissions", "t", rows(("b", 5, 1), ("b", 6, 2), ("c", 7, 1)), "k", "h2", order="seq")
    now = {r.k: r for r in s.read("t").collect()}
    assert {k: r.v for k, r in now.items()} == {"a": 1, "b": 6, "c": 7} and now["b"].created_at == first["b"] <= now["b"].updated_at
    assert sorted(r.status for r in s.imports().collect()) == ["completed", "completed", "skipped"]
    with pytest.raises(ValueError):
        s.record_import("x", "t", "h", "1", "odd")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], float("nan"), 15), (2, [], 1.5, 30)], "a int, b array<int>, c double, bucket_minutes int")
    store.write_table(df, f"{tmp_path}/x.csv", "csv")
    assert {r.b for r in files.load_table(spark, f"{tmp_path}/x.csv").collect()} == {"[1,2]", "[]"}
    store.write_shards(df, f"{tmp_path}/shards")
    assert spark.read.json(f"{tmp_path}/shards").where("bucket_minutes = 30").count() == 1
    assert store.summary_json(df.where("a = 1").drop("b")) == '{"a": 1, "bucket_minutes": 15, "c": null}'
    with pytest.raises(ValueError):
        files.load_table(spark, "x.xls")


def stream(spark, df, tmp_path, name, build):
    """Run rows of a folder through a streaming plan to the end and return what came out."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    q = build(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    t = dt.datetime(2026, 2, 3, 9)
    rows = [(i, n, "Pro", t + dt.timedelta(minutes=m)) for i, (n, m) in enumerate([("A|B", 0), ("A|B", 0), ("C|D", 1), ("A|B", 5)])] + [(9, "Z|Z", "Con", t + dt.timedelta(hours=5)), (10, "Z|Z", "Con", t + dt.timedelta(hours=9))]
    df = spark.createDataFrame(rows, "id long, canonical_name string, position_normalized string, timestamp timestamp_ntz").coalesce(1)
    got = {r.minute_bucket: r.n_total for r in stream(spark, df, tmp_path, "counts", minutes.minute_counts)}
    assert got[t] == 2 and got[t + dt.timedelta(minutes=5)] == 1
    assert sorted(r.id for r in stream(spark, df, tmp_path, "firsts", minutes.first_of_name))[:3] == [0, 2, 3]
    sessions = {(r.canonical_name, r.session_start): r.n for r in stream(spark, df, tmp_path, "sessions", minutes.name_sessions)}
    assert sessions["A|B", t] == 3
