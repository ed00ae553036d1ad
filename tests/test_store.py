"""Keyed upserts that rewrite only what a batch touches, and imports that resume."""

import json
import os

import pytest

from hustings.sources import chunked, store


def rows(spark, *r, schema="k string, v int, seq int"):
    return spark.createDataFrame(list(r), schema)


def folders(s, table):
    return s.manifest(table)["parts"]


def files_under(root):
    return {os.path.join(d, x): os.path.getmtime(os.path.join(d, x)) for d, _, names in os.walk(root) for x in names if x.endswith(".parquet")}


def test_one_key_leaves_other_files_alone(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", parts=8)
    s.upsert("t", rows(spark, *((f"k{i}", i, 0) for i in range(200))), "k")
    before, first = files_under(tmp_path), folders(s, "t")
    assert s.upsert("t", rows(spark, ("k7", 99, 1)), "k") == 1
    after, second = files_under(tmp_path), folders(s, "t")
    assert before.items() <= after.items()
    assert sum(first[p] != second[p] for p in first) == 1 and len(first) == 8
    now = {r.k: r for r in s.read("t").collect()}
    assert len(now) == 200 and now["k7"].v == 99 and now["k8"].v == 8
    then = {r.k: r for r in s.read("t", version=0).collect()}  # readers of the old version still can
    assert then["k7"].v == 7 and now["k7"].created_at == then["k7"].created_at and now["k7"].updated_at > then["k7"].updated_at
    assert [r.v for r in s.lookup("t", ["k7", "none"]).collect()] == [99]
    assert len(s.lookup("t", ["k7"]).inputFiles()) < len(s.read("t").inputFiles())
    assert s.vacuum("t", keep=1) == 1 and s.versions("t") == [1] and s.read("t").count() == 200


def test_winners_of_repeated_keys_are_defined(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", parts=4)
    batch = rows(spark, ("a", 1, 5), ("a", 3, 2), ("a", 3, 1), ("a", None, 9), ("b", None, None))
    for n in (1, 3):
        name = f"t{n}"
        assert s.upsert(name, batch.repartition(n), "k") == 2
        assert {(r.k, r.v, r.seq) for r in s.read(name).collect()} == {("a", 3, 2), ("b", None, None)}
    s.upsert("o", batch, "k", order="seq")
    assert {(r.k, r.v, r.seq) for r in s.read("o").collect()} == {("a", None, 9), ("b", None, None)}


def test_new_columns_null_keys_and_second_writers(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", parts=4)
    s.upsert("t", rows(spark, ("a", 1, 1), ("b", 2, 1)), "k")
    s.upsert("t", rows(spark, ("c", [1], {"x": 1}), schema="k string, w array<int>, m map<string,int>"), "k")
    got = {r.k: (r.v, r.w) for r in s.read("t").collect()}
    assert got == {"a": (1, None), "b": (2, None), "c": (None, [1])}
    s.upsert("t", rows(spark, ("a", 7, 1)), "k")
    assert {r.k: (r.v, r.w) for r in s.read("t").collect()} == {"a": (7, None), "b": (2, None), "c": (None, [1])}
    with pytest.raises(ValueError):
        s.upsert("t", rows(spark, (None, 1, 1)), "k")
    with pytest.raises(ValueError):
        s.upsert("t", rows(spark, ("a", 1, 1)), "v")
    with pytest.raises(RuntimeError):
        s._publish("t", s.manifest("t"))  # the version is taken
    assert s.read("t").count() == 3 and s.read("none") is None
    s.upsert("e", rows(spark, schema="k string, v int, seq int"), "k")
    assert s.read("e").count() == 0 and s.lookup("e", ["x"]).count() == 0


LINES = [["1,Doe Jane,Org,Pro,2/3/2026 5:07 PM", "2,Roe Al,,Con,never"], ["3,Poe Em,,Pro,2/3/2026 5:09 PM"], ["4,Loe Si,Org,Con,2/3/2026 5:10 PM", "5,Moe Ty,,Pro,2/3/2026 5:11 PM"]]


def folder_of(tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    for k, lines in enumerate(LINES):
        path = folder / f"part{k}.csv"
        path.write_text("Count,Name,Organization,Position,Time Signed In\n" + "\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


SCHEMA = "`Count` string, Name string, Organization string, Position string, `Time Signed In` string"


def content(s):
    return sorted((r.submission_key, r.name_clean, r.position_normalized, str(r.signed_at)) for r in s.read("subs").collect())


def run(s, folder, convert):
    return chunked.import_folder(s, "submissions", "subs", folder, SCHEMA, convert, "submission_key")


def test_import_resumes_after_a_crash(spark, tmp_path):
    folder = folder_of(tmp_path, "in")
    whole = store.Store(spark, f"file://{tmp_path}/whole", parts=4)
    want = run(whole, folder, chunked.submissions())
    assert want["status"] == "completed" and want["totals"] == {"rows_processed": 5, "rows_blank_organization": 3, "rows_invalid_timestamp": 1, "chunks": 3}

    broken = store.Store(spark, f"file://{tmp_path}/broken", parts=4)
    calls = []

    def dies_within(batch):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("executor lost")
        return chunked.submissions()(batch)

    with pytest.raises(Exception):
        run(broken, folder, dies_within)
    assert broken.read("subs").count() == 2
    original = broken.upsert

    def dies_after(*args, **more):
        original(*args, **more)
        raise OSError("driver lost after the rows were in")

    broken.upsert = dies_after
    with pytest.raises(Exception):
        run(broken, folder, chunked.submissions())
    broken.upsert = original
    assert broken.read("subs").count() == 3
    got = run(broken, folder, chunked.submissions())
    assert got["totals"] == want["totals"] and content(broken) == content(whole)
    assert [r.status for r in broken.imports().orderBy("created_at").collect()] == ["failed", "failed", "completed"]
    assert run(broken, folder, chunked.submissions())["status"] == "skipped"
    stamps = {r.submission_key: r.updated_at for r in broken.read("subs").collect()}
    path = os.path.join(folder, "part9.csv")  # a file that comes later is imported by the next call
    with open(path, "w") as file:
        file.write("Count,Name,Organization,Position,Time Signed In\n9,New One,,Pro,2/3/2026 6:00 PM\n")
    more = run(broken, folder, chunked.submissions())
    assert more["rows_processed"] == 1 and more["totals"]["rows_processed"] == 6
    assert {r.submission_key: r.updated_at for r in broken.read("subs").collect()}.items() >= stamps.items()


def test_manifest_is_plain_json(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}", parts=2)
    s.upsert("t", rows(spark, ("a", 1, 1)), "k", mark=("x", 4, {"n": 1}))
    assert s.upsert("t", rows(spark, ("a", 2, 2)), "k", mark=("x", 4, {"n": 1})) == 0  # marked already
    data = json.loads((tmp_path / "t/manifests/000000000000.json").read_text())
    assert data["applied"] == {"x": {"batch": 4, "totals": {"n": 1}}} and s.read("t").first().v == 1
