"""The corpus pipeline: each stage's decisions on a small input, and the whole run."""

import itertools
import random

import corpus_pipeline
import pytest

from hustings.llm import bpe, decontaminate, langid, near_copies, secret_scan, simhash
from hustings.llm.common import remainder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_bite(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.dtypes == docs.dtypes, name
        assert after.count() <= kept.count()
        kept = after


def test_language_drops_what_has_no_letters(spark, docs):
    junk = spark.createDataFrame([(10_001, "12 34", "en", "s", 5), (10_002, None, "en", "s", None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(junk), SF).collect()}
    assert not kept & {10_001, 10_002} and len(kept) > 0.9 * docs.count()


def test_one_of_each_component_stays(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {r.component_id for r in found}


def test_no_edited_copy_stays(spark):
    rng = random.Random(21)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 150, 600]))]
        for _ in range(4):  # each is edited in another share of its words
            copy = [f"x{rng.randrange(10**6)}" if rng.random() < share else w for share in [rng.choice([0, 0.005, 0.02, 0.2])] for w in words]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), "one two"), (len(rows) + 1, "One  TWO"), (len(rows) + 2, "one three")]
    label, shingles = {i: i for i, _ in rows}, {i: sets(t) for i, t in rows}
    pairs = [(i, j) for i, j in itertools.combinations(label, 2) if jaccard(shingles[i], shingles[j]) >= 0.8]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame([(*r, "k") for r in rows] + [(None, rows[0][1], "k")], "doc_id long, text string, node string")
    kept = sorted(r.doc_id for r in near_copies.keep_one(docs).collect() if r.doc_id is not None)
    assert kept == sorted(set(label.values())) and near_copies.keep_one(docs).where("doc_id is null").count() == 1
    stay = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    assert not [p for p in pairs if set(p) <= stay]


def test_whole_run_equals_its_stages(spark, docs):
    """The rows of run() are those that each stage's operator, asked directly, leaves."""
    kept = docs
    network = langid.learn(kept, remainder("doc_id", 3) != 1)
    told = {r.doc_id for r in langid.identify(kept, network).where("lang_pred <> 'und' and score >= 0.4").collect()}
    kept = spark.createDataFrame([r for r in docs.collect() if r.doc_id in told], docs.schema)
    first = {r.doc_id for r in simhash.near_duplicates(kept).where("doc_id = component_id").collect()}
    kept = near_copies.keep_one(spark.createDataFrame([r for r in kept.collect() if r.doc_id in first], docs.schema))
    leaked = {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {}
    for r in kept.collect():
        if r.doc_id not in leaked:
            base, novel = secret_scan.scan_text(r.text)
            want[r.doc_id] = secret_scan.masked(r.text, base + novel)
    rows = corpus_pipeline.run(spark, SF).collect()
    tokenizer = bpe.load(bpe.default_path())
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want) < docs.count()
    for r in rows:
        assert tokenizer.decode(r.ids) == want[r.doc_id].encode() and r.n_tokens == len(r.ids)


def test_stages_on_odd_and_empty_tables(spark, docs):
    odd = [(900_001, None, "en", "s", 5), (900_002, "", None, None, None), (None, "words without an id, " * 9, "en", "s", 1), (900_007, "one text of two", "en", "s", 1), (900_007, "quite another one under the same id", "en", "s", 1)]
    odd += [odd[-1], (900_008, "long words " * 100_000, "en", "s", None), (900_009, 'token = "abcdefgh1234" in it', "en", "s", 0)]
    frame = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' as node", "1 as root", "'y' as ids")
    for rows in (frame, frame.limit(0)):
        kept = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.dtypes == rows.dtypes, name
        last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        found = {r.doc_id: r for r in last.collect()}
        assert not found.keys() & {900_001, 900_002} and not kept.where("contains(text, 'abcdefgh1234')").count()
