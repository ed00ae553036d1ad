"""Every operator on nulls in any column, blank and long texts, repeated rows, empty tables and clashing extra columns."""

import pytest

from hustings.llm import bpe, decontaminate, fingerprints, html_extract, langid, quality, secret_scan, simhash, suffix_dedup, toxicity
from hustings.llm.common import remainder

ROWS = [(1, None, "en", 3), (2, "", None, None), (3, " \n\t", "xx", 0), (None, "no id", "en", 5), (4, "word " * 20_000, "en", 1), (5, "same text", "de", 1), (5, "same text", "de", 1), (6, None, None, None)]
LABELS = [(4, 1, 1), (5, 0, 0), (5, 0, 0), (None, 1, 0), (9, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    for name in ("score", "fp", "key", "spans", "item_id", "ids", "component_id", "bucket"):  # names that operators use themselves
        frame = frame.selectExpr("*", f"'x' as {name}")
    return frame


def operators(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word " * 12), (2, None), (None, "")], "item_id long, text string")
    yield "op1", lambda: toxicity.score(docs, toxicity.learn(docs, labels)), True
    yield "op2", lambda: secret_scan.scan(docs), True
    yield "op3", lambda: fingerprints.fingerprint_edits(docs), True
    yield "op5", lambda: decontaminate.contaminated(docs, bench), False
    yield "op6", lambda: langid.identify(docs, langid.learn(docs, remainder("doc_id", 3) != 1)), True
    yield "op7", lambda: simhash.near_duplicates(docs), True
    yield "op8", lambda: quality.score(docs, quality.learn(docs, labels)), True
    yield "op9", lambda: suffix_dedup.repeats(docs), False
    yield "op10", lambda: bpe.digests(docs), True


@pytest.mark.parametrize("number", range(9))
def test_odd_rows_and_empty_tables(spark, docs, number):
    name, run, whole = list(operators(spark, docs))[number]
    rows = run().collect()
    assert not whole or len(rows) == len(ROWS), name
    if name == "op5":
        assert {r.doc_id for r in rows} == {4}
    if name == "op9":
        assert {r.doc_id for r in rows} == {4}
    _, empty, _ = list(operators(spark, docs.limit(0)))[number]
    assert empty().count() == 0, name


def test_filters_pass_columns_through(spark, docs):
    bench = spark.createDataFrame([(1, "nothing of it is in there at all")], "item_id long, text string")
    for kept in (decontaminate.keep_clean(docs, bench), secret_scan.mask(docs), simhash.keep_one(docs), langid.keep_identified(docs, langid.learn(docs, remainder("doc_id", 3) != 1))):
        assert kept.dtypes == docs.dtypes
        assert kept.count() <= len(ROWS)
    assert decontaminate.keep_clean(docs, bench).count() == len(ROWS)
    groups = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert groups == {1, 4, 5, None}  # the blank texts are one group, and rows without an id stay


def test_odd_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(pages).count() == 0
    long = "<article>" + "<p>Words, of a paragraph that goes on.</p>" * 50_000 + "</article>"
    rows = [(1, "u", None, "a", 3), (1, None, "<p>one, of some length to count here", None, 4), (1, None, "<p>one, of some length to count here", None, 4), (None, "v", long, "t", None), (2, "", "", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, html_extract.extract_pages(pages).collect()), key=repr)
    one = "one, of some length to count here"
    whole = " ".join(["Words, of a paragraph that goes on."] * 50_000)
    assert got == sorted([(1, "u", "", 0), (1, None, one, len(one)), (1, None, one, len(one)), (None, "v", whole, len(whole)), (2, "", "", 0)], key=repr)


@pytest.mark.parametrize("name", ["op2", "op5", "op6", "op7", "op8", "op9", "op10", "op1"])
def test_texts_of_megabytes(spark, name):
    """One text of 6 MB and one word of 1 MB, whole."""
    rows = [(1, "some words of a very long text " * 200_000), (2, "x7" * 500_000), (3, "short")]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    run = {n: f for n, f, _ in operators(spark, many.selectExpr("doc_id", "text", "'en' as lang", "1L as n_chars"))}[name]
    found = run().collect()
    assert {r.doc_id for r in found} == ({1} if name == "op9" else {1, 2, 3} if name != "op5" else set())
