"""Language, toxicity and quality models: exactness of their parts and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hustings.llm import langid, quality, toxicity
from hustings.llm.common import remainder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, None), (3, "12 34 !?", "en", 1.0), (None, "words", "xx", 0.0), (5, "é" * 70_000, "fr", 0.1), (5, "é" * 70_000, "fr", 0.1)], "doc_id long, text string, lang string, score double")


def test_language_held_out(spark, documents):
    network = langid.learn(documents, remainder("doc_id", 3) != 1)
    found = langid.identify(documents, network).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    rows = langid.identify(odd(spark), network).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows) and len(rows) == 6
    assert langid.identify(odd(spark).limit(0), network).count() == 0
    assert {r.lang_pred for r in langid.identify(odd(spark), None).collect()} == {"und"}


def test_folded_tables_equal_the_plain_network():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (120, langid.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 3, 120)
    network = langid.train(windows, labels, ["a", "b", "c"], epochs=1)
    p = network.probabilities(windows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and (network.probabilities(windows[:5]) == p[:5]).all()
    hidden = []  # without tables: every filter over every window of bytes
    for width, parts in zip(langid.WIDTHS, network.tables):
        at = lambda part, w, i: part[w[i] * 256 + w[i + 1]] if len(part) > 256 else part[w[i]]
        hidden.append([np.max([sum(at(part, w, i + j) for part, j in zip(parts, range(0, width, 2))) for i in range(langid.WINDOW - width + 1)], axis=0) for w in windows[:4].astype(int)])
    out = np.maximum(np.concatenate(hidden, axis=1) + network.bias, 0) @ network.weights + network.out_bias
    e = np.exp(out - out.max(axis=1, keepdims=True))
    assert np.allclose(e / e.sum(axis=1, keepdims=True), p[:4], atol=1e-5)


def test_windows_cover_whole_texts():
    column = pa.array(["a" * 600, None, "", "b" * 256])
    windows, owner, held = langid.cut_windows(*langid.utf8(column))
    assert owner.tolist() == [0, 0, 0, 3] and held.tolist() == [256, 256, 88, 256]
    assert bytes(windows[2]).rstrip(b"\0") == b"a" * 88


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(5)
    x = np.where(rng.random((700, 60)) < 0.08, rng.random((700, 60)), 0)
    x[:, 0] = rng.random(700) + 0.1  # a frequent term
    x[350:400] = x[:50]  # ties
    x = (x / np.sqrt((x**2).sum(axis=1, keepdims=True))).astype(np.float32).astype(float)
    ids, y = rng.permutation(700) * 3, rng.integers(0, 2, 700)

    def sparse(m):
        rows, terms = np.nonzero(m)
        return toxicity.Sparse(np.searchsorted(rows, np.arange(len(m) + 1)), terms, m[rows, terms])

    index = toxicity.Index.of(ids, y, sparse(x), 59)
    queries = x[::7]
    best, who = index.nearest(sparse(queries))
    plain = np.round(queries @ x.T, toxicity.DECIMALS)
    for q in range(len(queries)):
        order = sorted(range(700), key=lambda i: (-plain[q, i], ids[i]))[: toxicity.NEIGHBOURS]
        assert best[q].tolist() == pytest.approx([plain[q, i] for i in order], abs=1e-9)
        assert index.doc_ids[who[q]].tolist() == [ids[i] for i in order]
    without, names = index.nearest(sparse(queries), besides=ids[::7])
    assert (index.doc_ids[names[:, 0]] != ids[::7]).all() and (without[:, 0] <= best[:, 0] + 1e-6).all()


def plain_toxicity(documents, labels):
    """Scores of the whole operator from dictionaries: terms, weights, all cosines, votes, monotone fit."""

    def terms(text):
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or ""))
        raw = [w.encode() for w in words]
        return Counter([(0, w) for w in raw] + [(n, w[:n]) for n in toxicity.BEGINNINGS for w in raw if len(w) > n]), len(raw)

    texts = {r.doc_id: terms(r.text) for r in documents}
    known = {r.doc_id: r.toxic for r in labels if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts}
    per = [Counter(t for i, y in known.items() if y == k for t in texts[i][0]) for k in (0, 1)]
    sizes = [sum(y == k for y in known.values()) for k in (0, 1)]
    df = Counter(t for c, _ in texts.values() for t in c)

    def weight(t):
        a = [per[0][t], per[1][t]]
        ratio = sum(a[k] * math.log(a[k] * sum(sizes) / (sum(a) * sizes[k])) for k in (0, 1) if a[k])
        return (math.log((1 + len(texts)) / (1 + df[t])) + 1) * math.sqrt(2 * max(ratio, 0)) * sum(a) / (sum(a) + toxicity.HALF)

    weights = {t: weight(t) for t in {*per[0], *per[1]}}

    def vector(i):
        v = {t: (1 + math.log(n)) * weights[t] for t, n in texts[i][0].items() if t in weights}
        if v:
            v["words"] = 1 + math.log(texts[i][1])
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in texts}
    prior = sizes[1] / sum(sizes)

    def vote(i, besides=None):
        near = sorted(((-round(sum(x * vectors[j][t] for t, x in vectors[i].items() if t in vectors[j]), 6), j) for j in known if j != besides))[: toxicity.NEIGHBOURS]
        total = sum(s * s for s, _ in near)
        return (sum(s * s * known[j] for s, j in near) + toxicity.PRIOR_WEIGHT * prior) / (total + toxicity.PRIOR_WEIGHT) if total else -1.0

    x, y = toxicity.monotone(np.array([vote(i, i) for i in known]), np.array(list(known.values())))
    out = {}
    for i in texts:
        v = vote(i)
        out[i] = 0.98 * np.interp(v, x, y) + 0.02 * min(max(v, 0), 1)
    return out


def test_toxicity_equals_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = plain_toxicity(documents.collect(), labels.collect())
    got = {r.doc_id: r for r in toxicity.score(documents, toxicity.learn(documents, labels)).collect()}
    assert got.keys() == want.keys()
    assert sum(abs(got[i].score - want[i]) > 0.02 for i in want) <= 2  # where sums round apart, a neighbour may differ
    assert all(len(r.evidence) == toxicity.NEIGHBOURS for r in got.values() if r.score > 0.5)


def test_monotone_fit_rises():
    rng = random.Random(1)
    v = np.array([rng.random() for _ in range(300)])
    y = (v + np.array([rng.gauss(0, 0.3) for _ in range(300)]) > 0.5).astype(int)
    x, p = toxicity.monotone(v, y)
    assert (np.diff(x) > 0).all() and ((p > 0) & (p < 1)).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_toxicity_held_out(spark, sf):
    documents, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(documents, labels)
    rows = toxicity.score(documents.join(labels, "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    found = sum(r.predicted and r.toxic for r in rows)
    assert found >= 0.9 * sum(r.toxic for r in rows) and found >= 0.9 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_odd_rows_and_labels(spark, documents, labels):
    model = toxicity.learn(documents, labels)
    assert toxicity.score(odd(spark), model).count() == 6
    empty = toxicity.learn(documents, labels.limit(0))
    assert {r.score for r in toxicity.score(odd(spark), empty).collect()} == {0.0}
    one = toxicity.learn(documents, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.score(odd(spark), one).collect()} == {1.0}


def test_trees_separate_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    forest = quality.grow(x, y, trees=30)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.base
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                node = int(forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node])
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], forest.scores(x[:50]))


def test_quality_held_out(spark, documents, labels):
    forest = quality.learn(documents, labels)
    rows = quality.score(documents, forest).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert quality.score(odd(spark), forest).count() == 6
    assert {round(r.score, 3) for r in quality.score(odd(spark), quality.learn(documents, labels.limit(0))).collect()} == {0.5}


def test_statistics_do_not_depend_on_the_batch():
    texts = ["Some words. More words!", "", None, "a a a a\nb", "É é $$$ 12"]
    whole = quality.statistics(pa.array(texts, pa.string()))
    single = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single)
