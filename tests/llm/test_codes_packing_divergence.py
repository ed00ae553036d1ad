"""Vector codes, packing and source divergence against plain versions, and their odd cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hustings.llm import divergence, packing, queries, vector_codes

SF = "/root/testdata/sf0.001"


# --- vector codes


def test_ball_tree_finds_what_comparing_all_finds():
    rng = np.random.default_rng(3)
    for width, n, spread in ((4, 64, 60), (1, 64, 5), (3, 9, 2), (8, 64, 1000), (2, 1, 4), (4, 64, 1 << 26)):
        points = rng.integers(-spread, spread + 1, (n, width))
        points[n // 2 :: 3] = points[0]  # ties
        queries_ = np.concatenate([rng.integers(-spread, spread + 1, (500, width)), points])
        d = ((queries_[:, None] - points[None]) ** 2).sum(2)
        entry, error = vector_codes.BallTree(points).nearest(queries_)
        assert (entry == d.argmin(1)).all() and (error == d.min(1)).all()


def test_ball_tree_leaves_balls_out():
    points = np.repeat(np.arange(8) * 1000, 8)[:, None] + np.arange(64)[:, None] % 8
    tree = vector_codes.BallTree(points)
    compared = []
    tree._compare = lambda members, who, *rest: compared.append(len(members) * len(who)) or vector_codes.BallTree._compare(tree, members, who, *rest)
    tree.nearest(points)
    assert sum(compared) < 64 * 64 / 3


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0], kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            for k, m in members.items():
                books[p][k] = [sum(column) // len(m) for column in zip(*m)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, _), f in zip(kept, found)}, books


def test_codes_equal_the_plain_version_and_odd_vectors_go(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([0, 1, None]), [rng.uniform(-2, 2) for _ in range(32)]) for k in range(150)]
    rows += [(200 + k, 7, rows[k][2]) for k in range(40)]  # copies
    odd = [(-1, 1, None), (-2, 1, []), (-3, 1, [None] + [0.5] * 31), (-4, 1, [math.nan] * 32), (-5, 1, [math.inf] + [0.0] * 31), (999, 1, [0.5] * 48), (998, 1, [0.5] * 7), (997, 2, [1e30] * 32)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows + odd], "vec_id long, label int, embedding array<double>, code string, error string").repartition(3)
    codes, books = vector_codes.compress(frame)
    want, want_books = plain_codes(rows)
    got = codes.withColumn("code", vector_codes.written()).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert books.entries.tolist() == want_books
    label = {i: lab for i, lab, _ in rows}
    sums = Counter()
    for i, (_, e) in want.items():
        sums[label[i]] += e
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)
    back = {r.vec_id: r.embedding for r in vector_codes.decoded(codes, books).collect()}
    for i, _, v in rows:
        assert sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(v, back[i])) == want[i][1]


def test_codes_of_few_repeated_and_no_vectors(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    few = spark.createDataFrame([(None, None, [1.0] * 16), (2, None, [0.0] * 16), (2, 1, [0.0] * 16), (2, 1, [0.0] * 16)], kinds)
    codes, books = vector_codes.compress(few)
    got = Counter((r.vec_id, r.label, tuple(r.codes), r.error, r.label_error) for r in codes.collect())
    assert books.entries.shape == (16, 4, 1)
    assert got == Counter({(None, None, (3,) * 16, 0, 0): 1, (2, None, (0,) * 16, 0, 0): 1, (2, 1, (0,) * 16, 0, 0): 2})
    codes, books = vector_codes.compress(few.limit(0))
    assert codes.count() == 0 and set(codes.columns) == {"vec_id", "label", "codes", "error", "label_error"}
    assert vector_codes.compress(spark.createDataFrame([(1, 1, None), (2, 1, [1.0] * 7)], kinds))[0].count() == 0


# --- packing


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[k]}):
            rooms.remove(room)
            go(k + 1, [*rooms, room - items[k]])
            rooms.append(room)
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_plans_are_whole_and_as_short_as_exhaustive_search():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
        counts = [items.count(n) for n in range(capacity + 1)]
        for fillings in (packing.plan(counts)[0], packing.best_fit(counts, capacity)):
            assert Counter({n: 0 for n in items}) + sum((Counter(f * m) for m, f in fillings), Counter()) == Counter(items)
            assert all(m > 0 and sum(f) <= capacity for m, f in fillings)
        fillings, bound = packing.plan(counts)
        assert bound <= sum(m for m, _ in fillings) == fewest(items, capacity)


@pytest.mark.parametrize("low, high", [(600, 760), (400, 1100), (1, 2048)])
def test_completion_is_never_behind_best_fit(low, high):
    rng = random.Random(low)
    counts = [0] * 2049
    for _ in range(20_000):
        counts[rng.randint(low, high)] += 1
    fillings, bound = packing.plan(counts, nodes=1500)
    assert bound <= sum(m for m, _ in fillings) <= sum(m for m, _ in packing.best_fit(counts, 2048))
    used = Counter()
    for m, f in fillings:
        for n in f:
            used[n] += m
    assert [used[n] for n in range(2049)] == counts


def test_dominance():
    assert packing.dominates((7, 5), (7, 3, 2)) and packing.dominates((7,), (4, 3)) and packing.dominates((7, 5), (5,))
    assert not packing.dominates((6, 6), (7, 5)) and not packing.dominates((4, 4), (3, 3, 2))


def packed_rows(spark, docs, **more):
    rows = packing.pack(docs, **more).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= more.get("capacity", 2048)
    return rows, len(by_sequence)


def test_pieces_hold_the_ids_of_the_tokenizers_library(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t "), (-4, "<|endoftext|> ok"), (-5, "naïve 東京 🙂 á " * 3000), (-6, " " * 300_000 + "x"), (-7, "word " * 100_000), (-8, "same"), (-8, "same"), (None, "no id")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    rows, n = packed_rows(spark, docs.repartition(5))
    want, lengths = Counter(), Counter()
    for doc_id, text in docs.collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - start - 1) % 2048 + 1
            want[(doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))] += 1
            lengths[length] += 1
            start, piece = start + length, piece + 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert n == sum(m for m, _ in packing.plan([lengths[k] for k in range(2049)])[0])
    assert n - -(-sum(k * c for k, c in lengths.items()) // 2048) <= 1


def test_sequences_hold_whole_documents_again(spark):
    docs = spark.createDataFrame([(k, f"text {k} " * (k % 9), "z") for k in range(60)], "doc_id long, text string, ids string")
    packed = packing.pack(docs, capacity=16, with_ids=True)
    found = defaultdict(dict)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) <= 16
        for p in r.pieces:
            found[p.doc_id][p.piece] = r.ids[p.offset : p.offset + p.length]
    for k in range(60):
        whole = [i for _, part in sorted(found[k].items()) for i in part]
        assert whole == [*packing.token_ids(f"text {k} " * (k % 9), packing.bpe.default_path()), 0]
    assert packing.pack(docs.limit(0)).count() == 0


# --- source divergence


def plain_audit(rows, least):
    words = [(lang or "", source or "", [w for w in "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (text or "")).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]) for lang, source, text in rows]
    out = set()
    for lang in {w[0] for w in words}:
        docs, groups = Counter(), defaultdict(Counter)
        for own, source, terms in words:
            if own == lang:
                docs.update(set(terms))
                groups[source].update(terms)
        kept = [t for t in docs if docs[t] >= least]
        v = len(kept)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        usual = shares(sum(groups.values(), Counter()))
        own = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(own[s][t], usual[t]), t) for t in kept if groups[s][t] and own[s][t] > usual[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_divergence_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 3)
    rng = random.Random(11)
    vocabulary = ["the", "The", "ÉTÉ", "été", "東京", "it's", "x1y", "a_b", "😀", "z", "end.", "mid-word", " nb", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(200):
        source = rng.choice(["s1", "s1", "s1", "s2", "Ω", None])
        text = rng.choice([None, "", "12 34", *([" ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))] * 9)])
        rows.append((rng.choice(["en", "en", "de", None]), source, text))
    rows += [("only", "one", "word here"), ("xx", "a", "rare"), ("xx", "b", None), ("en", "blank", " \n"), ("en", "s2", "the " * 30_000), ("en", "s1", "the same"), ("en", "s1", "the same")]
    rows += [("end", "p", "abc"), ("end", "q", "def")] * 3  # neighbours in a block stay terms of their own
    frame = spark.createDataFrame([(*r, 0, "t", 1) for r in rows], "lang string, source string, text string, doc_id long, term string, n long").repartition(4)
    got = divergence.audit(frame).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == plain_audit(rows, 3)
    assert divergence.audit(frame.limit(0)).count() == 0
    one = divergence.audit(frame.where("lang = 'only'"))
    assert one.count() == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_best_fit_packing", "op13_source_divergence"])
def test_columns(spark, name):
    wanted = {
        "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op12_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op13_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    }[name]
    found = queries.QUERIES[name](spark, SF)
    assert found.columns == wanted
    assert found.count() > 0
