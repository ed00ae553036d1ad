"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

Terms are words (lower case, cut at white space and ASCII punctuation) and word beginnings, which
stand for inflected and compound forms. Every term of every labelled example is a dimension; none
is selected. Its weight is (1 + log tf) * idf * relevance: document frequencies are counted over
all documents, and relevance is the signed root of the likelihood ratio between the term's
frequencies in examples of either label, drawn to zero for terms of few examples, so that what
tells nothing of the label weighs little. One more dimension stands for all words of a text
together, so that a vector tells one mention in a long text from many in a short one.

The unit vectors of the examples lie in an inverted index whose postings are cut into blocks of
`BLOCK` examples; for every term and block that has it the index holds the largest weight. A query
first bounds its cosine with every block from those maxima, then scores blocks from the highest
bound down through their postings, and leaves the rest as soon as their bounds are below its
`NEIGHBOURS`-th best: the neighbours are exact. Their labels vote by squared similarity, and a
monotone fit of leave-one-out votes to labels, each example weighted by the rows it was sampled
for, turns votes into calibrated scores.

Defined cases: a null text is empty; a text without any known term has no neighbours and gets the
calibrated score of such texts; without labelled rows every score is 0, without rows of one label
the other's; ties between neighbours (cosines alike in ten decimals) go to the smaller doc_id, then
to the example that stands first in the index; where an id has several label rows the commoner
label holds, label 1 on a tie; labels without a document are not learned from; very long texts are
scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, remainder, steps, thinned, utf8
from hustings.llm.wordhash import PUNCTUATED, hashes, lowered, mixed, running_sums, spans

NEIGHBOURS = 15
#: Examples to a block of the index.
BLOCK = 256
#: Terms of at least this share of the examples have dense postings: a weight for every example.
FREQUENT = 0.04
#: Bytes of the word beginnings that are terms besides whole words.
BEGINNINGS = (4, 5, 6)
#: What the prior weighs against the neighbours' similarities.
PRIOR_WEIGHT = 0.05
#: Examples at which the relevance of a term counts half.
HALF = 3
#: Queries, and index entries of their terms, of one numpy step.
QUERIES, STEP = 512, 1 << 21
#: Decimals to which cosines are alike; bounds within a unit of the last one are looked into.
DECIMALS = 10


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every word and of every beginning that is shorter than its word; words of each text."""
    raw, offsets = utf8(column)
    data = lowered(raw)
    starts, ends, firsts = spans(data, offsets, PUNCTUATED)
    owner = np.repeat(np.arange(len(column)), np.diff(firsts))
    sums = running_sums(data)
    found, of = [hashes(data, starts, ends, sums)], [owner]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        found.append(mixed(hashes(data, starts[longer], starts[longer] + n, sums) + np.uint64(n)))
        of.append(owner[longer])
    return np.concatenate(found), np.concatenate(of), np.diff(firsts)


@dataclass
class Sparse:
    """Rows of (term, value) pairs end to end, terms ascending in each row."""

    first: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def take(self, a: int, b: int) -> Sparse:
        x, y = self.first[a], self.first[b]
        return Sparse(self.first[a : b + 1] - x, self.term[x:y], self.value[x:y])


def counted(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each of n rows in ascending order: where each row starts, the keys, how often each comes."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])[: len(k)]
    at = np.flatnonzero(new)
    return np.searchsorted(r[at], np.arange(n + 1)), k[at], np.diff(np.append(at, len(k)))


@dataclass
class Vocabulary:
    """Sorted term hashes; a bitmap over their top bits turns most other words away."""

    terms: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(terms: np.ndarray) -> Vocabulary:
        t = np.unique(terms)
        bitmap = np.zeros(1 << 20, bool)
        bitmap[t >> np.uint64(44)] = True
        return Vocabulary(t, bitmap)

    def counts(self, column: pa.Array) -> tuple[Sparse, np.ndarray]:
        """Occurrences of the known terms in each text, and the number of its words."""
        n = len(column)
        h, owner, words = term_hashes(column)
        if not len(self.terms):
            h, owner = h[:0], owner[:0]
        maybe = np.flatnonzero(self.bitmap[h >> np.uint64(44)])
        h, owner = h[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[at] == h if len(h) else np.zeros(0, bool)
        size = len(self.terms) + 1
        keys = np.sort(owner[hit] * size + at[hit])
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        first = np.searchsorted(keys[head], np.arange(n + 1) * size)
        return Sparse(first, keys[head] % size, np.diff(np.append(head, len(keys))).astype(np.float64)), words


def unit_vectors(counts: Sparse, words: np.ndarray, weights: np.ndarray) -> Sparse:
    """(1 + log tf) * weight at unit length; the last dimension is the words; rows without terms stay empty."""
    has = np.diff(counts.first) > 0
    first = counts.first + np.concatenate([[0], np.cumsum(has)])
    term, value = np.full(first[-1], len(weights), np.int64), np.zeros(first[-1])
    last = first[1:][has] - 1  # the words come last in their row
    own = np.ones(len(term), bool)
    own[last] = False
    term[own], value[own] = counts.term, (1 + np.log(counts.value)) * weights[counts.term]
    value[last] = 1 + np.log(np.maximum(words[has], 1))
    out = Sparse(first, term, value)
    row = out.row()
    norm = np.sqrt(np.bincount(row, value**2, len(out)))
    return Sparse(first, term, (value / np.maximum(norm, 1e-300)[row]).astype(np.float32).astype(np.float64))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of `size` numbers each."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@dataclass
class Index:
    """An inverted index over blocks of examples, with the largest weight of each term in each block.

    Rarer terms have entries (term, block, largest weight), and behind each entry the postings of the block's examples;
    frequent ones, in nearly every block, have their postings as rows of a matrix (term x example).
    """

    doc_ids: np.ndarray
    labels: np.ndarray
    blocks: int
    entry: np.ndarray  # where each term's entries start
    block: np.ndarray
    largest: np.ndarray
    posting: np.ndarray  # where each entry's postings start
    example: np.ndarray  # within the block
    weight: np.ndarray
    frequent: np.ndarray  # a frequent term's row in the matrix, else -1
    matrix: np.ndarray  # block x term x example
    matrix_largest: np.ndarray  # term x block

    @staticmethod
    def of(doc_ids: np.ndarray, labels: np.ndarray, vectors: Sparse, terms: int) -> Index:
        """Examples alike in label and strongest term stand together, which keeps the maxima of blocks low."""
        n, row = len(vectors), vectors.row()
        blocks = -(-n // BLOCK)
        strongest = np.zeros(n, np.int64)
        order = np.lexsort((vectors.value, row))
        some = np.diff(vectors.first) > 0
        strongest[some] = vectors.term[order][vectors.first[1:][some] - 1]
        place = np.empty(n, np.int64)
        by = np.lexsort((np.arange(n), doc_ids, strongest, labels))
        place[by] = np.arange(n)
        at = place[row]
        often = np.flatnonzero(np.bincount(vectors.term, minlength=terms + 1) >= max(1, FREQUENT * n))
        frequent = np.full(terms + 1, -1, np.int64)
        frequent[often] = np.arange(len(often))
        dense = frequent[vectors.term] >= 0
        matrix = np.zeros((len(often), blocks * BLOCK), np.float32)
        matrix[frequent[vectors.term[dense]], at[dense]] = vectors.value[dense]
        term, at, value = vectors.term[~dense], at[~dense], vectors.value[~dense]
        order = np.lexsort((at, term))
        term, at, value = term[order], at[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)])[: len(term)])
        largest = np.maximum.reduceat(value, head) if len(head) else np.zeros(0)
        entry = np.searchsorted(term[head], np.arange(terms + 2))
        matrix = np.ascontiguousarray(matrix.reshape(len(often), blocks, BLOCK).transpose(1, 0, 2))
        top = matrix.max(axis=2).T if n else np.zeros((len(often), 0), np.float32)
        return Index(doc_ids[by], labels[by], blocks, entry, (at[head] // BLOCK).astype(np.int16 if blocks < 1 << 15 else np.int32), largest, np.append(head, len(term)), (at % BLOCK).astype(np.int16), value, frequent, matrix, top)

    def nearest(self, queries: Sparse, k: int = NEIGHBOURS, besides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines of each query and the examples that have them; 0 and -1 where there are no more.

        besides: for each query a doc_id that does not count as its own neighbour.
        """
        best, who = np.zeros((len(queries), k)), np.full((len(queries), k), -1, np.int64)
        if not self.blocks:
            return best, who
        cost = np.concatenate([[0], np.cumsum(self.entry[queries.term + 1] - self.entry[queries.term])])[queries.first]
        a = 0
        while a < len(queries):
            b = max(a + 1, min(a + QUERIES, int(np.searchsorted(cost, cost[a] + STEP, "right")) - 1))
            best[a:b], who[a:b] = self._nearest(queries.take(a, b), k, None if besides is None else besides[a:b])
            a = b
        return best, who

    def _nearest(self, queries: Sparse, k: int, besides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, blocks = len(queries), self.blocks
        row, place = queries.row(), self.frequent[queries.term]
        often = np.zeros((n, len(self.matrix_largest)))
        often[row[place >= 0], place[place >= 0]] = queries.value[place >= 0]
        size = self.entry[queries.term + 1] - self.entry[queries.term]
        entries = _ranges(self.entry[queries.term], size)
        order = np.argsort(self.block[entries], kind="stable")  # a block's entries stand together
        entries, of, factor = entries[order], np.repeat(row, size)[order], np.repeat(queries.value, size)[order]
        edges = np.searchsorted(self.block[entries], np.arange(blocks + 1))
        # no example of a block is nearer than this
        bounds = np.bincount(of * blocks + self.block[entries], factor * self.largest[entries], n * blocks).reshape(n, blocks)
        bounds = bounds + often @ self.matrix_largest.astype(np.float64)
        order = np.argsort(-bounds, axis=1, kind="stable")
        falling = np.take_along_axis(bounds, order, 1)
        best, who = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        done, width = 0, 1
        while done < blocks:
            look = falling[:, done : done + width]
            go = (look > 0) & (look >= best[:, -1:] - 10.0**-DECIMALS)
            if not go.any():
                break
            opened = np.zeros((n, blocks), bool)
            q, at = np.nonzero(go)
            opened[q, order[q, done + at]] = True
            for b in np.flatnonzero(opened.any(axis=0)).tolist():
                part = slice(edges[b], edges[b + 1])
                self._score(b, np.flatnonzero(opened[:, b]), of[part], entries[part], factor[part], often, best, who, besides)
            done, width = done + width, 2 * width
        return best, who

    def _score(self, b: int, rows: np.ndarray, of: np.ndarray, entries: np.ndarray, factor: np.ndarray, often: np.ndarray, best: np.ndarray, who: np.ndarray, besides: np.ndarray | None) -> None:
        """Cosines of the queries `rows` with all examples of block b, merged into best and who; entries are b's, each of query `of`."""
        slot = np.full(len(often), -1, np.int64)
        slot[rows] = np.arange(len(rows))
        cosine = often[rows] @ self.matrix[b].astype(np.float64)
        use = np.flatnonzero(slot[of] >= 0)
        e = entries[use]
        number = self.posting[e + 1] - self.posting[e]
        places = _ranges(self.posting[e], number)
        at = np.repeat(slot[of[use]] * BLOCK, number) + self.example[places]
        cosine = np.round(cosine + np.bincount(at, np.repeat(factor[use], number) * self.weight[places], cosine.size).reshape(cosine.shape), DECIMALS)
        q, at = np.nonzero((cosine > 0) & (cosine >= best[rows, -1:]))
        self._merge(rows[q], b * BLOCK + at, cosine[q, at], best, who, besides)

    def _merge(self, q: np.ndarray, example: np.ndarray, cosine: np.ndarray, best: np.ndarray, who: np.ndarray, besides: np.ndarray | None) -> None:
        n, k = best.shape
        if besides is not None:
            other = self.doc_ids[example] != besides[q]
            q, example, cosine = q[other], example[other], cosine[other]
        if not len(q):
            return
        touched = np.zeros(n, bool)
        touched[q] = True
        held = np.flatnonzero((who >= 0) & touched[:, None])
        q = np.concatenate([held // k, q])
        example = np.concatenate([who.reshape(-1)[held], example])
        cosine = np.concatenate([best.reshape(-1)[held], cosine])
        order = np.lexsort((example, self.doc_ids[example], -cosine, q))
        q, example, cosine = q[order], example[order], cosine[order]
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        nth = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        top = nth < k
        best[q[top], nth[top]], who[q[top], nth[top]] = cosine[top], example[top]


def votes(index: Index, best: np.ndarray, who: np.ndarray, prior: float) -> np.ndarray:
    """The similarity-weighted share of label 1, drawn to the prior; -1 for texts without neighbours."""
    weight = best**2
    if not len(index.labels):
        return np.full(len(best), -1.0)
    share = (weight * np.where(who >= 0, index.labels[who], 0)).sum(axis=1)
    return np.where(weight.sum(axis=1) > 0, (share + PRIOR_WEIGHT * prior) / (weight.sum(axis=1) + PRIOR_WEIGHT), -1.0)


def monotone(v: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising function from votes to the weighted share of label 1.

    The ends of every pooled stretch are points, and each share is drawn to the overall one by the weight of one row.
    """
    if not len(v):
        return np.zeros(0), np.zeros(0)
    weight = np.ones(len(v)) if weight is None else weight
    points, at = np.unique(v, return_inverse=True)
    sizes, sums = np.bincount(at, weight), np.bincount(at, weight * y)
    pools: list[list[float]] = []  # low, high, size, sum
    for x, size, total in zip(points.tolist(), sizes.tolist(), sums.tolist()):
        pools.append([x, x, size, total])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, size, total = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = high, pools[-1][2] + size, pools[-1][3] + total
    prior, one = float(sums.sum() / sizes.sum()), float(sizes.sum() / len(v))
    smooth = np.maximum.accumulate([(p[3] + prior * one) / (p[2] + one) for p in pools])
    x = np.array([[p[0], p[1]] for p in pools]).reshape(-1)
    keep = np.concatenate([[True], x[1:] > x[:-1]])
    return x[keep], np.repeat(smooth, 2)[keep]


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    index: Index
    prior: float
    points: tuple[np.ndarray, np.ndarray]

    def vectors(self, column: pa.Array) -> Sparse:
        counts, words = self.vocabulary.counts(column)
        return unit_vectors(counts, words, self.weights)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best, who = self.index.nearest(self.vectors(column))
        v = votes(self.index, best, who, self.prior)
        x, y = self.points
        if not len(x):
            return np.full(len(column), self.prior), best, who
        # a little of the vote itself, so that scores keep its order where the fit is level
        return np.clip(0.98 * np.interp(v, x, y) + 0.02 * np.clip(v, 0, 1), 0.0, 1.0), best, who


def relevance(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Root of twice the log likelihood ratio of a term's frequencies in both labels, drawn to 0 for few examples."""
    n, total = n0 + n1, all0 + all1
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = sum(np.where(a > 0, a * np.log(a * total / (n * b)), 0.0) for a, b in ((n0, all0), (n1, all1)))
    return np.sqrt(2 * np.maximum(ratio, 0)) * n / (n + HALF)


def _frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them hold each term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(shared.value.terms), np.int64), 0
        for batch in batches:
            for part in steps(batch, "text"):
                df += np.bincount(shared.value.counts(part.column("text"))[0].term, minlength=len(df))
                rows += part.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[rows], df[some]]))], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(len(vocabulary.terms))
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, most_each: int = 1200) -> Model:
    """Fit on a sample of about `most_each` examples of each label outside the held-out fold (crc32 remainder 0 of 5).

    Document frequencies cover all documents. The driver gets the sparse term counts of the sampled examples, which
    are all of the model but for those frequencies.
    """
    spark = prepare(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col(label).cast("int")) >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    empty = Sparse(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    nothing = Model(Vocabulary.of(np.zeros(0, np.uint64)), np.zeros(0), Index.of(np.zeros(0, np.int64), np.zeros(0, int), empty, 0), prior, (np.zeros(0), np.zeros(0)))
    if len(counts) < 2:
        return nothing
    rates = {y: min(1.0, most_each / counts[y]) for y in (0, 1)}
    share = F.when(F.col("y") == 1, F.lit(rates[1])).otherwise(F.lit(rates[0]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30) < share)  # about `most_each` of each label
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    sample = thinned(sample, F.lit(1.0), 2 * most_each, "toxicity")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                h, owner, words = term_hashes(part.column("text"))
                first, term, times = counted(owner, h, part.num_rows)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (term.view(np.int64), times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(words), *lists], ["doc_id", "y", "words", "terms", "times"])

    got = sample.select("doc_id", "y", "text").mapInArrow(terms, "doc_id long, y int, words long, terms array<long>, times array<long>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("words", "ascending"), ("y", "ascending")]).combine_chunks()
    ids, y, words = (got.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "y", "words"))
    if len(np.unique(y)) < 2:
        return nothing
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got.column("terms"), got.column("times"))]
    first = np.concatenate([[0], np.cumsum(columns[0].value_lengths().to_numpy())]).astype(np.int64)
    vocabulary = Vocabulary.of(columns[0].flatten().to_numpy().view(np.uint64))
    counts_of = Sparse(first, np.searchsorted(vocabulary.terms, columns[0].flatten().to_numpy().view(np.uint64)), columns[1].flatten().to_numpy().astype(np.float64))
    rows, df = _frequencies(docs, vocabulary)
    per_label = np.stack([np.bincount(counts_of.term, y[counts_of.row()] == k, len(vocabulary.terms)) for k in (0, 1)])
    weights = (np.log((1 + rows) / (1 + df)) + 1) * relevance(per_label[0], per_label[1], int((y == 0).sum()), int((y == 1).sum()))
    vectors = unit_vectors(counts_of, words, weights)
    index = Index.of(ids, y, vectors, len(vocabulary.terms))
    best, who = index.nearest(vectors, besides=ids)
    sampled_prior = float(y.mean())
    stands_for = np.where(y == 1, 1 / rates[1], 1 / rates[0])  # labelled rows for each example
    return Model(vocabulary, weights, index, sampled_prior, monotone(votes(index, best, who, sampled_prior), y, stands_for))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence: all voting examples with similarity and label."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value.index
        for batch in batches:
            for part in steps(batch, "text"):
                s, best, who = shared.value.scores(part.column("text"))
                some = who >= 0
                near = who[some]
                votes_ = pa.StructArray.from_arrays([pa.array(index.doc_ids[near]), pa.array(best[some]), pa.array(index.labels[near].astype(np.int32))], ["doc_id", "similarity", "label"])
                evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32)), votes_)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), evidence], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long"), (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, label: int>>")
