"""Edited copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A 64-bit SimHash cannot find them: at 0.8 about ten of its bits differ, and no choice of bands is
narrow enough to find pairs so far apart. Candidates come from MinHash bands instead, and what
shares a band is compared exactly: linked candidates come together in one task, which walks the
graph of similar pairs and compares each document it reaches with those not reached yet.

A pair at just 0.8 shares one of the 32 bands of 8 values with probability 0.997, one at 0.85 with
0.99997; pairs below 0.8 are never linked by themselves.

Defined cases: words are cut at white space and compared in lower case; a text of fewer than five
words is one shingle; null and blank texts have none and are copies of nothing; equal texts are one
node, and rows that repeat id and text stay or go together; rows without an id form no group and
stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import Scratch, prepare, steps, texts, utf8
from hustings.llm.components import connected_components
from hustings.llm.wordhash import WHITE, hashes, lowered, mixed, rolling, spans

SHINGLE = 5
#: Least Jaccard similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 8
#: Bits of the filter by which rows without a partner in a join are left where they are: 64 to a word, 4 MB of words at most.
FILTER_BITS = 1 << 24
#: Shingles of one step of the minima.
CHUNK = 512
_rng = np.random.default_rng(20240811)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_KEY_FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    raw, offsets = utf8(column)
    data = lowered(raw)
    starts, ends, firsts = spans(data, offsets, WHITE)
    words = hashes(data, starts, ends)
    return [np.unique(rolling(w, min(SHINGLE, len(w)))) if len(w) else np.zeros(0, np.uint64) for w in np.split(words, firsts[1:-1])]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, from the minima of its permutations over the shingles."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), CHUNK):
        y = x[k : k + CHUNK, None] * _FACTORS + _TERMS
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, y.min(axis=0))
    total = (low.reshape(BANDS, ROWS) * _KEY_FACTORS).sum(axis=1, dtype=np.uint64)
    return mixed(total + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set that it reaches over pairs of at least the similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(vocabulary), np.int32)
    a, b = LEAST
    left = np.arange(len(sets))  # not reached yet; flat holds their shingles
    while len(left):
        reached, first = [int(left[0])], int(left[0])
        out = left == first
        while True:
            if out.any():
                root[left[out]] = first
                flat = flat[np.repeat(~out, sizes[left])]
                left = left[~out]
            if not (reached and len(left)):
                break
            i = reached.pop()
            mark[own[i]] = 1
            both = np.add.reduceat(mark[flat], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
            mark[own[i]] = 0
            out = both * (a + b) >= a * (sizes[i] + sizes[left])
            reached += left[out].tolist()
    return root


def candidates(named: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes, from the first node of each band's key to each other one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                sets = shingle_sets(part.column("text"))
                some = [k for k, s in enumerate(sets) if len(s)]
                values = pa.array(np.concatenate([np.zeros(0, np.int64), *(band_keys(sets[k]) for k in some)]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(some, pa.int64())), lists], ["node", "keys"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, top = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            head = node[np.flatnonzero(starts)][np.cumsum(starts) - 1]
            if last is not None and key[0] == last:
                head[: int(np.argmax(key != last)) if key[-1] != last else len(key)] = top
            last, top = key[-1], head[-1]
            other = head != node
            yield pa.RecordBatch.from_arrays([pa.array(head[other]), pa.array(node[other])], ["a", "b"])

    dealt = named.select("node", "text").mapInArrow(keys, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(stars, "a long, b long").distinct()


def slot(node: Column) -> Column:
    return F.pmod(node, F.lit(FILTER_BITS))


def passing(rows: DataFrame, node: Column, few: DataFrame) -> DataFrame:
    """The rows with a column `passes`: false only where no node of `few` (node) equals theirs."""
    words = few.select(slot(F.col("node")).alias("s")).groupBy(F.floor(F.col("s") / 64).alias("filter_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("filter_bits"))
    held = rows.join(F.broadcast(words), F.floor(slot(node) / 64) == F.col("filter_word"), "left")
    return held.withColumn("passes", F.coalesce(F.getbit("filter_bits", (slot(node) % 64).cast("int")) == 1, F.lit(False))).drop("filter_word", "filter_bits")


def verified(named: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the candidates (node, label): equal roots for what similar pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            root = np.array(nodes, np.int64)[groups(sets)]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(root)], ["node", "root"])

        for batch in batches:
            for part in steps(batch, "text"):
                for to, node, shingles in zip(part.column("label").to_pylist(), part.column("node").to_pylist(), shingle_sets(part.column("text"))):
                    if to != label:
                        if nodes:
                            yield done()
                        label, nodes, sets = to, [], []
                    if not nodes or node != nodes[-1]:
                        nodes.append(node)
                        sets.append(shingles)
        if nodes:
            yield done()

    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = passing(named, F.col("node"), found).where("passes")
    together = some.join(found, "node").select("label", "node", "text").repartition(n, "label").sortWithinPartitions("label", "node")
    return together.mapInArrow(run, "node long, root long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component of similar pairs: the one with the smallest doc_id stays."""
    scratch = Scratch(prepare(docs.sparkSession))
    docs = scratch.save(docs, "documents")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("node"), "text")
    found = connected_components(candidates(named), scratch)
    roots = scratch.save(verified(named, found), "roots")
    members = named.where(F.col("text").rlike(r"\S")).select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    gone = members.join(first, "root").where(F.struct("doc_id", "node") != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node"))
    gone = scratch.save(gone.distinct(), "gone")
    marked = passing(docs, F.xxhash64("text"), gone.select(F.col("gone_node").alias("node")))
    stay = marked.where("passes").join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_node")), "left_anti")
    return marked.where("not passes").unionByName(stay).select(*docs.columns)
