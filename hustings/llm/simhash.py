"""SimHash near-duplicates by bit-sliced comparison.

Two fingerprints that differ in at most `radius` bits agree on all but `radius` of the bands
that 64 bits are cut into. So each fingerprint is dealt to one bucket for every choice of the
other bands: 28 choices for 8 bands and radius 2, 48 bits alike. A bucket holds distinct
fingerprints that can only differ in 16 bits, hence 65,536 at most, whatever the number of
documents. In a bucket the bit planes stand vertically (64 fingerprints to a machine word), and
carry-save counters add the differing bits of many pairs at once; a block is left once all its
pairs exceed the radius. Small buckets lie end to end in the same planes and are compared with
themselves shifted. Only a spanning star of each linked set leaves a bucket, never all pairs.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal texts
share a fingerprint and so a component; rows link through their texts alone, so different texts
under one doc_id link nothing, and rows without a doc_id link like any other; a null doc_id never
is the smallest of its component unless all are null; repeated rows come back as often as they
came; very long texts are shingled whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import Scratch, prepare, steps, texts
from hustings.llm.components import connected_components

SEED = 42
BANDS = 8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Buckets up to this size lie together in the same planes.
FEW = 8
#: Rows of a bit-sliced block, words of one of packed buckets, and planes between two looks at whether a block can be left.
BLOCK, PACKED, LOOK = 256, 1024, 4


def same(text: Column) -> Column:
    """A hash by which the texts of one id are told apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 of every shingle of `size` words (fewer words: of the whole sequence; none: nothing)."""
    words = text.encode().translate(LOWER).split()  # bytes.split() cuts at space and \t\n\v\f\r
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half of the hashes have set."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    return majority(shingle_hashes(text or "", size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, same, fp): same is a hash of the text, fp the unsigned fingerprint in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                fps = np.fromiter((fingerprint(t, size) for t in texts(part.column("text")).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), pa.array(fps.view(np.int64))], ["doc_id", "same", "fp"])

    return docs.select(F.col("doc_id").cast("long"), same(F.col("text")).alias("same"), "text").mapInArrow(run, "doc_id long, same long, fp long")


def band_masks(radius: int, bands: int = BANDS) -> list[int]:
    """Masks, as signed longs, of every choice of all bands but `radius`."""
    width = 64 // bands
    out = []
    for gone in combinations(range(bands), radius):
        mask = (1 << 64) - 1
        for b in gone:
            mask &= ~(((1 << width) - 1) << (b * width))
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def near_rows(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row i with any, the later rows j > i within the radius, from vertical bit planes.

    `ones` and `twos` are the two lowest bits of 64 counters to a word; a carry out of `twos` or,
    for smaller radii, a count above the radius marks a pair as `over` for good. A block of rows
    is left as soon as all its pairs are over.
    """
    assert 0 <= radius <= 3
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    varied = np.flatnonzero(bits[:n].min(axis=0) != bits[:n].max(axis=0))  # planes alike in all rows add nothing
    planes = [np.packbits(bits[:, b], bitorder="little").view(np.uint64) for b in varied]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for a in range(0, n, BLOCK):
        rows = np.arange(a, min(n, a + BLOCK))
        first = a // 64  # earlier rows have met these already
        column = np.arange(first * 64, words * 64)
        over = np.packbits((column[None, :] <= rows[:, None]) | (column >= n)[None, :], axis=1, bitorder="little").view(np.uint64)
        ones = np.zeros((len(rows), words - first), np.uint64)
        twos = ones.copy()
        left = over.min() == full
        for k, b in enumerate(varied):
            if left:
                break
            flip = np.where(bits[rows, b] == 1, full, np.uint64(0))[:, None]
            differ = planes[k][None, first:] ^ flip
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if k % LOOK == LOOK - 1:
                left = (over | _above(ones, twos, radius)).min() == full
        if left:
            continue
        near = ~(over | _above(ones, twos, radius))
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            yield a + r, first * 64 + np.flatnonzero(np.unpackbits(near[r].view(np.uint8), bitorder="little"))


def _above(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    """Which of the two-bit counts exceed the radius."""
    if radius == 3:
        return np.zeros_like(ones)
    return {0: ones | twos, 1: twos, 2: ones & twos}[radius]


def star(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every linked set of a bucket, edges from its first row to each other row."""
    pairs = [(np.full(len(j), i), j) for i, j in near_rows(fps, radius)]
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    top = np.arange(len(fps))
    while True:  # both ends take the smaller label, then the label of their label
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = new[new]
        if (new == top).all():
            break
        top = new
    b = np.flatnonzero(top != np.arange(len(fps)))
    return top[b], b


def packed_pairs(key: np.ndarray, fps: np.ndarray, radius: int, shift: int) -> np.ndarray:
    """Rows i whose bucket also holds row i + shift, within the radius: planes of all rows against themselves shifted."""
    assert 0 < shift < 64
    n = len(fps)
    out = []
    step = PACKED * 64
    for a in range(0, n - shift, step):
        rows = fps[a : a + step + 64]  # one word beyond the block feeds the shift
        words = -(-min(step, n - a) // 64)
        bits = np.zeros(((words + 1) * 64, 64), np.uint8)
        bits[: len(rows)] = np.unpackbits(rows.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[: len(bits)]
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
        same = np.zeros(words * 64, bool)
        m = min(words * 64, n - shift - a)
        same[:m] = key[a : a + m] == key[a + shift : a + shift + m]
        over = ~np.packbits(same, bitorder="little").view(np.uint64)
        ones, twos = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for k, plane in enumerate(planes):
            differ = plane[:-1] ^ (plane[:-1] >> np.uint64(shift) | plane[1:] << np.uint64(64 - shift))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if k % LOOK == LOOK - 1 and (over | _above(ones, twos, radius)).min() == np.uint64(0xFFFFFFFFFFFFFFFF):
                break
        near = ~(over | _above(ones, twos, radius))
        out.append(a + np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bucket_edges(key: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the reps of whole buckets that lie in key order."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(cuts, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))  # a bucket of one has no pair
    for d in range(1, int(sizes[(sizes > 1) & (sizes <= FEW)].max(initial=1))):
        i = packed_pairs(key[few], fps[few], radius, d)
        left.append(reps[few[i]])
        right.append(reps[few[i + d]])
    for c, n in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        i, j = star(fps[c : c + n], radius)
        left.append(reps[c + i])
        right.append(reps[c + j])
    return np.concatenate(left), np.concatenate(right)


def links(classes: DataFrame, radius: int = 2, bands: int = BANDS) -> DataFrame:
    """(fp, rep) with distinct fp to edges (a, b) between reps: enough to connect all that link."""
    masks = band_masks(radius, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last bucket seen, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("t", "key", "fp", "rep")]
            t, key, fp, rep = (np.concatenate([x, y]) for x, y in zip(held, new)) if held else new
            same = (t == t[-1]) & (key == key[-1])
            last = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [x[last:] for x in (t, key, fp, rep)]
            if last:
                yield edges(t[:last], key[:last], fp[:last], rep[:last])
        if held:
            yield edges(*held)

    def edges(t: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
        a, b = bucket_edges(bucket, fp.view(np.uint64), rep, radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    buckets = F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks))))
    dealt = classes.select("fp", "rep", buckets.alias("x")).select("x.t", "x.key", "fp", "rep")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """doc_id, same, fp, root (smallest fingerprint of the component) and component_id of every row."""
    scratch = Scratch(prepare(docs.sparkSession))
    fps = scratch.save(fingerprints(docs, size), "fps")
    # a node is a fingerprint, whatever ids its rows have
    classes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    found = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), radius), scratch)
    rooted = scratch.save(classes.join(found, classes.fp == found.node, "left").select("fp", "low", F.coalesce("label", "fp").alias("root")), "rooted")
    scratch.drop(classes)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable over links."""
    return components(docs, size, radius).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """The documents without all but one of each component: the one with the smallest doc_id stays.

    Where that doc_id has several texts in the component, the one with the smallest hash stays; of rows that repeat id
    and text one stays. An id whose texts are in several components may stay with one text for each of them. Rows
    without an id form no group and stay.
    """
    named = docs.where("doc_id is not null")
    found = components(named, size, radius).where("doc_id = component_id")
    kept = found.groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("same").alias("__same")).drop("root").distinct()
    marked = named.withColumn("__text", same(F.col("text")))
    one = marked.join(kept, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__text") == F.col("__same")), "left_semi").dropDuplicates(["doc_id", "__text"])
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))
