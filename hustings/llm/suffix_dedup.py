"""Repeated passages by sparse suffix arrays.

Texts are sequences of word hashes; texts of the same words form a class and count once. Suffixes
are retained only where a minimiser lies: at the rightmost smallest hash of `GRAM` words in every
window of `least - prefix + 1` positions. A passage of `least` words holds at least one such
position with `prefix` words of the passage after it, and the position depends on those words
alone, so both copies retain it. A retained suffix whose first `prefix` words nobody shares has
neighbours in sorted order that differ before, and goes.

Only the texts of the others are read a second time. Each is extended to the left and to the right
as far as a passage of `least` words can still hold it, which gives the suffixes in its reach. These
are sorted by their first `least` words over the whole table, in ranges that may part equal ones, and
neighbours are compared: those with `least` words in common are repeats, and what lies next to each
other in a text joins to maximal spans. The first and last entries of a range are compared across the
seam, from a table of two rows for each range. The order is that of two independent 64-bit hashes of
those words, under which equal beginnings stand together as they do in the alphabetical one.

Sorting suffixes rather than comparing pairs keeps the work in proportion to the candidates when
thousands of documents share a passage, and misses no pair.

Defined cases: null and blank texts and texts of fewer than `least` words hold no passage; copies
of a document of at least `least` words are repeats as wholes and are named as such (class_id, the
smallest id among them, null if none has one); a passage that repeats within one document only counts
too; different texts under one doc_id are different documents and each gets a row; rows without a
doc_id count and are reported like any other; a row that repeats id and text is a copy; very long
texts count whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import Scratch, prepare, steps, utf8
from hustings.llm.wordhash import BASE, INVERSE, hashes, lowered, mixed, powers, rolling, spans

#: Words of a passage at least, words by which retained suffixes are keyed, and words of a minimiser's gram.
LEAST, PREFIX, GRAM = 50, 30, 6
#: What makes the second, independent hash of a word.
SECOND = np.uint64(0xA24BAED4963EE407)


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, their starts and ends in bytes within their text, the first word of each text, and each word's text."""
    raw, offsets = utf8(part.column("text"))
    data = lowered(raw)
    starts, ends, firsts = spans(data, offsets)
    owner = np.repeat(np.arange(part.num_rows), np.diff(firsts))
    return hashes(data, starts, ends), starts - offsets[owner], ends - offsets[owner], firsts, owner


def retained(words: np.ndarray, owner: np.ndarray, least: int = LEAST, prefix: int = PREFIX, gram: int = GRAM) -> np.ndarray:
    """Positions of minimisers that have `prefix` words of their text from there on."""
    window = least - prefix + 1
    n = len(words) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    # the hash above, the position counted down below: equal hashes give the rightmost
    value = (rolling(words, gram) & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    width = 1
    while width < window:
        step = min(width, window - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    whole = owner[: len(value)] == owner[np.minimum(np.arange(len(value)) + least - 1, len(owner) - 1)]
    whole &= np.arange(len(value)) + least <= len(words)
    return np.unique((np.uint64(0xFFFFFFFF) - (value[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64))


def wholes(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One hash for each text's whole sequence of words."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:], dtype=np.uint64)
    return mixed((sums[firsts[1:]] - sums[firsts[:-1]]) * powers(INVERSE, len(words) + 1)[firsts[:-1]]).view(np.int64)


def suffixes(texts: DataFrame, least: int, prefix: int) -> DataFrame:
    """(key, whole, again): distinct keys of retained suffixes of each text, the text's class, and whether the key comes twice in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, _, _, firsts, owner = _words(part)
                at = retained(words, owner, least, prefix)
                if not len(at):
                    continue
                keys, of = rolling(words, prefix)[at].view(np.int64), owner[at]
                order = np.lexsort((keys, of))
                keys, of = keys[order], of[order]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
                head = np.flatnonzero(new)
                again = np.diff(np.append(head, len(keys))) > 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[head]), pa.array(wholes(words, firsts)[of[head]]), pa.array(again)], ["key", "whole", "again"])

    return texts.select("text").mapInArrow(run, "key long, whole long, again boolean")


def windows(candidates: DataFrame, least: int, prefix: int) -> DataFrame:
    """(w, v, whole, at): the suffixes in reach of wanted retained ones, by two hashes of their first `least` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, _, _, firsts, owner = _words(part)
                at = retained(words, owner, least, prefix)
                if not len(at):
                    continue
                # a retained suffix is wanted if its key is among its own text's keys
                lists = part.column("keys")
                asked = np.stack([np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()], axis=1)
                have = np.stack([owner[at], rolling(words, prefix)[at].view(np.int64)], axis=1)
                at = at[_among(have, asked)]
                begin = (at[:, None] - np.arange(least - prefix + 1)[None, :]).reshape(-1)
                text = np.repeat(owner[at], least - prefix + 1)
                begin = np.unique(begin[(begin >= firsts[text]) & (begin + least <= firsts[text + 1])])
                text = owner[begin]
                hashed = [rolling(x, least)[begin].view(np.int64) for x in (words, mixed(words ^ SECOND))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashed), part.column("whole").take(pa.array(text)), pa.array((begin - firsts[text]).astype(np.int32))], ["w", "v", "whole", "at"])

    return candidates.mapInArrow(run, "w long, v long, whole long, at int")


def _among(have: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which rows of `have` are rows of `asked`."""
    both = np.concatenate([have, asked])
    _, code = np.unique(both, axis=0, return_inverse=True)
    code = code.reshape(-1)
    wanted = np.zeros(int(code.max(initial=-1)) + 1, bool)
    wanted[code[len(have) :]] = True
    return wanted[code[: len(have)]]


def neighbours(held: DataFrame, scratch: Scratch) -> DataFrame:
    """(whole, at) of the suffixes (w, v, whole, at) whose first words another suffix has too."""
    names = ["w", "v", "whole", "at", "sure", "edge"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeats within a sorted range, and one suffix of its first and its last beginning, which may go on beyond it."""
        first, last = True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names[:4]], axis=1)
            if last is not None:
                rows = np.concatenate([last, rows])
            same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            other = (rows[1:, 2:] != rows[:-1, 2:]).any(axis=1)  # a text that comes in several rows is no neighbour of itself
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            run = np.cumsum(np.concatenate([[True], ~same])) - 1
            repeated = np.bincount(run[1:], same & other, len(head)) > 0
            # of the last beginning two different rows are enough to go on with
            tail = head[-1]
            keep = slice(tail, len(rows))
            done = slice(0, tail)
            last = rows[keep] if repeated[-1] else rows[keep][:1]
            if len(last) > 1 and repeated[-1]:
                yield _flagged(last, True, first and len(head) == 1, names)
                last = np.stack([last[0], last[int(np.flatnonzero((last[:, 2:] != last[0, 2:]).any(axis=1))[0])]])
            if tail:
                sure = repeated[run[done]]
                edge = np.zeros(tail, bool)
                edge[0] = first
                use = sure | edge
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows[done][use][:, :3].T), pa.array(rows[done][use][:, 3].astype(np.int32)), pa.array(sure[use]), pa.array(edge[use])], names)
                first = False
        if last is not None:
            yield _flagged(last, len(last) > 1 and bool((last[:, 2:] != last[0, 2:]).any()), True, names)

    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["w", "v", "whole", "at"]
    array = held.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = scratch.save(array.mapInArrow(compare, "w long, v long, whole long, at int, sure boolean, edge boolean"), "compared")
    place = F.struct("whole", "at")
    seams = found.where("edge").groupBy("w", "v").agg((F.min(place) != F.max(place)).alias("more")).where("more").select("w", "v")  # two rows a range at most
    late = found.where("edge and not sure").join(F.broadcast(seams), ["w", "v"], "left_semi")
    return found.where("sure").select("whole", "at").unionByName(late.select("whole", "at"))


def _flagged(rows: np.ndarray, sure: bool, edge: bool, names: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows[:, :3].T), pa.array(rows[:, 3].astype(np.int32)), pa.array(np.full(n, sure)), pa.array(np.full(n, edge))], names)


def spans_of(found: DataFrame, least: int) -> DataFrame:
    """(whole, spans): maximal runs of repeated windows as first word and number of words, in order."""
    runs = found.groupBy("whole").agg(F.array_sort(F.collect_set("at")).alias("at"))
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("at")
            at = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            if not len(at):
                continue
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)]))
            tail = np.append(head[1:], len(at)) - 1
            spans_ = pa.StructArray.from_arrays([pa.array(at[head].astype(np.int32)), pa.array((at[tail] - at[head] + least).astype(np.int32))], ["first_word", "n_words"])
            offsets = np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.ListArray.from_arrays(pa.array(offsets), spans_).cast(kind)], ["whole", "spans"])

    return runs.mapInArrow(run, "whole long, spans array<struct<first_word: int, n_words: int>>")


def repeats(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX) -> DataFrame:
    """One row for each document that holds a repeated passage.

    doc_id; class_id: the smallest doc_id with the same text; copies: how many rows have that
    text; spans: array of struct (first_word, n_words), the maximal repeated passages in words of
    the text; n_repeated: words they hold.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, _, _, firsts, _ = _words(part)
                hashed = [wholes(x, firsts) for x in (words, mixed(words ^ SECOND))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("same"), *map(pa.array, hashed), pa.array(np.diff(firsts).astype(np.int64))], ["doc_id", "same", "whole", "check", "n_words"])

    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("same"), "text")
    members = scratch.save(rows.mapInArrow(digest, "doc_id long, same long, whole long, check long, n_words long"), "members").where(F.col("n_words") >= least)
    # one row of a class stands for its text: that of the smallest id, or else of the smallest hash of the text as it is written
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("first")
    classes = scratch.save(members.groupBy("whole", "check").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max("n_words").alias("n_words"), first), "classes")
    keyed = scratch.save(suffixes(rows, least, prefix), "suffixes")
    # copies of one text agree in their class: a key is shared if two classes have it, or one text has it twice
    counts = keyed.groupBy("key").agg(F.min("whole").alias("a"), F.max("whole").alias("b"), F.max("again").alias("again"))
    # written first: the join then has two plain shuffles, of which Spark splits the one that a hot key fills;
    # hints keep the plan alike at every size
    shared = scratch.save(counts.where("a <> b or again").select("key"), "shared")
    wanted = keyed.join(shared.hint("merge"), "key").groupBy("whole").agg(F.collect_set("key").alias("keys"))
    own = classes.select("whole", F.col("first.doc_id").alias("first_id"), F.col("first.same").alias("first_same"))
    wanted = scratch.save(wanted.join(own.hint("merge"), "whole"), "wanted")
    scratch.drop(keyed)
    scratch.drop(shared)
    stands = (F.col("same") == F.col("first_same")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    candidates = rows.join(wanted.hint("merge"), stands).select("whole", "text", "keys")
    held = scratch.save(windows(candidates, least, prefix), "windows")
    scratch.drop(wanted)
    spans_ = spans_of(neighbours(held, scratch), least)
    by_class = classes.join(spans_, "whole", "left")
    entire = F.array(F.struct(F.lit(0).alias("first_word"), F.col("n_words").cast("int").alias("n_words")))
    marked = by_class.withColumn("spans", F.when(F.col("copies") > 1, entire).otherwise(F.col("spans"))).where("spans is not null")
    marked = scratch.save(marked.select("whole", "check", "class_id", "copies", "spans"), "marked")
    scratch.drop(held)
    out = members.select("doc_id", "whole", "check").join(marked, ["whole", "check"])
    return out.select("doc_id", "class_id", "copies", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["n_words"]).alias("n_repeated"))
