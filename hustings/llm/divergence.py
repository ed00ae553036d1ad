"""Source divergence audit: how far the word use of sources of one language lies apart.

A language keeps the terms that at least `LEAST_DOCS` of its documents hold. A group (language,
source) gives a kept term the share p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)) of its N
occurrences, smoothed over the V kept terms, and two shares differ by floor((p - q)**2 / (p + q)).

The divergence of two sources is a sum over all V terms, of which most do not occur in them. So a
pair starts at V times the difference of its two shares of zero counts, and an inverted index of
the terms corrects that:

- a source alone: for each of its counts, that many terms move from its share of zero to the share
  of that count, against the other source's share of zero. Terms with one count are one correction.
- both: where the postings of a term hold two sources, what the difference of their shares is beyond
  both corrections above. Equal shares and others that correct nothing are not emitted.

Corrections are added up in the tasks that emit them before the pairs are shuffled; no table of
terms x sources is made. Counts of a text are taken in the tasks that read it, a block of texts at a
time, so only (language, source, term) counts are shuffled.

Defined cases: null text, lang and source count as ''; a text without a term counts for its group
alone; groups without kept terms have shares of zero counts; in a language without kept terms all
pairs have the value 0; a language with one source has no pairs; rows that repeat are documents of
their own; doc_id plays no part; very long texts count whole (a block holds one of them); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import Scratch, prepare, steps, utf8

#: Documents of a language that hold a kept term, at least, and terms reported for a group.
LEAST_DOCS, TOP = 10, 10
#: Bytes of texts whose terms are counted together.
BLOCK_BYTES = 8 << 20
#: What a byte of a text stands for in a term: 0 ends it, capitals turn small, all bytes of further characters stay.
TERM = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs: one row or more for each combination, to be added up."""
    prepare(docs.sparkSession)

    def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Of a block: terms and groups become numbers, (document, term) pairs are sorted once."""
        raw, offsets = utf8(rows.column("text"))
        data = TERM[raw]
        inside = data != 0
        inside_ = np.concatenate([[False], inside, [False]])
        starts = np.flatnonzero(inside_[1:-1] & ~inside_[:-2])
        ends = np.flatnonzero(inside_[1:-1] & ~inside_[2:]) + 1
        if not len(starts):
            return pa.RecordBatch.from_pylist([], schema)
        cut = np.zeros(len(data) + 1, bool)  # a term ends where its text does, though nothing may stand between
        cut[offsets[1:-1]] = True
        within = np.flatnonzero(cut[:-1] & inside_[1:-1] & inside_[:-2])
        starts, ends = np.sort(np.concatenate([starts, within])), np.sort(np.concatenate([ends, within]))
        sizes = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(data[inside])).dictionary_encode()
        words = len(terms.dictionary)
        document = np.searchsorted(offsets, starts, "right") - 1
        groups = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], ["lang", "source"])
        group, group_rows = _numbered(groups)
        pair, n = np.unique(document * words + terms.indices.to_numpy(zero_copy_only=False), return_counts=True)
        key, place = np.unique(group[pair // words] * words + pair % words, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)
        some = group_rows.take(pa.array(key // words))
        return pa.RecordBatch.from_arrays([some.field("lang"), some.field("source"), terms.dictionary.take(pa.array(key % words)), pa.array(total), pa.array(np.bincount(place, minlength=len(key)).astype(np.int64))], schema=schema)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if held:
            yield counted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return named(docs).mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def _numbered(rows: pa.StructArray) -> tuple[np.ndarray, pa.StructArray]:
    """A number for each row, equal for equal rows, and the row that each number stands for."""
    lang, source = (f.dictionary_encode() for f in rows.flatten())
    both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
    _, first, number = np.unique(both, return_index=True, return_inverse=True)
    return number.astype(np.int64), rows.take(pa.array(first))


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def share(n: Column, of: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / of), in decimals: the product leaves a long behind when a term occurs 9 * 10**9 times."""
    return F.lit(1).cast("long") + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)"), of.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The tables of one corpus: postings (lang, term, source, n, p), groups (lang, source, v, zero, size) and shares of languages."""

    def __init__(self, docs: DataFrame) -> None:
        scratch = Scratch(docs.sparkSession)
        used = scratch.save(counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "counts")
        over = Window.partitionBy("lang", "term")
        kept = used.withColumn("lang_n", F.sum("n").over(over)).withColumn("docs", F.sum("n_docs").over(over)).where(F.col("docs") >= LEAST_DOCS)
        kept = scratch.save(kept.select("lang", "term", "source", "n", "lang_n"), "kept")
        terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_size"))
        sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        all_groups = named(docs).select("lang", "source").distinct()
        groups = all_groups.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "v", "lang_size")))
        groups = groups.withColumn("mass", F.col("size") + 2 * F.col("v")).withColumn("lang_mass", F.col("lang_size") + 2 * F.col("v"))
        #: zero: the share of a term that does not occur in the group; null where the language keeps no term.
        self.groups = scratch.save(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("mass")))), "groups")
        of = self.groups.select("lang", "source", "mass", "lang_mass", "zero")
        self.postings = scratch.save(kept.join(of, ["lang", "source"]).select("lang", "term", "source", "n", "zero", share(F.col("n"), F.col("mass")).alias("p"), share(F.col("lang_n"), F.col("lang_mass")).alias("q")), "postings")

    def corrections(self) -> DataFrame:
        """lang, a, b (a < b), value: what is to be added up for each pair."""
        g = self.groups.select("lang", "source", "zero", "v")
        left = g.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
        right = g.select(F.col("lang").alias("lang_"), F.col("source").alias("b"), F.col("zero").alias("zb"))
        start = left.join(right, (F.col("lang") == F.col("lang_")) & (F.col("a") < F.col("b")))
        start = start.select("lang", "a", "b", F.coalesce(F.col("v") * apart(F.col("za"), F.col("zb")), F.lit(0).cast("long")).alias("value"))
        moved = self.postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms"))
        other = right.select("lang_", F.col("b").alias("other"), "zb")
        alone = moved.join(other, (F.col("lang") == F.col("lang_")) & (F.col("source") != F.col("other")))
        alone = alone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("terms") * (apart(F.col("p"), F.col("zb")) - apart(F.col("zero"), F.col("zb")))).alias("value"))
        x = self.postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
        y = self.postings.select(F.col("lang").alias("lang_"), F.col("term").alias("term_"), F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
        both = x.join(y, (F.col("lang") == F.col("lang_")) & (F.col("term") == F.col("term_")) & (F.col("a") < F.col("b")))
        beyond = apart(F.col("pa"), F.col("pb")) - apart(F.col("pa"), F.col("zb")) - apart(F.col("za"), F.col("pb")) + apart(F.col("za"), F.col("zb"))
        both = both.select("lang", "a", "b", beyond.alias("value"))
        return start.union(alone.where("value <> 0")).union(both.where("value <> 0"))

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value, rank."""
        value = self.corrections().groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        return ranked(value.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value"))

    def terms(self, most: int = TOP) -> DataFrame:
        """lang, source, item (a term that the group uses more than its language), value, rank up to `most`."""
        over = self.postings.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        return ranked(over).where(F.col("rank") <= most)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    tables = Audit(docs)
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, rows in (("pair", tables.pairs()), ("term", tables.terms()))]
    return parts[0].union(parts[1])
