"""Benchmark decontamination with spaced seeds.

Words of test items and documents (lower case, cut at white space and ASCII punctuation; each
letter of a script without spaces is a word) become 64-bit hashes. A seed is a fixed mask over
`span` words that looks at some positions and ignores the others, so a hit survives substitutions
there. Seed hashes of the items are joined with those of all document positions; every hit names an
item and a diagonal, along which both are compared word by word.

On a diagonal the stretch whose equal words, less `PENALTY` for each other one, sum highest is
evidence if it has `min(8, 0.7 n)` equal words of an item of n; so is the whole diagonal if 0.7 n of
its words are equal, wherever the others stand. An item is leaked where the evidence of all its
diagonals covers `min(13, 0.7 n)` of its words. The two masks of three words miss no evidence: with
three equal words in a row nowhere, the best stretch is two words long; and where 0.7 n words are
equal and no three of them stand together, two of them with one more after a gap do. The longer
masks are the same hits found again in longer items.

The items' seeds are a side of checked size: while they fit `block_seeds` they are matched in one
pass; a larger benchmark is cut into blocks of that many seeds and the documents pass each block.
Hits are expanded `HITS` at a time and at once reduced to diagonals, of which a text of N words and an
item of n have N + n at most, so that texts and items of one repeated word stay bounded.

Defined cases: null or blank texts and items match nothing; an item of fewer than `LEAST_WORDS`
words is too short to tell a leak from chance within a text and matches only texts that consist of
just its words; equal items each get their rows; a null doc_id or item_id is reported like any
other; very long texts are compared whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, steps, utf8
from hustings.llm.wordhash import PUNCTUATED, hashes, lowered, mixed, spans_and_letters

#: Looked-at positions of each mask.
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 2, 3, 5, 6, 9, 10, 11), (0, 1, 3, 4, 6, 8, 9, 11), (0, 1, 2, 3, 4, 5, 6, 7))
#: In items of any length; see above for why these two miss nothing.
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
LEAST_WORDS = 5
#: An overlap counts from this many equal words, or this share of a shorter item.
ENOUGH_WORDS, ENOUGH_SHARE = 13, (7, 10)
#: What a substituted word costs against an equal one in the search for the best overlap.
PENALTY = 2
_TABLE_BITS = 20
#: Hits that are expanded at a time.
HITS = 1 << 20


def _multipliers(mask: tuple[int, ...]) -> np.ndarray:
    return np.random.default_rng(len(mask) * 1000 + sum(mask)).integers(1, 1 << 63, len(mask), dtype=np.uint64) | np.uint64(1)


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for offset, factor in zip(mask, _multipliers(mask)):
        total += words[offset : offset + n] * factor
    return mixed(total)


def item_masks(n_words: int) -> list[tuple[int, ...]]:
    """The masks that fit an item."""
    return [m for m in (*MASKS, *SHORT_MASKS) if m[-1] < n_words] if n_words >= LEAST_WORDS else []


@dataclass
class Index:
    """Seeds of some items: for each mask sorted hashes with item and position; items too short for seeds by their words."""

    item_ids: list
    words: list[np.ndarray]
    seeds: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    tiny: dict[bytes, list[int]]


def build(items: list[tuple[int, np.ndarray]]) -> Index:
    parts: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
    for k, (_, words) in enumerate(items):
        for mask in item_masks(len(words)):
            parts.setdefault(mask, []).append((seed_hashes(words, mask), k))
    seeds = {}
    for mask, found in parts.items():
        h = np.concatenate([x for x, _ in found])
        item = np.concatenate([np.full(len(x), k) for x, k in found])
        at = np.concatenate([np.arange(len(x)) for x, _ in found])
        order = np.argsort(h, kind="stable")
        filter_ = np.zeros(1 << _TABLE_BITS, bool)
        filter_[h >> np.uint64(64 - _TABLE_BITS)] = True
        seeds[mask] = (h[order], item[order], at[order], filter_)
    tiny: dict[bytes, list[int]] = {}
    for k, (_, words) in enumerate(items):
        if 0 < len(words) < LEAST_WORDS:
            tiny.setdefault(words.tobytes(), []).append(k)
    return Index([i for i, _ in items], [w for _, w in items], seeds, tiny)


def hits(index: Index, words: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """Distinct (text, item, diagonal) triples, the diagonal as the word at which the item would start."""
    out = np.zeros((0, 3), np.int64)
    held, size = [], 0
    for mask, (known, item, at, filter_) in index.seeds.items():
        h = seed_hashes(words, mask)
        if not len(h):
            continue
        maybe = np.flatnonzero(filter_[h >> np.uint64(64 - _TABLE_BITS)])
        maybe = maybe[doc_of[maybe] == doc_of[maybe + mask[-1]]]
        a, b = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
        maybe, a, n = maybe[b > a], a[b > a], (b - a)[b > a]
        for c in _chunks(n):
            place = np.repeat(maybe[c], n[c])
            row = np.repeat(a[c] - (np.cumsum(n[c]) - n[c]), n[c]) + np.arange(int(n[c].sum()))
            held.append(np.stack([doc_of[place], item[row], place - at[row]], axis=1))
            size += len(place)
            if size > HITS:
                out, held, size = distinct_rows([out, *held]), [], 0
    return distinct_rows([out, *held])


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Slices whose numbers sum to about `HITS`."""
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
        yield slice(a, b)
        a = b


def distinct_rows(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[: len(rows)]]


def best_overlap(equal: np.ndarray) -> tuple[int, int]:
    """The stretch whose equal words, less `PENALTY` for each other one, sum highest."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    low = np.minimum.accumulate(sums)
    stop = int(np.argmax(sums - low))
    return int(np.argmin(sums[: stop + 1])), stop


def promising(index: Index, found: np.ndarray, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The hits whose diagonal has enough equal words in all."""
    sizes = np.array([len(w) for w in index.words], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([np.zeros(0, np.uint64), *index.words])
    out = [found[:0]]
    for c in _chunks(sizes[found[:, 1]]):
        part = found[c]
        d, k, diagonal = part.T
        a, b = np.maximum(firsts[d], diagonal), np.minimum(firsts[d + 1], diagonal + sizes[k])
        n = b - a
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = words[np.repeat(a, n) + step] == flat[np.repeat(at[k] + a - diagonal, n) + step]
        total = np.add.reduceat(equal, np.cumsum(n) - n, dtype=np.int64)
        out.append(part[total >= np.minimum(8, enough(sizes[k]))])
    return np.concatenate(out)


def enough(n_words: int | np.ndarray) -> int | np.ndarray:
    """The least number of words that is `ENOUGH_SHARE` of an item."""
    return -(-n_words * ENOUGH_SHARE[0] // ENOUGH_SHARE[1])


def overlaps(index: Index, words: np.ndarray, firsts: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, equal words, first word, last word + 1) of each leak; words count within the whole array."""
    coverage: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}
    for d, k, diagonal in promising(index, hits(index, words, doc_of), words, firsts).tolist():
        item = index.words[k]
        a, b = max(int(firsts[d]), diagonal), min(int(firsts[d + 1]), diagonal + len(item))
        equal = words[a:b] == item[a - diagonal : b - diagonal]
        if equal.sum() >= enough(len(item)):
            at = np.flatnonzero(equal)
            x, y = int(at[0]), int(at[-1]) + 1
        else:
            x, y = best_overlap(equal)
            if equal[x:y].sum() < min(8, enough(len(item))):
                continue
        covered, low, high = coverage.get((d, k)) or (np.zeros(len(item), bool), 1 << 60, 0)
        covered[a - diagonal + x : a - diagonal + y] |= equal[x:y]
        coverage[d, k] = covered, min(low, a + x), max(high, a + y)
    for (d, k), (covered, low, high) in coverage.items():
        n = int(covered.sum())
        if n >= min(ENOUGH_WORDS, enough(len(covered))):
            yield d, k, n, low, high
    sizes = np.diff(firsts)
    for d in np.flatnonzero((sizes > 0) & (sizes < LEAST_WORDS)).tolist():
        for k in index.tiny.get(words[firsts[d] : firsts[d + 1]].tobytes(), ()):
            yield d, k, int(sizes[d]), int(firsts[d]), int(firsts[d + 1])


def item_words(text: str | None) -> np.ndarray:
    data = lowered(np.frombuffer((text or "").encode(), np.uint8))
    starts, ends, _ = spans_and_letters(data, np.array([0, len(data)]), PUNCTUATED)
    return hashes(data, starts, ends)


def blocks(benchmark: DataFrame, block_seeds: int) -> Iterator[Index]:
    """Indexes of the whole benchmark, each of about `block_seeds` seeds at most."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = item_words(row["text"])
        if not len(words):
            continue
        seeds = len(words) * (len(MASKS) + len(SHORT_MASKS))
        if held and size + seeds > block_seeds:
            yield build(held)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += seeds
    if held:
        yield build(held)


def _document_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = utf8(part.column("text"))
    data = lowered(raw)
    starts, ends, firsts = spans_and_letters(data, offsets, PUNCTUATED)
    doc_of = np.repeat(np.arange(part.num_rows), np.diff(firsts))
    return raw, offsets, hashes(data, starts, ends), starts, ends, firsts, doc_of


def contaminated(docs: DataFrame, benchmark: DataFrame, block_seeds: int = 1 << 20) -> DataFrame:
    """doc_id, item_id, n_equal (equal words), n_item (words of the item), start, end (bytes of the overlap in the text)."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, n_equal long, n_item long, start long, end long"
    out = None
    for index in blocks(benchmark, block_seeds):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part in steps(batch, "text"):
                    _, offsets, words, starts, ends, firsts, doc_of = _document_words(part)
                    found = list(overlaps(index, words, firsts, doc_of))
                    ids = part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                    columns = [
                        [index.item_ids[f[1]] for f in found],
                        [f[2] for f in found],
                        [len(index.words[f[1]]) for f in found],
                        [int(starts[f[3]] - offsets[f[0]]) for f in found],
                        [int(ends[f[4] - 1] - offsets[f[0]]) for f in found],
                    ]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "n_equal", "n_item", "start", "end"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_seeds: int = 1 << 20) -> DataFrame:
    """The documents without an overlap with any item; all columns stay as they are."""
    spark = prepare(docs.sparkSession)
    for index in blocks(benchmark, block_seeds):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    _, _, words, _, _, firsts, doc_of = _document_words(part)
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in overlaps(shared.value, words, firsts, doc_of)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
