"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes by one table lookup; a finite automaton over the classes then finds
where each piece of the split pattern starts. Its transition functions compose associatively, so
a text is scanned in many blocks at once: each block is first reduced to one function from its
entry state to its exit state, those functions are composed, and a second pass marks the starts.
No regular expression runs. The slices are looked up in a bounded cache of merged pieces; pieces
that are not cached are merged together, one lowest-ranked pair a piece and round, over arrays; a piece of more
than `LONG_PIECE` bytes is merged by itself with a heap of pairs, in time n log n.

Defined cases: a null text is the empty text and has no tokens; special-token strings are
ordinary text; a text of any length, and a piece of any length, is encoded whole; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, steps, texts

#: Classes of code points and of what stands around them; + 8 where a text starts.
LETTER, NUMBER, OTHER, GLUE, LAST_SPACE, SPACE, SHORT, LONG = range(8)
#: States: no open piece, in a run of letters, numbers or others, after a space that opens a piece,
#: in white space, and with one or two characters of a contraction to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, OPENED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
#: Code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions the pattern knows, by what follows the apostrophe.
SHORT_TAILS, LONG_TAILS = "stmd", ("re", "ve", "ll")
#: Merged pieces that one process keeps; beyond, the cache starts anew.
CACHED = 1 << 18
#: Bytes of a piece from which a heap orders its merges.
LONG_PIECE = 512
BLOCK = 2048


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]."""
    to, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for c in range(8):
        for s in range(8):
            if c in runs:
                to[c, s], cut[c, s] = runs[c], s not in (runs[c], OPENED)
            elif c in (SHORT, LONG):
                inside = s in (IN_OTHERS, OPENED)  # the apostrophe belongs to a run of others
                to[c, s], cut[c, s] = (IN_OTHERS, False) if inside else (ONE_MORE if c == SHORT else TWO_MORE, True)
            elif c == GLUE:
                to[c, s] = OPENED
            elif c == LAST_SPACE:
                to[c, s] = CLOSED
            else:
                to[c, s], cut[c, s] = IN_SPACE, s != IN_SPACE
        if c == LETTER:
            to[c, ONE_MORE], cut[c, ONE_MORE] = CLOSED, False
            to[c, TWO_MORE], cut[c, TWO_MORE] = ONE_MORE, False
        to[c + 8], cut[c + 8] = to[c, CLOSED], cut[c, CLOSED]  # a new text forgets the state
    return to, cut


NEXT, STARTS = _automaton()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's input; firsts: where texts start (ascending, below the length)."""
    out = code_point_classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, bool)
    begins[firsts] = True
    begins[n] = True
    space = out == SPACE
    followed = np.zeros(n, bool)  # by something in the same text that is not white space
    followed[:-1] = ~space[1:] & ~begins[1:n]
    out[space & followed] = LAST_SPACE
    out[(points == 0x20) & followed] = GLUE
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ends = np.append(firsts[1:], n)[np.searchsorted(firsts, quotes, "right") - 1]  # of the texts they stand in
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = (quotes + 1 < ends) & np.isin(one, [ord(c) for c in SHORT_TAILS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_TAILS:
            long |= (one == ord(a)) & (two == ord(b))
        out[quotes[short]] = SHORT
        out[quotes[long & (quotes + 2 < ends)]] = LONG
    out[firsts] += 8
    return out


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Positions where pieces start, by a blocked scan over composed transition functions."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    k = min(BLOCK, max(16, int(n**0.5)))
    blocks = -(-n // k)
    grid = np.full(blocks * k, SPACE, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, k).T).astype(np.intp)  # a column is a block
    flat = NEXT.astype(np.intp)
    through = np.repeat(np.arange(8)[None, :], blocks, axis=0)  # exit state of each block by entry state
    for row in grid:
        through = flat[row[:, None], through]
    reach = 1
    while reach < blocks:  # row b becomes the function of all blocks up to b
        through[reach:] = np.take_along_axis(through[reach:], through[:-reach].copy(), 1)
        reach *= 2
    entry = np.concatenate([[0], through[:-1, 0]])
    cut = np.empty((k, blocks), bool)
    state = entry
    for i, row in enumerate(grid):
        cut[i] = STARTS[row, state]
        state = flat[row, state]
    return np.flatnonzero(cut.T.reshape(-1)[:n])


class Tokenizer:
    """Ranks of one vocabulary file, with arrays for merging and a cache of merged pieces."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._hash_pairs(pairs)
        self._forget()

    def _hash_pairs(self, pairs: dict[int, int]) -> None:
        """Open addressing in two arrays; a lookup takes as many probes as the longest run."""
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, 1 << 40, np.int64)
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = self.keys[slot] == -1
            taken = np.zeros(len(key), bool)
            where, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[where], self.values[where] = key[chosen], value[chosen]
            taken[chosen] = True
            key, value, slot = key[~taken], value[~taken], (slot[~taken] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair joined; 2**40 where the vocabulary has no such token."""
        key = (a << 32) | b
        slot = self._slot(key)
        out = np.full(len(key), 1 << 40, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """The lowest pair first, the leftmost of equal ones; parts are a linked list, pairs wait in a heap until they are stale."""
        ids: list[int | None] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pairs.get
        heap = [(rank, i) for i in range(n - 1) if (rank := pair(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if ids[i] is None or (j := after[i]) >= n or pair(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (next_ := pair(rank << 32 | ids[k])) is not None:
                    heappush(heap, (next_, i))
            h = before[i]
            if h >= 0 and (next_ := pair(ids[h] << 32 | rank)) is not None:
                heappush(heap, (next_, h))
        return [i for i in ids if i is not None]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece: whole if it is a token, else by merging pairs."""
        out: list[list[int]] = [[self.ranks[p]] if p in self.ranks else self._merge_long(p) if len(p) > LONG_PIECE else [] for p in pieces]
        open_ = [i for i, ids in enumerate(out) if not ids and pieces[i]]
        if not open_:
            return out
        lengths = np.array([len(pieces[i]) for i in open_])
        ids = self.single[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
        owner = np.repeat(np.arange(len(open_)), lengths)
        rank = np.full(len(ids), 1 << 40, np.int64)  # of the pair that starts here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(begins, len(ids)))
            low = np.minimum.reduceat(rank, begins)
            done = low == 1 << 40
            if done.any():
                for b, n in zip(begins[done].tolist(), sizes[done].tolist()):
                    out[open_[owner[b]]] = ids[b : b + n].tolist()
                keep = np.repeat(~done, sizes)
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                if not len(ids):
                    break
                begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sizes, low = sizes[~done], low[~done]
            at = np.flatnonzero(rank == np.repeat(low, sizes))
            _, first = np.unique(owner[at], return_index=True)  # the leftmost lowest pair of each piece
            at = at[first]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged tokens stand after the removal
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for fresh in (moved, moved - 1):  # pairs on either side of a merged token
                fresh = fresh[fresh >= 0]
                rank[fresh] = 1 << 40
                fresh = fresh[fresh + 1 < len(ids)]
                fresh = fresh[owner[fresh] == owner[fresh + 1]]
                rank[fresh] = self._pair_ranks(ids[fresh], ids[fresh + 1])
        return out

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        merged = self.merge([p.encode() for p in pieces])
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        have, total = len(self.index), int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.begin) < have + len(merged):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in merged for i in ids), np.int32, total)
        self.begin[have : have + len(merged)] = self.used + np.cumsum(sizes) - sizes
        self.count[have : have + len(merged)] = sizes
        self.used += total
        for p in pieces:
            self.index[p] = len(self.index)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more: the end)."""
        joined = "".join(batch)
        lengths = np.fromiter(map(len, batch), np.int64, len(batch))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(batch) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        heads = np.cumsum(lengths) - lengths
        starts = piece_starts(classes(points, heads[lengths > 0]))
        ends = np.append(starts[1:], len(joined)).tolist()
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends)]
        if len(self.index) > CACHED:
            self._forget()
        fresh = set(pieces).difference(self.index)
        if fresh:
            self._learn(list(fresh))
        code = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[code]
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[code] - (stop - count), count) + np.arange(stop[-1])]
        first_piece = np.searchsorted(starts, np.append(heads, len(joined)))  # a text's first piece starts where it does
        return ids, np.append(stop - count, stop[-1])[first_piece]

    def decode(self, ids: list[int]) -> bytes:
        token = self.bytes
        return b"".join([token[i] for i in ids])

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token starts in the text."""
        sizes = np.fromiter((len(self.bytes[i]) for i in ids), np.int64, len(ids))
        return (np.cumsum(sizes) - sizes).tolist()


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), offsets (array of long: the byte where each token starts)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path or default_path())
        for batch in batches:
            for part in steps(batch, "text"):
                ids, at = tokenizer.encode(texts(part.column("text")).to_pylist())
                rows = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([tokenizer.offsets(r) for r in rows], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes (binary) from doc_id and ids; null ids decode to no bytes."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path or default_path())
        for batch in batches:
            rows = [tokenizer.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes), and if wanted the ids."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path or default_path())
        decimal = tokenizer.decimal
        for batch in batches:
            for part in steps(batch, "text"):
                ids, at = tokenizer.encode(texts(part.column("text")).to_pylist())
                ids_sha, text_sha = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = ids[a:b].tolist()
                    ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in own]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(tokenizer.decode(own)).hexdigest())
                columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ["doc_id long", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(kinds))
