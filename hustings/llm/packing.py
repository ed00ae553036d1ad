"""Best-fit packing of documents into sequences of a fixed number of tokens, by bin completion.

A document is its token ids and a closing id 0. Longer ones are cut into pieces of the capacity; the
first piece takes what is left over, so full pieces are sequences by themselves. Pieces of one length
are interchangeable, so the search works on how many pieces each length has: `capacity` numbers,
whatever the corpus. Its result is a plan of fillings (lengths that share a sequence) and how often
each is used, again bounded by the capacity and not by the documents; pieces then take the places
of their length by rank.

Bin completion: the largest open length gets a sequence, and the room beside it is filled. Of the
fillings only undominated ones are enumerated (one filling dominates another if the latter's pieces
fit into the former's, piece by piece): a single piece that fills the room dominates all others;
else exact pairs, exact triples and maximal fillings of more pieces come in order of waste. A filling
is used as often as its lengths last, as single pieces in a search of at most `SMALL` pieces. The
depth-first search starts with the best-fit-decreasing packing as incumbent, leaves a branch when its
waste exceeds what an incumbent with one sequence less may waste, and ends at the lower bound
(total length, or Martello and Toth's L2) or after `NODES` fillings; what is best then stays. Every
piece is always packed: limits of the search bear on how many sequences there are alone.

Ids come from the rank file of the same vocabulary as the JSON file of the tokenizers library, through
tiktoken, five times as fast (`tests/llm` holds both against each other); texts of more than
`LONG_TEXT` characters through the scan of `bpe`, which no text can overflow. Special-token strings
are ordinary text.

Defined cases: a null text is the empty text, a piece of one token; rows that repeat, or repeat an
id, are documents of their own; a null id stays null; texts of any length count whole; without
documents the result is empty; other columns are ignored. Which of equally long pieces gets which
place is open, as are the numbers of sequences (they start at 0 and have no gaps).
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm import bpe
from hustings.llm.common import Scratch, prepare, steps, texts

CAPACITY = 2048
#: The id that closes a document.
END = 0
LONG_TEXT = 1 << 18
#: Fillings tried in a search, fillings kept and steps taken for one sequence, and pieces up to which fillings are used one by one.
NODES, KEPT, STEPS, SMALL = 6_000, 12, 1_000, 200
#: Ranks of pieces of one length stay below 2**RANK_BITS.
RANK_BITS = 48

Filling = tuple[int, ...]


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str) -> array:
    """The ids of a text as unsigned 32-bit integers."""
    if len(text) > LONG_TEXT:
        return array("I", bpe.load(path).encode([text])[0].astype(np.uint32).tobytes())
    return array("I", _encoding(path).encode_ordinary(text))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where the row was made: task, and nth of its length in that task."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            for part in steps(batch, "text"):
                columns: list[list] = [[] for _ in range(8)]
                for row, text in enumerate(texts(part.column("text")).to_pylist()):
                    ids = token_ids(text, path or bpe.default_path())
                    ids.append(END)
                    raw, start = memoryview(ids), 0
                    for k in range(-(-len(ids) // capacity)):
                        end = len(ids) - capacity * ((len(ids) - 1 - start) // capacity)
                        cut = raw[start:end]
                        length = end - start
                        for column, value in zip(columns, (row, k, start, length, zlib.crc32(cut), task, seen[length], cut if with_ids else None)):
                            column.append(value)
                        seen[length] += 1
                        start = end
                rows = [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:7])]
                if with_ids:
                    at = np.cumsum([0, *columns[3]]).astype(np.int32)
                    rows.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint32), *map(np.asarray, columns[7])]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(rows, names)

    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "task": "long", "nth": "long"} | ({"ids": "array<int>"} if with_ids else {})
    names = list(kinds)
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs (counts[n]: pieces of length n; the last one is the capacity): L2, which is never below the total's."""
    capacity = len(counts) - 1
    n, size = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2  # lengths above it stand alone or with smaller ones
    best = -(-int(size[-1]) // capacity)
    for low in range(1, half + 1):  # lengths below `low` are left out
        large = int(n[capacity] - n[half])
        room = int((n[capacity - low] - n[half]) * capacity - (size[capacity - low] - size[half]))
        middle = int(size[half] - size[low - 1])
        best = max(best, large + max(0, -(-(middle - room) // capacity)))
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing, on sequences that look alike together: (times, lengths in descending order)."""
    rooms: list[list[tuple[int, Filling]]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some sequence has room r
    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            tight = open_ >> size
            if tight:
                room = size + (tight & -tight).bit_length() - 1
                times, filling = rooms[room].pop()
                if not rooms[room]:
                    open_ ^= 1 << room
            else:
                room, times, filling = capacity, left, ()
            each = room // size  # the tightest sequence stays the tightest while another piece fits
            full, rest = min(times, left // each), 0
            if full < times and left - full * each:
                rest = left - full * each
            for m, k in ((full, each), (int(rest > 0), rest)):
                if m:
                    rooms[room - k * size].append((m, filling + (size,) * k))
                    open_ |= 1 << (room - k * size)
            if filling and (same := times - full - (rest > 0)):
                rooms[room].append((same, filling))
                open_ |= 1 << room
            left -= full * each + rest
    return [x for room in rooms for x in room]


def dominates(a: Filling, b: Filling) -> bool:
    """Whether b's pieces fit into a's, several into one or none."""
    if sum(b) > sum(a):
        return False
    seen = set()

    def fits(k: int, room: Filling) -> bool:
        if k == len(b):
            return True
        if (k, room) in seen:
            return False
        seen.add((k, room))
        for i, r in enumerate(room):
            if r >= b[k] and (i == 0 or r != room[i - 1]) and fits(k + 1, tuple(sorted((*room[:i], *room[i + 1 :], r - b[k]), reverse=True))):
                return True
        return False

    return fits(0, tuple(sorted(a, reverse=True)))


def completions(counts: list[int], bits: int, room: int, capacity: int) -> list[Filling]:
    """Undominated fillings of the room, the least waste first and large pieces before small ones. bits: lengths that are left."""
    below = bits & ((1 << (room + 1)) - 1)
    if not below:
        return [()]
    if below >> room & 1:
        return [(room,)]
    mirrored = int(f"{bits:0{capacity + 1}b}"[::-1], 2)  # bit capacity - n: length n is left

    def pairs(total: int, most: int) -> Iterator[Filling]:
        """(u, v) with u + v = total, most >= u >= v."""
        both = bits & (mirrored >> (capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 1)
        while both:
            u = both.bit_length() - 1
            if 2 * u < total:
                return
            if 2 * u > total or counts[u] > 1:
                yield u, total - u
            both ^= 1 << u

    found: list[Filling] = []

    def add(filling: Filling) -> bool:
        if all(counts[n] >= filling.count(n) for n in set(filling)) and not any(dominates(f, filling) for f in found):
            found.append(filling)
        return len(found) >= KEPT

    for pair in pairs(room, room):
        if add(pair):
            return found
    largest = below
    while largest:
        t = largest.bit_length() - 1
        if 3 * t < room:
            break
        largest ^= 1 << t
        for u, v in pairs(room - t, t):
            if add((t, u, v)):
                return found
    if found:
        return found
    maximal: list[tuple[int, Filling]] = []
    step = 0

    def fill(left: int, most: int, used: Filling) -> None:
        nonlocal step
        step += 1
        fit = bits & ((1 << (min(left, most) + 1)) - 1)
        last = True
        while fit and step < STEPS:
            n = fit.bit_length() - 1
            fit ^= 1 << n
            if counts[n] > used.count(n):
                last = False
                fill(left - n, n, (*used, n))
        if last:
            maximal.append((left, used))

    fill(room, room, ())
    for _, filling in nsmallest(3 * KEPT, maximal, key=lambda x: (x[0], [-n for n in x[1]])):
        if add(filling):
            break
    return found


def plan(counts: list[int], nodes: int = NODES) -> tuple[list[tuple[int, Filling]], int]:
    """Fillings and how often each is used, and the lower bound. counts[n]: pieces of length n; the last one is the capacity."""
    capacity = len(counts) - 1
    bound = lower_bound(np.array(counts, dtype=object if max(counts) > 1 << 40 else np.int64))
    best = best_fit(counts, capacity)
    need = sum(m for m, _ in best)
    total = sum(n * c for n, c in enumerate(counts))
    counts = list(counts)
    left = sum(counts)
    bits = sum(1 << n for n in range(1, capacity + 1) if counts[n])
    path: list[tuple[int, Filling]] = []
    wasted = used = 0

    def take(times: int, filling: Filling) -> None:
        """Remove pieces (or put them back: times below 0)."""
        nonlocal bits, left
        for n in filling:
            counts[n] -= times
            if counts[n]:
                bits |= 1 << n
            else:
                bits &= ~(1 << n)
        left -= times * len(filling)

    def branches() -> Iterator[tuple[int, Filling]]:
        top = bits.bit_length() - 1
        take(1, (top,))
        fillings = completions(counts, bits, capacity - top, capacity)
        take(-1, (top,))
        for filling in fillings:
            whole = (top, *filling)
            most = 1 if left <= SMALL else min(counts[n] // whole.count(n) for n in set(whole))
            yield most, whole

    stack = [branches()] if left else []
    while stack and need > bound and nodes:
        branch = next(stack[-1], None)
        if branch is None:
            stack.pop()
            if path:
                times, filling = path.pop()
                take(-times, filling)
                used -= times
                wasted -= times * (capacity - sum(filling))
            continue
        nodes -= 1
        times, filling = branch
        waste = times * (capacity - sum(filling))
        if wasted + waste > (need - 1) * capacity - total:
            continue  # as many sequences as the incumbent has, at least
        take(times, filling)
        path.append(branch)
        wasted, used = wasted + waste, used + times
        if left:
            stack.append(branches())
            continue
        if used < need:
            best, need = list(path), used
        stack.append(iter(()))
    return best, bound


def places(fillings: list[tuple[int, Filling]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By length and rank: keys (length and first rank), the first sequence from that rank on less the rank, and the offset."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in fillings:
        offset = 0
        for n in filling:
            rank = ranks.get(n, 0)
            rows.append((n << RANK_BITS | rank, sequence - rank, offset))
            ranks[n] = rank + times
            offset += n
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 3).T)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and if wanted its ids."""
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, capacity, path, with_ids=with_ids), "pieces")
    made = scratch.save(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = [0] * (capacity + 1)
    for row in made.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to the capacity
        counts[row["length"]] = row["n"]
    keys, sequence, offset = places(plan(counts)[0])
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = made.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"), *["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, "right") - 1
            columns = [*(batch.column(c) for c in kinds if c not in ("sequence_id", "offset", "ids")), pa.array(sequence[at] + rank), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column("ids")] if with_ids else []), list(kinds))

    kinds = {"doc_id": cut.schema["doc_id"].dataType.simpleString(), "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"} | ({"ids": "array<int>"} if with_ids else {})
    return ranked.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def sequences(packed: DataFrame) -> DataFrame:
    """What a training run reads, from pack(..., with_ids=True): sequence_id, ids, and the pieces (doc_id, piece, offset, length) in their order."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.transform("rows", lambda r: F.struct(r["doc_id"], r["piece"], r["offset"], r["length"])).alias("pieces"))
