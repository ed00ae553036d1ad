"""Vector code compression: each part of a vector becomes the index of its codebook's nearest entry.

Components become integers floor(256 * x), and vectors are cut into equal consecutive parts. A
codebook starts as that part of the vectors with the smallest ids; each round assigns every part to
the nearest entry (squared Euclidean distance, ties to the lower index) and moves an entry to the
floor of its parts' mean. Vectors stay where they are: a task assigns its own and hands on sums by
entry alone, so a round shuffles parts x entries rows a task, and the driver holds the codebooks.

The nearest entry is found with a ball tree over the entries of each part position. A query first
goes down to the leaf of the nearer centres, which gives it a distance to beat; then the tree is
walked from the root, and a ball is visited unless its centre is farther than its radius and the
distance to beat together. Centres are integers, radii are rounded up, the sum of both is rounded up
and the comparison is not strict, so no nearest entry and no tie is lost to rounding; distances that
decide are computed in integers. All queries of a block go through the tree together.

Defined cases: rows go whose vector is null, or holds null or non-finite components, or has a
component beyond +-2**18 (the integer sums would not fit), or whose length is not that of the kept
row with the smallest id among lengths that the number of parts divides. Rows without an id are
coded like any other, and come last where codebooks start; equal ids are ordered by their vectors.
With fewer vectors than entries, codebooks are shorter; without any, the result is empty. Repeated
rows each count. Labels may be null (they share one sum). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import Scratch, prepare

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integer steps to 1.
SCALE = 256
#: Components beyond +-LIMIT have no code: squared distances of integers up to 2**26, summed over 2**9 components and more, fill a long.
LIMIT = float(1 << 18)
#: Entries of a leaf of the ball tree.
LEAF = 8
#: Vectors that go through the tree together, and bytes of their components.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Rounding of a square root and a product, with room to spare.
UP = 1 + 2.0**-48


class BallTree:
    """Nearest of a few integer points, ties to the lower index; many queries at once."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.balls: list[tuple[np.ndarray, float, int, int, np.ndarray]] = []  # centre, radius, children (or -1), members
        if len(points):
            self._grow(np.arange(len(points)), leaf)

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        own = self.points[members]
        centre = np.rint(own.mean(0)).astype(np.int64)
        radius = float(np.sqrt(float(((own - centre) ** 2).sum(1).max()))) * UP
        at = len(self.balls)
        self.balls.append((centre, radius, -1, -1, members))
        if len(members) > leaf:
            widest = int(np.argmax(own.max(0) - own.min(0)))
            order = np.argsort(own[:, widest], kind="stable")
            half = len(members) // 2
            left = self._grow(np.sort(members[order[:half]]), leaf)
            right = self._grow(np.sort(members[order[half:]]), leaf)
            self.balls[at] = (centre, radius, left, right, members)
        return at

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance for each query (a row of integers)."""
        n = len(queries)
        best, entry = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        self._descend(0, np.arange(n), queries, best, entry)
        self._visit(0, np.arange(n), queries, best, entry)
        return entry, best

    def _compare(self, members: np.ndarray, who: np.ndarray, queries: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Members ascend, so the first of equally near ones has the lowest index."""
        mine = queries[who]
        low, found = np.full(len(who), np.iinfo(np.int64).max), np.zeros(len(who), np.int64)
        for m in members.tolist():
            far = mine - self.points[m]
            d = np.einsum("ij,ij->i", far, far)
            closer = d < low
            low[closer], found[closer] = d[closer], m
        better = (low < best[who]) | ((low == best[who]) & (found < entry[who]))
        best[who[better]], entry[who[better]] = low[better], found[better]

    def _descend(self, at: int, who: np.ndarray, queries: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        _, _, left, right, members = self.balls[at]
        if not len(who):
            return
        if left < 0:
            return self._compare(members, who, queries, best, entry)
        a, b = (queries[who] - self.balls[k][0] for k in (left, right))
        nearer = (a * a).sum(1) <= (b * b).sum(1)
        self._descend(left, who[nearer], queries, best, entry)
        self._descend(right, who[~nearer], queries, best, entry)

    def _visit(self, at: int, who: np.ndarray, queries: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        centre, radius, left, right, members = self.balls[at]
        far = queries[who] - centre
        away = np.sqrt(np.einsum("ij,ij->i", far, far).astype(np.float64))
        who = who[away <= (radius + np.sqrt(best[who].astype(np.float64)) * UP) * UP]
        if not len(who):
            return
        if left < 0:
            return self._compare(members, who, queries, best, entry)
        self._visit(left, who, queries, best, entry)
        self._visit(right, who, queries, best, entry)


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x components of a part, integers."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    @cached_property
    def trees(self) -> list[BallTree]:
        return [BallTree(e) for e in self.entries]

    def __getstate__(self) -> dict:
        return {"entries": self.entries}  # a task grows its own trees

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part (rows x parts)."""
        cut = vectors.reshape(len(vectors), *self.entries.shape[::2])
        code, error = np.empty(cut.shape[:2], np.int64), np.empty(cut.shape[:2], np.int64)
        for p, tree in enumerate(self.trees):
            code[:, p], error[:, p] = tree.nearest(np.ascontiguousarray(cut[:, p]))
        return code, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there, and all its components are finite numbers within the limit (a null or NaN is not)."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) <= F.lit(LIMIT), F.lit(False))), F.lit(False)) & (F.size(vector) > 0)


def kept(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, embedding of the rows that get a code, and the length of their vectors (0 where there are none)."""
    prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding").where(usable())
    first = rows.where(F.size("embedding") % parts == 0).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).first()
    length = first[0] if first else 0
    return rows.where(F.size("embedding") == length), length


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in blocks, with their vectors as integers."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * length)))

    def block(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("embedding").chunks])
        return rows, np.floor(values.astype(np.float64) * SCALE).astype(np.int64).reshape(-1, length)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield block(held)
            held, n = [], 0
    if n:
        yield block(held)


def initial(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """From the vectors with the smallest ids: `entries` rows at most come to the driver."""
    first = [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()]
    whole = np.floor(np.array(first, np.float64).reshape(len(first), length) * SCALE).astype(np.int64)
    return Codebooks(whole.reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy())


def improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round. Each task adds up its own parts; parts x entries rows of sums come to the driver."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, vectors in _blocks(batches, books.dimension):
            code, _ = books.assign(vectors)
            flat = (code + np.arange(parts) * entries).ravel()
            counts += np.bincount(flat, minlength=parts * entries)
            for k, column in enumerate(vectors.reshape(-1, width).T):  # sums of a block stay below 2**53, so weights in doubles add up exactly
                sums[:, k] += np.bincount(flat, weights=column, minlength=parts * entries).astype(np.int64)
        used = np.flatnonzero(counts)
        columns = [pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "n", *(f"s{k}" for k in range(width))])

    names = [f"s{k}" for k in range(width)]
    added = rows.select("embedding").mapInArrow(run, ", ".join(["entry long", "n long", *(f"{s} long" for s in names)]))
    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    out = books.entries.reshape(parts * entries, width).copy()
    for row in added.groupBy("entry").agg(wide("n"), *map(wide, names)).collect():
        out[row["entry"]] = [int(row[s]) // int(row["n"]) for s in names]  # a floor, of negative sums too
    return Codebooks(out.reshape(parts, entries, width))


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, codes (array of int), error (long) of each kept row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, vectors in _blocks(batches, books.dimension):
            code, error = books.assign(vectors)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)), pa.array(code.astype(np.int32).ravel()))
            whole = block.combine_chunks()
            yield from pa.Table.from_arrays([whole.column("vec_id"), whole.column("label"), lists, pa.array(error.sum(1))], ["vec_id", "label", "codes", "error"]).to_batches(max_chunksize=BLOCK_ROWS)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes of all kept rows with the label's summed error (label_error), and the codebooks that decode them.

    Sums of errors go back to the rows by a plain join: Spark broadcasts them where they are small
    and splits the rows of a frequent label where they are not.
    """
    rows, length = kept(vectors, parts)
    if not length:
        return coded_nothing(rows), Codebooks(np.zeros((parts, 0, 1), np.int64))
    books = initial(rows, length, parts, entries)
    for _ in range(rounds):
        books = improved(rows, books)
    scratch = Scratch(vectors.sparkSession)
    codes = scratch.save(coded(rows, books), "codes")
    sums = scratch.save(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def coded_nothing(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and the vector that its codes stand for (components of the entries over 256)."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.asarray(batch.column("codes").flatten()).reshape(batch.num_rows, parts)
            values = books.entries[np.arange(parts), code].reshape(-1) / SCALE
            at = np.arange(batch.num_rows + 1, dtype=np.int32) * parts * width
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(values))], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, f"vec_id {codes.schema['vec_id'].dataType.simpleString()}, embedding array<double>")


def written(codes: str = "codes") -> Column:
    """Codes as two hex digits each, in order of parts."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
