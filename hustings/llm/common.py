"""Shared plumbing of the training-data operators: session settings, scratch tables, text batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
#: Texts of one numpy step together; one longer text makes a step of its own.
STEP_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches (rows and bytes) and let Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the cluster's shared checkpoint folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
        if base.startswith("file:") and not _one_machine(spark):
            warnings.warn("spark.checkpoint.dir is a file: path; on a cluster it must be a mount that all executors share", stacklevel=2)
        self.base = f"{base.rstrip('/')}/hustings-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        _written.add(self.base)
        path = f"{self.base}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_written: set[str] = set()


def scratch_tables() -> set[str]:
    """The folders of all scratch tables that this process has written and not cleared."""
    return set(_written)


def clear(spark: SparkSession, bases: set[str]) -> None:
    """Delete scratch folders whose readers are done."""
    for base in bases:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.discard(base)


def _one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


_local: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """Only where the cluster names no folder, as in tests on one machine."""
    if not _one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='hustings-')}"
    return _local[app]


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def spread(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on the values of the columns alone: a sample that is the same in every run."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def thinned(rows: DataFrame, share: Column, most: int, seed: str) -> DataFrame:
    """About `share` of the rows (doc_id, text, ...), by a hash of id and text, and not many more than `most`.

    Shares rest on counts of ids or labels; where ids repeat in the rows, the sample would be larger, so it is counted
    and thinned evenly. A row that repeats another's id and text comes once.
    """
    place = spread(seed, "doc_id", "text")
    some = rows.where(place < share)
    n = some.select("doc_id", F.xxhash64("text").alias("h")).distinct().count()
    if n > 1.25 * most:
        some = some.where(place < share * (most / n))
    return some.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")


def texts(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes together (a longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts (one more entry: the end)."""
    column = texts(column)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]
