"""Stores and sinks: keyed upserts, an import ledger, tables and JSON summaries."""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

STATUSES = ("completed", "failed", "skipped")
LEDGER = "import_id string, created_at timestamp, kind string, table string, file_hash string, importer_version string, status string, rows long, detail string"


class Store:
    """Keyed tables of Parquet files under one folder, parted by a hash of the key.

    The number of parts is fixed by the first batch: at least the size of the table over what a batch may rewrite for one key. A part
    is as many files as its size asks for. A manifest names the folder of each part; a batch rewrites only the parts that its keys fall
    into, and a new manifest takes effect when it is renamed to the next version's name, which fails if another writer
    was first. So readers see a whole old or new table, and files of earlier versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64) -> None:
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests ----------------------------------------------------------------------------------

    def versions(self, table: str) -> list[int]:
        """Versions whose manifests are there, in order."""
        folder = self._path(f"{self.folder}/{table}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, table: str, version: int | None = None) -> dict[str, Any] | None:
        """{version, key, n_parts, parts: {part: folder}, schema, applied: {stream: {batch, totals}}}; None where there is no table."""
        known = self.versions(table)
        if not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"{table} has no version {version}")
        path = f"{self.folder}/{table}/manifests/{version if version is not None else known[-1]:012d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _publish(self, table: str, manifest: dict[str, Any]) -> None:
        base = f"{self.folder}/{table}/manifests"
        draft, final = self._path(f"{base}/.{uuid.uuid4().hex}"), self._path(f"{base}/{manifest['version']:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{table}: another writer published version {manifest['version']}")

    def _rows(self, table: str, manifest: dict[str, Any], parts: list[str] | None = None) -> DataFrame | None:
        folders = [f"{self.folder}/{table}/{folder}" for part, folder in manifest["parts"].items() if parts is None or part in parts]
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*folders) if folders else None

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The table as it is, or as it was; None where there is none."""
        manifest = self.manifest(table, version)
        if manifest is None:
            return None
        rows = self._rows(table, manifest)
        return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"])) if rows is None else rows

    def lookup(self, table: str, keys: list) -> DataFrame | None:
        """Rows of a few keys: only the parts that hold them are read."""
        manifest = self.manifest(table)
        if manifest is None:
            return None
        key, kind = manifest["key"], StructType.fromJson(manifest["schema"])[manifest["key"]].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([StructField(key, kind)]))
        parts = [str(r[0]) for r in wanted.select(self._part(key, manifest["n_parts"])).distinct().collect()]
        rows = self._rows(table, manifest, parts)
        return self.read(table).limit(0) if rows is None else rows.where(F.col(key).isin(keys))

    @staticmethod
    def _part(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def upsert(self, table: str, rows: DataFrame, key: str, order: str | None = None, mark: tuple[str, int, dict[str, int]] | None = None) -> int:
        """Replace rows of the same key and add new ones; created_at stays, updated_at moves. Returns the rows merged.

        Of rows of one key in a batch the one with the highest `order` wins, and among equals, or without an order, the one
        whose columns, taken from the left, are greatest (null is least). A null key is an error. Columns new to
        the table are null in earlier rows. `mark` = (stream, batch, counts) goes into the manifest with the rows; a batch that is
        marked already changes nothing.
        """
        before = self.manifest(table)
        if before and before["key"] != key:
            raise ValueError(f"{table} is keyed by {before['key']}")
        applied = dict(before["applied"]) if before else {}
        if mark:
            stream, batch, counts = mark
            done = applied.get(stream, {"batch": -1, "totals": {}})
            if done["batch"] >= batch:
                return 0
            applied[stream] = {"batch": batch, "totals": {k: done["totals"].get(k, 0) + counts.get(k, 0) for k in {*done["totals"], *counts}}}
        n_parts, version = (before["n_parts"], before["version"] + 1) if before else (self.parts, 0)
        parts, kinds = dict(before["parts"]) if before else {}, {x.name: x.dataType.typeName() for x in rows.schema.fields}
        others = [x for x in rows.columns if x != key]
        comparable = [F.to_json(x).alias(x) if kinds[x] in ("map", "variant") else F.col(x) for x in others]
        rank = F.struct(*([F.col(order).alias("__order")] if order else []), *comparable)
        one = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("__row")) if others else rows.distinct()
        one = one.select(key, *(F.col(f"__row.`{x}`").alias(x) for x in others)).withColumn("__part", self._part(key, n_parts))
        stamp, now = f"data/{uuid.uuid4().hex}", F.current_timestamp()
        fresh = self._write(table, one, f"{stamp}-batch")  # the batch is read twice more: once written, it is the same each time
        n, touched = 0, []
        for r in fresh.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("bad")).collect():  # a row a part
            if r["bad"]:
                self._delete(f"{table}/{stamp}-batch")
                raise ValueError(f"{table}: a row without a {key}")
            n += r["n"]
            touched.append(r["__part"])
        old = self._rows(table, before, [str(p) for p in touched]) if before else None
        if old is None:
            merged = fresh.withColumns({"created_at": now, "updated_at": now})
        else:
            known = old.select(key, F.col("created_at").alias("__created"))
            new = fresh.join(known, key, "left").withColumns({"created_at": F.coalesce("__created", now), "updated_at": now}).drop("__created")
            kept = old.join(fresh.select(key), key, "left_anti").withColumn("__part", self._part(key, n_parts))
            merged = kept.unionByName(new, allowMissingColumns=True)
        schema = StructType([x for x in merged.schema.fields if x.name != "__part"])
        if before:  # columns that this batch lacks stay
            schema = StructType([*schema.fields, *(x for x in StructType.fromJson(before["schema"]).fields if x.name not in schema.names)])
        if touched:
            merged.hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{self.folder}/{table}/{stamp}")
            parts |= {str(p): f"{stamp}/__part={p}" for p in touched}
        self._publish(table, {"version": version, "key": key, "n_parts": n_parts, "parts": parts, "schema": json.loads(schema.json()), "applied": applied})
        self._delete(f"{table}/{stamp}-batch")
        return n

    def _write(self, table: str, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{table}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{table}/{name}")

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def vacuum(self, table: str, keep: int = 2) -> int:
        """Forget all but the last `keep` versions and delete files that none of those names; how many folders went."""
        versions, gone = self.versions(table), 0
        named = {folder for v in versions[-keep:] for folder in self.manifest(table, v)["parts"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/{table}/manifests/{v:012d}.json"), False)
        data = self._path(f"{self.folder}/{table}/data")
        for batch in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for part in self._fs.listStatus(batch.getPath()):
                if part.isDirectory() and f"data/{batch.getPath().getName()}/{part.getPath().getName()}" not in named:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        return gone

    # ledger -------------------------------------------------------------------------------------

    def record_import(self, kind: str, table: str, file_hash: str, version: str, status: str, rows: int = 0, detail: str = "") -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        row = self.spark.createDataFrame([(uuid.uuid4().hex, None, kind, table, file_hash, version, status, rows, detail)], LEDGER).withColumn("created_at", F.current_timestamp())
        row.write.mode("append").parquet(f"{self.folder}/data_imports")

    def imports(self) -> DataFrame:
        path = f"{self.folder}/data_imports"
        return self.spark.read.schema(LEDGER).parquet(path) if self._fs.exists(self._path(path)) else self.spark.createDataFrame([], LEDGER)

    def completed(self, kind: str, table: str, file_hash: str, version: str) -> bool:
        same = (F.col("kind") == kind) & (F.col("table") == table) & (F.col("file_hash") == file_hash) & (F.col("importer_version") == version)
        return self.imports().where(same & (F.col("status") == "completed")).limit(1).count() > 0

    def import_rows(self, kind: str, table: str, rows: DataFrame, key: str, file_hash: str, version: str = "1", force: bool = False, order: str | None = None) -> dict[str, Any]:
        """Upsert once for each file content and importer version; every attempt leaves a ledger row."""
        if not force and self.completed(kind, table, file_hash, version):
            self.record_import(kind, table, file_hash, version, "skipped")
            return {"status": "skipped", "rows_upserted": 0}
        try:
            counts = rows.agg(F.count(F.lit(1)).alias("rows_processed"), *(F.count_if(F.col(c) == "").alias(f"blank_{c}") for c in ("organization_clean",) if c in rows.columns), *(F.count_if(F.col(c).isNull()).alias("invalid_timestamps") for c in ("signed_at",) if c in rows.columns)).first().asDict()
            n = self.upsert(table, rows, key, order)
        except Exception as e:
            self.record_import(kind, table, file_hash, version, "failed", 0, str(e)[:500])
            raise
        self.record_import(kind, table, file_hash, version, "completed", n)
        return {"status": "completed", "rows_upserted": n, **counts}


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as file:
        while piece := file.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def flattened(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON texts."""
    return df.select([F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    if kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "csv":
        flattened(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown table format: {kind}")


def write_shards(df: DataFrame, path: str, by: str = "bucket_minutes") -> None:
    """Chart rows as JSON, a folder for each bucket size; rows without one under the default partition."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def safe(value: Any) -> Any:
    """JSON values: NaN and infinities as null, times as ISO texts."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def summary_json(one_row: DataFrame) -> str:
    """A one-row table as JSON with sorted keys."""
    row = one_row.first()
    return json.dumps(safe(row.asDict(recursive=True)) if row else {}, sort_keys=True)
