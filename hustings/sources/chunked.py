"""Imports of folders in chunks that commit one by one and resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hustings.sources import files
from hustings.sources.store import Store


def counted(rows: DataFrame) -> dict[str, int]:
    """What an import reports of a chunk."""
    wanted = {"rows_processed": F.count(F.lit(1))}
    if "organization_is_blank" in rows.columns:
        wanted["rows_blank_organization"] = F.count_if("organization_is_blank")
    if "signed_at" in rows.columns:
        wanted["rows_invalid_timestamp"] = F.count_if(F.col("signed_at").isNull())
    return rows.agg(*(v.alias(k) for k, v in wanted.items())).first().asDict()


def import_folder(store: Store, kind: str, table: str, folder: str, schema: str | StructType, convert: Callable[[DataFrame], DataFrame], key: str, version: str = "1", order: str | None = None, files_per_chunk: int = 1, csv: dict[str, Any] | None = None) -> dict[str, Any]:
    """Upsert the CSV files of a folder, `files_per_chunk` at a time; files that come later are imported by a later call.

    A file stream keeps its offsets beside the table, and each chunk's number and counts go into the manifest with its rows, in
    one step. A run that dies within a chunk does that chunk again; one that dies after a chunk's rows are
    in but before the stream has noted it finds the number in the manifest and leaves the rows alone.
    So rows and totals are those of one undisturbed run. Every run leaves a ledger row.
    """
    spark = store.spark
    stream = f"{kind}:{version}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).options(**({"header": True, "escape": '"'} | (csv or {}))).csv(folder)
    source = source.withColumn("__file", F.col("_metadata.file_path"))

    def commit(batch: DataFrame, number: int) -> None:
        rows = convert(batch)
        counts = counted(rows)
        store.upsert(table, rows, key, order, mark=(stream, number, counts | {"chunks": 1}))

    def totals() -> dict[str, int]:
        manifest = store.manifest(table)
        return manifest["applied"].get(stream, {}).get("totals", {}) if manifest else {}

    before = totals()
    try:
        query = source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{store.folder}/{table}/streams/{kind}-{version}").trigger(availableNow=True).start()
        query.awaitTermination()
    except Exception as e:
        store.record_import(kind, table, folder, version, "failed", totals().get("rows_processed", 0) - before.get("rows_processed", 0), str(e)[:500])
        raise
    after = totals()
    n = after.get("rows_processed", 0) - before.get("rows_processed", 0)
    status = "completed" if after.get("chunks", 0) > before.get("chunks", 0) else "skipped"
    store.record_import(kind, table, folder, version, status, n)
    return {"status": status, "rows_processed": n, "totals": after}


def submissions(columns: dict[str, str] | None = None, zone: str = "America/Los_Angeles") -> Callable[[DataFrame], DataFrame]:
    """For import_folder with one file a chunk: sign-in rows to stored submissions, numbered within their file."""

    def convert(batch: DataFrame) -> DataFrame:
        names = [r[0] for r in batch.select("__file").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError("rows are numbered by file: take one file a chunk")
        rows = files.normalize_columns(batch.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in batch.columns if c != "__file"]), columns)
        return files.normalize_submissions(rows, names[0].rsplit("/", 1)[-1] if names else "", zone)

    return convert
