"""Chart rows as JSON shards by analysis and bucket size, and their reload."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from hustings.functions.core import bucket_minutes_of

#: What charts of no analysis stand under, and the shard of rows without a bucket size.
SHARED, BASE = "__shared__", "base"
#: Columns of written tables that hold times.
TIMES = ("minute_bucket", "start_minute", "end_minute", "first_seen", "last_seen", "timestamp")


def slugs(ids: list[str]) -> dict[str, str]:
    """A folder name for each id: small letters, digits, - and _; ids that fall together are numbered from 2 in their order."""
    out: dict[str, str] = {}
    for one in ids:
        base = re.sub(r"[^a-z0-9_-]+", "-", one.strip().lower()).strip("-") or "analysis"
        slug, k = base, 2
        while slug in out.values():
            slug, k = f"{base}-{k}", k + 1
        out[one] = slug
    return out


def _safe(df: DataFrame) -> DataFrame:
    """Doubles that are no numbers as nulls: JSON has none."""
    odd = [x.name for x in df.schema.fields if isinstance(x.dataType, (DoubleType, FloatType))]
    return df.withColumns({x: F.when(~F.isnan(x) & (F.abs(F.col(f"`{x}`")) < float("inf")), F.col(f"`{x}`")) for x in odd}) if odd else df


class Shards:
    """A folder of shards with numbered manifests; the last manifest names the files that count."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, charts: dict[str, DataFrame], analyses: dict[str, list[str]]) -> dict[str, Any]:
        """Write all charts in one job, a folder for each analysis and bucket size, then the manifest.

        A chart belongs to the last analysis that lists it, or to none. Rows whose bucket_minutes is no
        positive number, or that have none, go to the base shard, which every analysis has in the manifest. A write that breaks
        off leaves the manifest before it in force.
        """
        owner = {chart: a for a, listed in analyses.items() for chart in listed}
        order = {a: list(dict.fromkeys(c for c in listed if c)) for a, listed in analyses.items()}
        if rest := sorted(c for c in charts if c not in owner):
            order[SHARED] = rest
            owner |= dict.fromkeys(rest, SHARED)
        slug, data = slugs(list(order)), f"data/{uuid.uuid4().hex}"
        lines = None
        for chart, df in charts.items():
            bucket = bucket_minutes_of(df, "bucket_minutes") if "bucket_minutes" in df.columns else F.lit(None).cast("int")
            rows = _safe(df)
            row = F.to_json(F.struct(*(F.col(f"`{x}`") for x in rows.columns)), {"ignoreNullFields": "false"})
            line = rows.select(F.lit(slug[owner[chart]]).alias("analysis"), F.coalesce(bucket.cast("string"), F.lit(BASE)).alias("shard"), F.concat(F.lit(f'{{"chart_id":{json.dumps(chart)},"row":'), row, F.lit("}")).alias("value"))
            lines = line if lines is None else lines.unionByName(line)
        shards: dict[str, list[str]] = {}
        options: dict[str, list[int]] = {c: [] for c in owner}
        if lines is not None:
            lines.write.partitionBy("analysis", "shard").text(f"{self.folder}/{data}")
            written = self.spark.read.text(f"{self.folder}/{data}", recursiveFileLookup=False)
            found = written.select("analysis", F.col("shard").cast("string").alias("shard"), F.get_json_object("value", "$.chart_id").alias("chart")).distinct().collect()  # charts x bucket sizes
            for r in found:
                shards.setdefault(r["analysis"], []).append(r["shard"])
                if r["shard"] != BASE:
                    options[r["chart"]].append(int(r["shard"]))
        entries = {
            a: {
                "slug": slug[a],
                "base": f"{data}/analysis={slug[a]}/shard={BASE}",
                "buckets": {s: f"{data}/analysis={slug[a]}/shard={s}" for s in sorted(set(shards.get(slug[a], [])) - {BASE}, key=int)},
                "has_base": BASE in shards.get(slug[a], []),
                "chart_ids": order[a],
                "chart_bucket_options": {c: sorted(options.get(c, [])) for c in order[a]},
            }
            for a in order
        }
        manifest = {"version": 1, "analysis": entries, "chart_to_analysis": owner, "schemas": {c: json.loads(df.schema.json()) for c, df in charts.items()}}
        self._publish(manifest)
        return manifest

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(m[1]) for x in self._fs.listStatus(folder) if (m := re.fullmatch(r"(\d+)\.json", x.getPath().getName())))

    def _publish(self, manifest: dict[str, Any]) -> None:
        number = (self._numbers() or [-1])[-1] + 1
        draft, final = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifests/{number:06d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError("another writer published this manifest")

    def manifest(self) -> dict[str, Any]:
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no manifest in {self.folder}")
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{numbers[-1]:06d}.json", wholetext=True).first()[0])

    def read(self, chart: str, bucket_minutes: int | None = None, *, base_only: bool = False) -> DataFrame:
        """Rows of a chart as they were written; of one bucket size, or of the base shard alone, only that shard's files are read."""
        manifest = self.manifest()
        entry = manifest["analysis"][manifest["chart_to_analysis"][chart]]
        paths = [entry["base"]] if entry["has_base"] and bucket_minutes is None else []
        if not base_only:
            paths += [p for s, p in entry["buckets"].items() if bucket_minutes is None or int(s) == bucket_minutes]
        schema = StructType.fromJson(manifest["schemas"].get(chart, {"type": "struct", "fields": []}))
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.text([f"{self.folder}/{p}" for p in paths]).where(F.get_json_object("value", "$.chart_id") == chart)
        return rows.select(F.from_json("value", StructType().add("row", schema)).alias("x")).select("x.row.*")


def load_artifacts(spark: SparkSession, folder: str, kind: str = "parquet") -> dict[str, DataFrame]:
    """Every table that was written to <folder>/<name>.<kind>, by name; columns of times that CSV holds as text are times again if all their values are."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown table format: {kind}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []
    out: dict[str, DataFrame] = {}
    for name in names:
        if not name.endswith(f".{kind}"):
            continue
        df = spark.read.parquet(f"{folder}/{name}") if kind == "parquet" else spark.read.option("header", True).csv(f"{folder}/{name}")
        texts = [x.name for x in df.schema.fields if x.name in TIMES and x.dataType.typeName() == "string"]
        if texts:
            bad = df.agg(*(F.count_if(F.col(x).isNotNull() & F.col(x).try_cast("timestamp_ntz").isNull()).alias(x) for x in texts)).first()
            df = df.withColumns({x: F.col(x).cast("timestamp_ntz") for x in texts if not bad[x]})
        out[name.removesuffix(f".{kind}")] = df
    return out
