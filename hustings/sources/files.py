"""Scans of sign-in files, registry extracts, frequency lists, nickname lists and side-cars."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hustings.functions import core as f

#: Canonical columns and the source headers they have by default.
COLUMNS = {"id": "Count", "name": "Name", "organization": "Organization", "position": "Position", "time_signed_in": "Time Signed In"}
#: Headers under which extracts and lists may hold a field, compared without regard to case.
FIRST, LAST = ("FName", "FirstName", "First_Name", "First"), ("LName", "LastName", "Last_Name", "Last")
FIELDS = {
    "state_voter_id": ("StateVoterID", "State_Voter_ID", "VoterID"),
    "middle_name": ("MName", "MiddleName", "Middle_Name"),
    "name_suffix": ("NameSuffix", "Suffix"),
    "birth_year": ("Birthyear", "BirthYear", "Birth_Year"),
    "status_code": ("StatusCode", "Status_Code", "Status"),
}
TOKEN, WEIGHT = ("name", "token", "firstname", "first_name", "lastname", "last_name", "surname"), ("count", "n", "frequency", "freq", "weight", "total", "probability")
MINIMUM = {"generic": 0.0, "ssa_first": 5.0, "census_last": 1.0}


def resolve(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    lower = {c.strip().lower(): c for c in columns}
    return next((lower[c.lower()] for c in candidates if c.lower() in lower), None)


def encoding(path: str | Path) -> str:
    """utf-8-sig with a byte-order mark, utf-8 if all bytes are valid, else cp1252. Reads a driver-side file in pieces."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as file:
        head = file.read(3)
        if head == codecs.BOM_UTF8:
            return "utf-8-sig"
        try:
            decoder.decode(head)
            while piece := file.read(1 << 20):
                decoder.decode(piece)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return "cp1252"
    return "utf-8"


def scan_csv(spark: SparkSession, path: str, sep: str = ",", charset: str = "UTF-8") -> DataFrame:
    """All columns as strings, empty where absent; a file splits by lines unless records span lines."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", charset).option("escape", '"').csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip().lstrip("﻿")) for c in df.columns])


def normalize_columns(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    columns = columns or COLUMNS
    missing = [s for s in columns.values() if s not in df.columns]
    if missing:
        raise ValueError(f"missing source columns: {', '.join(missing)}")
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def parse_time(c: Column | str) -> Column:
    """`m/d/Y h:mm AM/PM`, row by row also the general forms; wall-clock time without a zone."""
    t = f.squeeze(c)
    text = F.when(t == "", None).otherwise(t)
    return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm a")), F.try_to_timestamp(text)).cast("timestamp_ntz")


def with_times(df: DataFrame, column: str = "time_signed_in", out: str = "timestamp") -> DataFrame:
    """Wall-clock times of a whole source: the usual form in every row, or the general forms if no row has the usual one.

    Unlike parse_time this never mixes forms. Which it is follows from a one-row aggregate; a source without any time is an error.
    """
    text = F.nullif(f.squeeze(column), F.lit(""))
    usual, general = F.try_to_timestamp(text, F.lit("M/d/yyyy h:mm a")), F.try_to_timestamp(text)
    seen = df.agg(F.count(usual).alias("usual"), F.count(general).alias("general")).first()
    if not seen["usual"] and not seen["general"]:
        raise ValueError(f"{column} holds no time")
    return df.withColumn(out, (usual if seen["usual"] else general).cast("timestamp_ntz"))


def sign_ins(spark: SparkSession, path: str, columns: dict[str, str] | None = None, zone: str = "America/Los_Angeles") -> DataFrame:
    """Rows ready for `adapters.canonical`."""
    df = normalize_columns(scan_csv(spark, path), columns)
    return df.withColumn("timestamp", f.localise(parse_time("time_signed_in"), zone))


def numbered(df: DataFrame, offset: int = 0) -> DataFrame:
    """1-based row numbers in file order: partition sizes first, then a position within each partition, no single task."""
    rows = df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    sizes = {r["__p"]: r["n"] for r in rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = {}, offset
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return df.withColumn("source_row_number", F.lit(0).cast("long"))
    base = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv))
    within = F.col("__m").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("source_row_number", base[F.col("__p")].cast("long") + within + 1).drop("__p", "__m")


def normalize_submissions(df: DataFrame, source_file: str, zone: str = "America/Los_Angeles", offset: int = 0) -> DataFrame:
    """Canonical string rows to stored submissions: cleaned fields, stance, times, row hash and key."""
    raw = {c: f.squeeze(c) for c in COLUMNS}
    df = numbered(df, offset).withColumn("source_file", F.lit(source_file))
    df = df.withColumns({"source_id": raw["id"], "name_raw": raw["name"], "organization_raw": raw["organization"], "position_raw": raw["position"], "time_signed_in_raw": raw["time_signed_in"]})
    last, first = f.split_name(F.col("name_raw"))
    df = df.withColumns(
        {
            "name_clean": F.upper("name_raw"),
            "name_last": last,
            "name_first": first,
            "organization_clean": F.upper("organization_raw"),
            "organization_is_blank": F.col("organization_raw") == "",
            "position_normalized": f.stance("position_raw"),
            "signed_at": f.localise(parse_time("time_signed_in_raw"), zone),
        }
    )
    parts = [F.col(c).cast("string") for c in ("source_file", "source_row_number", "source_id", "name_raw", "organization_raw", "position_raw", "time_signed_in_raw")]
    df = df.withColumns({"minute_bucket": f.floor_minute("signed_at"), "source_hash": F.sha1(F.concat_ws("|", *parts)), "submission_key": F.concat_ws(":", parts[0], parts[1])})
    return df.drop(*COLUMNS)


def normalize_registry(df: DataFrame, source_file: str) -> DataFrame:
    """A registry extract to stored voters; rows without either name go."""
    first, last = resolve(df.columns, FIRST), resolve(df.columns, LAST)
    if first is None or last is None:
        raise ValueError(f"a registry extract needs first and last names; columns: {', '.join(df.columns)}")
    new = {"first_name": F.trim(F.coalesce(first, F.lit(""))), "last_name": F.trim(F.coalesce(last, F.lit("")))}
    for name, candidates in FIELDS.items():
        c = resolve(df.columns, candidates)
        new[name] = F.trim(F.coalesce(c, F.lit(""))) if c else F.lit("")
    out = df.select([v.alias(k) for k, v in new.items()])
    out = out.withColumns({"canonical_first": f.clean_token("first_name"), "canonical_last": f.clean_token("last_name"), "source_file": F.lit(source_file)})
    out = out.where("canonical_first <> '' and canonical_last <> ''").withColumn("canonical_name", F.concat_ws("|", "canonical_last", "canonical_first"))
    fallback = F.concat(F.lit("NAME:"), F.sha1(F.concat_ws("|", "canonical_last", "canonical_first", "birth_year", "name_suffix")))
    return out.withColumns(
        {
            "source_hash": F.sha1(F.concat_ws("|", "state_voter_id", "canonical_last", "canonical_first", "birth_year", "status_code")),
            "voter_key": F.when(F.col("state_voter_id") != "", F.concat(F.lit("STATE:"), "state_voter_id")).otherwise(fallback),
        }
    )


def active_registry(voters: DataFrame, active_only: bool = True) -> DataFrame:
    """Stored voters as the linkage operators read them."""
    if active_only:
        voters = voters.where("lower(status_code) = 'active'")
    return voters.select(F.col("canonical_last").alias("last"), F.col("canonical_first").alias("first"), "canonical_name")


def frequency_baseline(df: DataFrame, profile: str = "generic", min_weight: float = 0.0) -> DataFrame:
    """name, count, probability of cleaned tokens whose weight reaches the minimum."""
    if profile not in MINIMUM:
        raise ValueError(f"unknown profile: {profile}")
    name, value = resolve(df.columns, TOKEN), resolve(df.columns, WEIGHT)
    if name is None or value is None:
        raise ValueError("a frequency list needs a name and a weight")
    least = max(min_weight, MINIMUM[profile])
    rows = df.select(f.clean_token(name).alias("name"), F.expr(f"try_cast(`{value}` as double)").alias("weight")).where("name <> ''").where((F.col("weight") > 0) & (F.col("weight") >= least))
    sums = rows.groupBy("name").agg(F.sum("weight").alias("count"))
    total = sums.agg(F.sum("count").alias("total"))  # one row
    return sums.join(F.broadcast(total)).select("name", "count", (F.col("count") / F.col("total")).alias("probability"))


def nickname_map(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """alias, canonical: aliases that stand for one name only, and the overrides."""
    rows = df.select(f.clean_token("alias").alias("alias"), f.clean_token("canonical").alias("canonical")).where("alias <> '' and canonical <> ''")
    one = rows.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.max("canonical").alias("other")).where("canonical = other").drop("other")
    if not overrides:
        return one
    fixed = df.sparkSession.createDataFrame(sorted(overrides.items()), "alias string, canonical string")
    return one.join(F.broadcast(fixed.select("alias")), "alias", "left_anti").unionByName(fixed)  # a handful of overrides


def load_table(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    raise ValueError(f"unknown table format: {path}")


def stored_submissions(rows: DataFrame, source_file: str | None = None) -> DataFrame:
    """Stored submissions as canonical input; ids fall back to the row's place in its file."""
    if source_file is not None:
        rows = rows.where(F.col("source_file") == source_file)
    fallback = F.row_number().over(Window.partitionBy("source_file").orderBy("source_row_number")).cast("string")
    return rows.select(
        F.coalesce(F.when(F.col("source_id") != "", F.col("source_id")), fallback).alias("id"), F.col("name_raw").alias("name"), F.col("organization_raw").alias("organization"), F.col("position_raw").alias("position"), F.col("signed_at").alias("timestamp")
    )


def database_submissions(spark: SparkSession, url: str, table: str = "public_submissions", source_file: str | None = None, partitions: int = 8, driver: str | None = None, properties: dict[str, str] | None = None) -> DataFrame:
    """Stored submissions of a database table over JDBC, in ranges of their row numbers, as canonical input.

    The bounds of the ranges are one query; rows outside them, or without a number, fall into the first or last
    range, so none is lost. A source file is a condition that the database answers, and so is the choice of columns.
    """
    options = {"url": url} | ({"driver": driver} if driver else {}) | (properties or {})
    reader = spark.read.format("jdbc").options(**options)
    columns = "source_file source_row_number source_id name_raw organization_raw position_raw signed_at".split()
    rows = spark.read.format("jdbc").options(**options).option("dbtable", table)
    named = {x.lower(): x for x in rows.load().columns}  # as the database writes them
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    number, text = quote(named["source_row_number"]), (source_file or "").replace("'", "''")
    where = f" WHERE {quote(named['source_file'])} = '{text}'" if source_file is not None else ""
    low, high = reader.option("query", f"SELECT min({number}) AS low_, max({number}) AS high_ FROM {table}{where}").load().first()
    if low is not None and high > low and partitions > 1:
        rows = rows.option("partitionColumn", named["source_row_number"]).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    df = rows.load()
    df = df.select(*(F.col(x).alias(x.lower()) for x in df.columns if x.lower() in columns))
    return stored_submissions(df.withColumn("signed_at", F.col("signed_at").cast("timestamp_ntz")), source_file)


def side_car(text: str) -> dict:
    """Hearing metadata from JSON or flat YAML: version 1, an id, a zone, ordered times as wall-clock times of the zone."""
    try:
        raw = json.loads(text)
    except ValueError:
        raw = {}
        for line in text.splitlines():
            key, colon, value = line.split("#")[0].partition(":")
            if colon and key.strip():
                raw[key.strip()] = value.strip().strip("'\"")
    if str(raw.get("schema_version")) != "1":
        raise ValueError("schema_version must be 1")
    if not str(raw.get("hearing_id", "")).strip():
        raise ValueError("hearing_id is empty")
    zone = ZoneInfo(raw.get("timezone") or "America/Los_Angeles")
    out: dict = {"hearing_id": str(raw["hearing_id"]).strip(), "timezone": str(zone)}
    for key in ("meeting_start", "sign_in_open", "sign_in_cutoff", "written_testimony_deadline"):
        if raw.get(key):
            t = dt.datetime.fromisoformat(str(raw[key]))
            out[key] = (t.astimezone(zone) if t.tzinfo else t).replace(tzinfo=None)
    if len(out) == 2:
        raise ValueError("no timestamp is given")
    if "sign_in_open" in out and "sign_in_cutoff" in out and out["sign_in_open"] > out["sign_in_cutoff"]:
        raise ValueError("sign_in_open is after sign_in_cutoff")
    return out
