"""Canonical records, from sign-in rows of any source and from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.config import Config
from hustings.functions import core as f
from hustings.functions.kernels import compatibility_form
from hustings.plans.catalog import Catalog


def never_null(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))


def canonical(rows: DataFrame, config: Config, nicknames: DataFrame | None = None) -> DataFrame:
    """(id, name, organization, position, timestamp: timestamp_ntz) to the canonical record frame.

    Nicknames map the first word of the first name: a few of them are a literal of the configuration, a table of
    them (alias, canonical; each alias once) is joined, after the literal.
    Names are never null and say so: else every join or grouping on one would first test it for null below the steps that
    make it, with all of them spelled out in the test, tens of regular expressions a row.
    With `normalize_unicode` names that are not ASCII take their compatibility form first.
    """
    if config.normalize_unicode:
        odd = F.when(F.col("name").rlike(r"[^\x00-\x7F]"), F.col("name"))
        rows = rows.withColumn("name", F.coalesce(compatibility_form(odd), "name"))
    df = rows.withColumns({"name_normalized": f.clean_name("name"), "__split": f.clean_name("name", keep_commas=True)})
    last, first = f.split_name(F.col("__split"))
    df = df.withColumns({"last": never_null(last), "first": never_null(first)}).drop("__split")
    head = never_null(F.element_at(F.split("first", " "), 1))
    if config.nicknames:
        pairs = [F.lit(x) for kv in sorted(config.nicknames.items()) for x in kv]
        head = F.coalesce(F.create_map(*pairs)[head], head)
    df = df.withColumn("first_canonical", head)
    if nicknames is not None:
        table = nicknames.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"))
        df = df.join(table, F.col("first_canonical") == F.col("__alias"), "left").withColumn("first_canonical", F.coalesce("__canonical", "first_canonical")).drop("__alias", "__canonical")
    start, end = config.off_hours
    df = df.withColumns(
        {
            "first_initial": F.substring("first_canonical", 1, 1),
            "canonical_name": F.concat("last", F.lit("|"), "first_canonical"),
            "name_display": F.concat("last", F.lit(", "), "first"),
            "position_normalized": f.stance("position"),
            "organization": F.coalesce("organization", F.lit("")),
            "minute_bucket": f.floor_minute("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": F.weekday("timestamp"),
            "date": F.to_date("timestamp"),
        }
    )
    df = df.withColumn("is_off_hours", f.in_off_hours("hour", start, end))
    if config.cutoff:
        df = df.withColumn("minutes_to_cutoff", f.minutes_between(F.lit(config.cutoff).cast("timestamp_ntz"), "timestamp"))
    for name in ("sign_in_open", "meeting_start"):
        if at := getattr(config, name):
            df = df.withColumn(f"minutes_since_{name}", f.minutes_between("timestamp", F.lit(at).cast("timestamp_ntz")))
    return df


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in rows made of `events` and `part`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    words = F.split("p_name", " ")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.join(part, events.user_id == part.p_partkey)
    return rows.select(
        F.col("event_id").alias("id"),
        F.concat(words[1], (F.col("user_id") % 25).cast("string"), F.lit(", "), words[0]).alias("name"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Org "), (k % 20).cast("string"))).alias("organization"),
        F.when(F.col("event_type").isin("click", "signup"), "PRO").when(F.col("event_type").isin("view", "purchase"), "con").otherwise("other").alias("position"),
        F.col("ts").alias("timestamp"),
    )


def test_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows made of `part`: names as the records have them, every second one active. Equal names are cleaned once."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size % 2 = 0")
    words = F.split("p_name", " ")
    rows = part.select(F.concat(words[1], (F.col("p_partkey") % 25).cast("string"), F.lit(", "), words[0]).alias("name")).distinct()
    last, first = f.split_name(F.col("split"))
    rows = rows.withColumn("split", f.clean_name("name", keep_commas=True)).select(never_null(last).alias("last"), never_null(first).alias("first"))
    return rows.select("last", "first", F.concat("last", F.lit("|"), "first").alias("canonical_name")).distinct()


def test_frequencies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(first names, last names) as token and probability, counted over `part`; tokens that begin with an early letter only. Equal words are cleaned once."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = F.split("p_name", " ")
    out = []
    for word in (words[0], F.concat(words[1], (F.col("p_partkey") % 25).cast("string"))):
        rows = part.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = rows.groupBy(f.clean_token("word").alias("token")).agg(F.sum("n").alias("n"), F.max(f.clean_token("word")).alias("same"))
        counts = counts.where("same <> '' and same < 'R'").drop("same")  # of the group: a test of the key would move below both groupings
        total = counts.agg(F.sum("n").alias("total"))
        out.append(counts.join(F.broadcast(total)).select("token", (F.col("n") / F.col("total")).alias("probability")))  # total: one row
    return out[0], out[1]


def surge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-in rows as of test_rows, of which every twelfth moves into twenty minutes after 18:00, all of them PRO, on every sixth
    day of a month; half of those have a letter more at the first name. Bursts, swings and clusters of names follow."""
    hit = (F.col("id") % 12 == 5) & (F.dayofmonth("timestamp") % 6 == 1)
    moved = F.date_trunc("DAY", "timestamp").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(18), (F.floor(F.col("id") / 12) % 20).cast("int"), (F.col("id") % 60).cast("int"))
    letter = F.substring(F.lit("abcdefghij"), (F.floor(F.col("id") / 24) % 10).cast("int") + 1, F.lit(1))
    return test_rows(spark, sf_dir).withColumns(
        {
            "name": F.when(hit & (F.floor(F.col("id") / 12) % 2 == 0), F.concat("name", letter)).otherwise(F.col("name")),
            "position": F.when(hit, "PRO").otherwise(F.col("position")),
            "timestamp": F.when(hit, moved).otherwise(F.col("timestamp")),
        }
    )


def surge_catalog(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Catalog:
    config = config or Config(cutoff="2024-01-29 12:00:00")
    return Catalog(spark, canonical(surge_rows(spark, sf_dir), config), config, test_registry(spark, sf_dir), test_frequencies(spark, sf_dir))


def hearing_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The test records with all times of a hearing."""
    return test_catalog(spark, sf_dir, Config(cutoff="2024-01-29 12:00:00", sign_in_open="2024-01-02 09:00:00", meeting_start="2024-01-29 13:30:00", written_testimony_deadline="2024-01-30 13:30:00"))


def test_catalog(spark: SparkSession, sf_dir: str, config: Config | None = None) -> Catalog:
    config = config or Config(cutoff="2024-01-29 12:00:00")
    return Catalog(spark, canonical(test_rows(spark, sf_dir), config), config, test_registry(spark, sf_dir), test_frequencies(spark, sf_dir))
