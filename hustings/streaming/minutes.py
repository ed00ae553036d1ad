"""Sign-ins as a stream: minute counts with late rows, repeats within a watermark, and sessions of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.functions import core as f


def with_instant(records: DataFrame) -> DataFrame:
    """Watermarks need instants: the wall-clock time read as UTC, so that windows floor local time."""
    return records.withColumn("instant", F.col("timestamp").cast("timestamp"))


def minute_counts(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """n_total, n_pro, n_con and n_unknown of each minute, final once the watermark has passed it."""
    rows = with_instant(records).withWatermark("instant", late)
    return rows.groupBy(F.window("instant", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n_total"), *f.stance_counts()).select(F.col("w.start").cast("timestamp_ntz").alias("minute_bucket"), "n_total", "n_pro", "n_con", "n_unknown")


def first_of_name(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each name and minute: the deduplicated lens while rows still arrive."""
    rows = with_instant(records).withColumn("minute_bucket", f.floor_minute("timestamp")).withWatermark("instant", late)
    return rows.dropDuplicatesWithinWatermark(["canonical_name", "minute_bucket"])


def name_sessions(records: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of one name: rows closer together than the gap."""
    rows = with_instant(records).withWatermark("instant", late)
    sessions = rows.groupBy(F.session_window("instant", gap).alias("s"), "canonical_name").agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("canonical_name", F.col("s.start").cast("timestamp_ntz").alias("session_start"), F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")
