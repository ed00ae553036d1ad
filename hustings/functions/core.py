"""Column functions: names, stances, local time, rates and rank statistics. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Z95, Z998 = 1.96, 3.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# names -------------------------------------------------------------------------------------------


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def clean_name(c: Column | str, keep_commas: bool = False) -> Column:
    """Trim, drop punctuation other than hyphens, apostrophes and, if asked, commas; white space becomes single, case stays."""
    kept = r"(?U)[^\w\s\-',]" if keep_commas else r"(?U)[^\w\s\-']"
    return squeeze(F.regexp_replace(col(c), kept, ""))  # of a null too, which squeeze makes empty


def split_name(c: Column) -> tuple[Column, Column]:
    """(last, first) in capitals: cut at the first comma, else the last word is the last name."""
    comma = F.instr(c, ",")
    words = F.split(c, " ")
    last = F.when(comma > 0, F.trim(F.substring(c, F.lit(1), comma - 1))).otherwise(F.element_at(words, -1))
    rest = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    first = F.when(comma > 0, F.trim(F.substring(c, comma + 1, F.length(c)))).otherwise(rest)
    return F.upper(last), F.upper(first)


def clean_token(c: Column | str) -> Column:
    """Capital letters, apostrophes, hyphens and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), r"[^A-Z'\- ]", ""), " +", " "))


def stance(c: Column | str) -> Column:
    t = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(t == "PRO", "Pro").when(t == "CON", "Con").otherwise("Unknown")


def block_key(last: Column | str, first: Column | str) -> Column:
    return F.upper(F.concat(F.substring(col(last), 1, 4), F.lit("|"), F.substring(col(first), 1, 1)))


# time --------------------------------------------------------------------------------------------


def minute_of_day(t: Column | str) -> Column:
    return F.hour(col(t)) * 60 + F.minute(col(t))


def floor_minute(t: Column | str) -> Column:
    return F.date_trunc("MINUTE", col(t)).cast("timestamp_ntz")


def floor_bucket(t: Column | str, minutes: Column | str | int) -> Column:
    """Floor of local wall-clock time to a bucket counted from midnight."""
    b = F.lit(minutes) if isinstance(minutes, int) else col(minutes)
    return floor_minute(t) - F.make_dt_interval(F.lit(0), F.lit(0), minute_of_day(t) % b, F.lit(0))


def plus_minutes(t: Column | str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return col(t) + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later)) / 60e6


def with_buckets(df: DataFrame, time: str, sizes: tuple[int, ...], out: str = "bucket_start") -> DataFrame:
    """One row for each bucket size, with bucket_minutes and the start of the bucket."""
    spread = df.withColumn("bucket_minutes", F.explode(F.array(*(F.lit(b) for b in sizes))))
    return spread.withColumn(out, floor_bucket(time, "bucket_minutes"))


def bucket_minutes_of(df: DataFrame, column: str) -> Column:
    """Minutes of a bucket from whatever a chart row holds: numbers and their texts rounded (halves to even), null unless above zero; truth values are no minutes."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    if kind in ("boolean", "void") or kind not in ("string", "double", "float", "decimal", "byte", "short", "integer", "long"):
        return F.lit(None).cast("int")
    x = F.trim(c).try_cast("double") if kind == "string" else c.cast("double")
    whole = F.when(~F.isnan(x) & (F.abs(x) < 2.0**31 - 1), F.rint(x))
    return F.when(whole > 0, whole.cast("int"))


#: Lenses and other names they go by.
LENSES = ("raw", "exact_row_dedup", "side_by_side")


def lens_of(name: str | None, default: str = "raw") -> str:
    """A lens by its name in any case, the default for none; an error for any other."""
    text = (name or "").strip().lower() or default
    if text not in LENSES:
        raise ValueError(f"{name!r} is no lens: {', '.join(LENSES)}")
    return text


def localise(instant: Column | str, zone: str) -> Column:
    """A wall-clock time checked against its zone: moved past a gap to the first valid instant, null where it comes twice."""
    t = col(instant)
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), t)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    later = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + F.expr("INTERVAL 1 HOUR"))
    return F.when(back != t, F.date_trunc("HOUR", back).cast("timestamp_ntz")).when(later == t, F.lit(None).cast("timestamp_ntz")).otherwise(t)


def in_off_hours(hour: Column | str, start: int, end: int) -> Column:
    h = col(hour)
    return h.between(start, end) if start <= end else (h >= start) | (h <= end)


# rates -------------------------------------------------------------------------------------------


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is not above zero."""
    return F.when(col(b) > 0, col(a).cast("double") / col(b))


def wilson(successes: Column | str, total: Column | str) -> tuple[Column, Column]:
    n = col(total).cast("double")
    p = F.least(F.greatest(col(successes).cast("double") / n, F.lit(0.0)), F.lit(1.0))
    zz = Z95 * Z95
    centre = (p + zz / (n * 2.0)) / (zz / n + 1.0)
    half = F.sqrt((p * (1.0 - p) + zz / (n * 4.0)) / n) * Z95 / (zz / n + 1.0)
    ok = col(total) > 0
    return F.when(ok, F.greatest(centre - half, F.lit(0.0))), F.when(ok, F.least(centre + half, F.lit(1.0)))


def with_wilson(df: DataFrame, successes: str, total: str, prefix: str) -> DataFrame:
    low, high = wilson(successes, total)
    return df.withColumns({f"{prefix}_wilson_low": low, f"{prefix}_wilson_high": high}).withColumn(f"{prefix}_wilson_half_width", (F.col(f"{prefix}_wilson_high") - F.col(f"{prefix}_wilson_low")) / 2.0)


def low_power(total: Column | str, least: int) -> Column:
    return F.coalesce(col(total) < max(1, least), F.lit(True))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def stance_counts(position: str = "position_normalized") -> list[Column]:
    p = F.col(position)
    return [count_where(p == "Pro").alias("n_pro"), count_where(p == "Con").alias("n_con"), count_where(p == "Unknown").alias("n_unknown")]


def with_q(df: DataFrame, p: str, q: str, partition: list[str] | None = None, tested: Column | None = None) -> DataFrame:
    """Add Benjamini-Hochberg q values; two window steps, as ranks come before minima."""
    ok = F.col(p).isNotNull() if tested is None else tested & F.col(p).isNotNull()
    keys = [F.col(c) for c in partition or []]
    df = df.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    base = Window.partitionBy(*keys, "__ok")
    df = df.withColumn("__r", F.row_number().over(base.orderBy(p))).withColumn("__m", F.count(F.lit(1)).over(base))
    ahead = base.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)  # from the largest p down: one pass
    scaled = F.min(F.col(p) * F.col("__m") / F.col("__r")).over(ahead)
    return df.withColumn(q, F.when(F.col("__ok"), F.least(F.lit(1.0), scaled))).drop("__ok", "__r", "__m")


def average_rank_share(x: str, partition: list[str] | None = None) -> Column:
    """Rank with ties averaged, over the number of rows."""
    keys = [F.col(c) for c in partition or []]
    every: WindowSpec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ties = Window.partitionBy(*keys, x)
    rank = F.rank().over(every.orderBy(x))
    return (rank + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / F.count(F.lit(1)).over(every)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """For comparisons: doubles rounded, NaN as null, no negative zero, integers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind == "double":
            unit = 10.0**digits  # scaled first, as databases do: ties fall alike
            c = F.round(F.nanvl(c, F.lit(None).cast("double")) * unit) / unit + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(out)
