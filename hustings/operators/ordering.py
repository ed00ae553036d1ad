"""Order of arrival: ids against times and names, and alphabetical order within buckets."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.functions.kernels import normal_p as normal_p_of
from hustings.operators.profile import steps_back
from hustings.plans.catalog import Catalog


def average_ranks(df: DataFrame, value: str, out: str, stretch: Column) -> DataFrame:
    """Add ranks with ties averaged. Distinct values are ranked, not rows: rows join their value's rank.

    `stretch` rises with the value: values are ordered within a stretch, and the stretches, far fewer, among themselves.
    """
    values = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__stretch", stretch)
    stretches = values.groupBy("__stretch").agg(F.sum("__n").alias("__size"))
    before = stretches.select("__stretch", (F.sum("__size").over(Window.orderBy("__stretch")) - F.col("__size")).alias("__before"))
    within = F.sum("__n").over(Window.partitionBy("__stretch").orderBy(value))
    ranked = values.withColumn("__within", within).join(before, "__stretch")
    return df.join(ranked.select(value, (F.col("__before") + F.col("__within") - (F.col("__n") - 1) / 2.0).alias(out)), value)


def sortedness_metrics(c: Catalog) -> DataFrame:
    """Spearman correlations of ids with times and names, and steps back in time, in one row."""
    r = c.records.select(F.col("id").cast("long").alias("id"), "timestamp", F.concat("last", F.lit("|"), "first").alias("name"))
    for value, out, stretch in (("id", "r_id", F.floor(F.col("id") / (1 << 16))), ("timestamp", "r_time", F.date_trunc("hour", "timestamp")), ("name", "r_name", F.substring("name", 1, 4))):
        r = average_ranks(r, value, out, stretch)
    one = r.agg(F.count(F.lit(1)).alias("n_records"), F.corr("r_id", "r_time").alias("id_timestamp_spearman"), F.corr("r_id", "r_name").alias("id_name_spearman"))
    back = steps_back(c.records).withColumnRenamed("non_monotonic_timestamp_vs_id", "time_monotonic_breaks")
    df = one.join(F.broadcast(back))  # one row each
    return df.withColumn("time_break_ratio", f.ratio("time_monotonic_breaks", F.col("n_records") - 1))


KEY = ["bucket_minutes", "bucket_start"]

#: Records that one task orders. A record becomes a row for each bit of its rank, or for each bucket size, within the task that reads it.
ROWS = 25_000


def tasks(c: Catalog) -> int:
    """How many tasks share the records, so that what one of them holds does not grow with their number."""
    if c not in _tasks:
        _tasks[c] = max(8, -(-c.records.where("minute_bucket is not null").count() // ROWS))
    return _tasks[c]


#: By catalog: records are counted once.
_tasks: WeakKeyDictionary[Catalog, int] = WeakKeyDictionary()


def minute_facts(c: Catalog) -> DataFrame:
    """For each minute: first and last name to arrive, steps back in the alphabet, and signs of its pairs of rows.

    Pairs are counted by merging: arrival ranks are halved bit by bit, and at each bit the rows of a group that differ in
    it stand left or right. Ordered by name, running counts give for every right row the left rows with smaller and with
    larger names; every pair is split at exactly one bit.
    """
    arrival = Window.partitionBy("minute_bucket").orderBy("timestamp", "id", "name_display")
    rows = c.records.where("minute_bucket is not null").select("minute_bucket", "timestamp", "id", "name_display").repartition(tasks(c), "minute_bucket")
    rows = rows.withColumns({"r": F.row_number().over(arrival) - 1, "falls": (F.lag("name_display").over(arrival) > F.col("name_display")).cast("long")})
    ends = rows.groupBy("minute_bucket").agg(F.count(F.lit(1)).alias("n"), F.min_by("name_display", "r").alias("head"), F.max_by("name_display", "r").alias("tail"), F.coalesce(F.sum("falls"), F.lit(0)).alias("falls"))
    bits = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("n") - 1)) - 1)).alias("bit")
    level = rows.join(ends.select("minute_bucket", "n"), "minute_bucket").select("minute_bucket", "name_display", "r", bits)
    group = [F.col("minute_bucket"), F.col("bit"), F.expr("shiftright(r, bit + 1)").alias("g")]
    right = F.expr("shiftright(r, bit) & 1")
    cells = level.groupBy(*group, "name_display").agg(F.sum(1 - right).alias("n_0"), F.sum(right).alias("n_1"))
    signs = crossed(cells, ["minute_bucket", "bit", "g"], 2).groupBy("minute_bucket").agg(F.sum("signs").alias("signs"))
    return ends.join(signs, "minute_bucket")


def crossed(cells: DataFrame, key: list[str], parts: int) -> DataFrame:
    """Signs of the pairs of rows in different parts of a group: cells have the rows of each name in part 0, 1 ... as n_0, n_1 ..."""
    group = Window.partitionBy(*key)
    line = group.orderBy("name_display")
    n = [F.col(f"n_{i}") for i in range(parts)]
    upto = [F.sum(x).over(line) for x in n]
    above = [(u - x) - (F.sum(x).over(group) - u) for u, x in zip(upto, n)]  # smaller names of part i, less the larger ones
    sign = sum((n[j] * above[i] for j in range(parts) for i in range(j)), F.lit(0))
    return cells.withColumn("signs", sign)


def bucket_ordering(c: Catalog) -> DataFrame:
    """Buckets of three rows or more: whether names stand in order, and Kendall's tau-b of arrival against name.

    Only minutes look at records. A larger bucket adds what its parts have and the pairs between parts, which follow
    from the names' counts in each part; each bucket size divides the next.
    """
    sizes = c.config.buckets
    minutes = c.get(minute_facts)
    names = c.records.where("minute_bucket is not null").select("minute_bucket", "name_display").repartition(tasks(c), "minute_bucket").groupBy("minute_bucket", "name_display").agg(F.count(F.lit(1)).alias("n"))
    inner = {big: small for small, big in zip((1, *sizes), sizes)}
    parts = max(big // small for big, small in inner.items())
    small = F.create_map(*(F.lit(x) for pair in inner.items() for x in pair))[F.col("bucket_minutes")]
    of_day = lambda t: F.hour(t) * 60 + F.minute(t)  # noqa: E731  (sizes divide a day)
    part = F.floor((of_day("minute_bucket") - of_day("bucket_start")) / small)
    cells = f.with_buckets(names, "minute_bucket", sizes).withColumn("part", part).repartition(tasks(c), *KEY)
    cells = cells.groupBy(*KEY, "name_display").agg(*(F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(f"n_{i}") for i in range(parts)))
    k = sum((F.col(f"n_{i}") for i in range(1, parts)), F.col("n_0"))
    between = crossed(cells, KEY, parts).groupBy(*KEY).agg(F.sum(k).alias("n_records"), F.sum(k * (k - 1) / 2.0).alias("ties"), F.sum((k * (k - 1) * (2 * k + 5)).cast("double")).alias("tied"), F.sum("signs").alias("signs"))
    # signs between parts of a bucket count for every bucket around it, as do those within its minutes
    around = F.explode(F.filter(F.array(*(F.lit(s) for s in sizes)), lambda s: s >= F.col("inner_minutes"))).alias("bucket_minutes")
    of = between.select(F.col("bucket_minutes").alias("inner_minutes"), F.col("bucket_start").alias("at"), "signs").unionByName(minutes.select(F.lit(1).alias("inner_minutes"), F.col("minute_bucket").alias("at"), "signs"))
    of = of.select("at", "signs", around)
    signs = of.withColumn("bucket_start", f.floor_bucket("at", "bucket_minutes")).groupBy(*KEY).agg(F.sum("signs").alias("signs"))
    line = Window.partitionBy(*KEY).orderBy("minute_bucket")
    order = f.with_buckets(minutes.select("minute_bucket", "head", "tail", "falls"), "minute_bucket", sizes).withColumn("seam", (F.lag("tail").over(line) > F.col("head")).cast("long"))
    order = order.groupBy(*KEY).agg((F.sum("falls") + F.coalesce(F.sum("seam"), F.lit(0)) == 0).alias("is_alphabetical"))
    out = between.drop("signs").where("n_records >= 3").join(signs, KEY).join(order, KEY)
    pairs = F.col("n_records").cast("double") * (F.col("n_records") - 1) / 2
    tau = F.when(pairs - F.col("ties") > 0, F.col("signs") / F.sqrt(pairs * (pairs - F.col("ties")))).otherwise(0.0)
    out = with_kendall_p(out.withColumn("kendall_tau", tau), "n_records", "signs", "ties", "tied")
    return out.withColumn("abs_kendall_tau", F.abs("kendall_tau")).drop("signs", "ties", "tied")


#: Rows up to which the null distribution of a ranking without ties is exact.
EXACT_ROWS = 33


def inversion_shares(most: int = EXACT_ROWS) -> list[tuple[int, int, float]]:
    """(n, c, share): the share of all orders of n things with c inversions at most. The n-th thing adds 0 to n - 1 inversions, equally often."""
    rows, shares = [], [1.0]
    for n in range(2, most + 1):
        wide = [0.0] * (n - 1) + shares + [0.0] * (n - 1)
        shares = [sum(wide[c : c + n]) / n for c in range(len(shares) + n - 1)]
        below = 0.0
        for c, x in enumerate(shares):
            below += x
            rows.append((n, c, below))
    return rows


def with_kendall_p(df: DataFrame, n: str, signs: str, ties: str, tied: str) -> DataFrame:
    """Add the two-sided p of Kendall's S where arrival has no ties.

    Without ties among the names, up to EXACT_ROWS rows (or one inversion at most) it is exact, from a fixed table of inversion
    counts; else normal, with the variance that tied names leave: `tied` is the sum of k(k-1)(2k+5) over names that come k times. Rows of
    one name say nothing: 1.
    """
    pairs = F.col(n).cast("double") * (F.col(n) - 1) / 2
    few = F.least(pairs - F.col(signs), pairs + F.col(signs)) / 2  # inversions of the order or of its reverse
    table = df.sparkSession.createDataFrame(inversion_shares(), "__n long, __c long, __share double")
    exact = (F.col(ties) == 0) & (F.col(n) <= EXACT_ROWS)
    df = df.join(F.broadcast(table), exact & (F.col("__n") == F.col(n)) & (F.col("__c") == few.cast("long")), "left")  # 5,984 rows at EXACT_ROWS = 33
    variance = (F.col(n).cast("double") * (F.col(n) - 1) * (2 * F.col(n) + 5) - F.col(tied)) / 18
    df = df.withColumn("__p", normal_p_of(F.when(variance > 0, F.col(signs) / F.sqrt(variance))))
    rare = F.when((F.col(ties) == 0) & (few <= 1), 0.0)  # beyond EXACT_ROWS: 2 / 33! at most
    p = F.when(pairs - F.col(ties) <= 0, 1.0).when(exact, F.least(F.lit(1.0), 2.0 * F.col("__share"))).otherwise(F.coalesce(rare, F.col("__p"), F.lit(1.0)))
    return df.withColumn("kendall_p_value", p).drop("__n", "__c", "__share", "__p")


def bucket_ordering_summary(c: Catalog) -> DataFrame:
    return c.get(bucket_ordering).groupBy("bucket_minutes").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.avg("n_records").alias("avg_records_per_bucket"),
        F.avg(F.col("is_alphabetical").cast("double")).alias("alphabetical_ratio"),
        F.avg("kendall_tau").alias("mean_kendall_tau"),
        F.avg("abs_kendall_tau").alias("mean_abs_kendall_tau"),
        F.max("abs_kendall_tau").alias("max_abs_kendall_tau"),
        F.avg((F.col("abs_kendall_tau") >= 0.8).cast("double")).alias("strong_ordering_ratio"),
    )


def minute_ordering(c: Catalog) -> DataFrame:
    return c.get(bucket_ordering).where("bucket_minutes = 1")
