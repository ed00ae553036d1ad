"""The similarity join of names against all pairs."""

import random

import pytest

from hustings.functions.kernels import token_set_ratio
from hustings.operators.similar_names import similar_pairs


def plain(spark, rows, threshold):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "block_key string, canonical_name string, name_display string")
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.block_key") == F.col("b.block_key")) & (F.col("a.canonical_name") < F.col("b.canonical_name")))
    s = pairs.select("a.block_key", F.col("a.canonical_name").alias("l"), F.col("b.canonical_name").alias("r"), F.floor(token_set_ratio(F.col("a.name_display"), F.col("b.name_display"))).cast("int").alias("s")).where(F.col("s") >= threshold)
    return set(map(tuple, s.collect()))


def made(rng, n, blocks=1, long=False):
    syllables = ["AN", "BE", "RI", "TO", "LU", "MA", "NE", "SO", "KA", "DI", "Ö", "É"]
    rows = []
    for k in range(n):
        first = "J" + "".join(rng.choices(syllables, k=rng.randint(1, 4 if not long else 9)))
        last = "SMIT" + "".join(rng.choices(["H", "HE", "HSON", "Y", "T", "HERS", "HWAITE"], k=rng.randint(0, 2)))
        more = [rng.choice(["A", "B.", "MARIA", "VAN", "DE", "LA", first, last]) for _ in range(rng.choice([0, 0, 0, 1, 2, 3]))]
        words = [last + ",", first, *more]
        if rng.random() < 0.1:
            rng.shuffle(words)
        text = " ".join(words) + rng.choice(["", "", "", "", " ", "  X"])
        rows.append((f"b{k % blocks}", f"n{k:05d}", text))
    return rows + [("b0", "z1", ""), ("b0", "z2", None), ("b0", "z3", " "), ("b0", "z4", rows[0][2]), ("b0", "z5", rows[0][2])]


@pytest.mark.parametrize("threshold, long", [(92, False), (92, True), (85, False), (97, True), (70, False)])
def test_pairs_equal_all_pairs(spark, threshold, long):
    rows = made(random.Random(threshold + long), 260, 2, long)
    df = spark.createDataFrame(rows, "block_key string, canonical_name string, name_display string")
    found = similar_pairs(df, threshold).collect()
    got = {(r.block_key, r.left_name, r.right_name, r.similarity) for r in found}
    assert len(found) == len(got)
    assert got == plain(spark, rows, threshold) and got


def test_a_block_of_six_thousand_names(spark):
    rng = random.Random(5)
    rows = made(rng, 5995)
    df = spark.createDataFrame(rows, "block_key string, canonical_name string, name_display string").repartition(4)
    got = {(r.left_name, r.right_name, r.similarity) for r in similar_pairs(df, 92).collect()}
    # against all pairs of a tenth of the names with all others: the whole square takes minutes in Python
    some = {name for _, name, _ in rows[::40]}
    want = set()
    from pyspark.sql import functions as F

    a = df.where(F.col("canonical_name").isin(list(some))).select(F.col("canonical_name").alias("p"), F.coalesce("name_display", F.lit("")).alias("x"))
    b = df.select(F.col("canonical_name").alias("q"), F.coalesce("name_display", F.lit("")).alias("y"))
    pairs = a.crossJoin(F.broadcast(b)).where("p <> q").withColumn("s", F.floor(token_set_ratio("x", "y")).cast("int")).where("s >= 92")
    for r in pairs.collect():
        want.add((min(r.p, r.q), max(r.p, r.q), r.s))
    assert want and {g for g in got if g[0] in some or g[1] in some} == want
