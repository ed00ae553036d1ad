"""Pairs of similar names without comparing all pairs.

The token-set ratio of two names is the best of three shares of common letters: of both names with
their common words first, and of the common words with either name. For the first, letters of a name
are the same whatever stands first, so at a threshold T the names differ in D = (1 - T) * (lengths
together) letters at most, order aside. Letters are dealt to D + 2 groups: at most D of these differ,
so two hold the same letters in both names. Names meet by equality of two groups, once, at the first
two that are equal. For the others, the common words make up most of one name: some of that name's
rarest words, too long to be left out together, is among them, and the names meet by that word.
What meets is scored; nothing that reaches the threshold is lost (tests hold this against all pairs).

Keys are groups of letters or rare words within a block, so a large block is spread over as many
tasks as it has such keys. A name has far more keys than its size lets Spark expect: joins say that
they sort, so that no side is sent whole to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.kernels import token_set_ratio

#: Slack of comparisons in doubles.
SLACK = 1e-9


def _words(display: str) -> Column:
    return F.array_distinct(F.filter(F.split(display, " "), lambda w: w != ""))


def _differing(total: Column, apart: float) -> Column:
    """Letters that names of this total length may differ in."""
    return F.floor(total * apart + SLACK).cast("int")


def _groups(letters: str, d: str) -> Column:
    """The sorted letters in d + 2 groups."""
    return F.transform(F.sequence(F.lit(0), F.col(d) + 1), lambda g: F.array_join(F.filter(letters, lambda x: F.pmod(F.xxhash64(x), F.col(d) + 2) == g), ""))


def _common(a: Column, b: Column) -> Column:
    """Letters that two texts have in common, order aside."""
    count = lambda text, x: F.length(text) - F.length(F.replace(text, x, F.lit("")))
    return F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda x: x != "")), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def near_by_letters(names: DataFrame, apart: float) -> DataFrame:
    """block_key, left_name, right_name, x, y of names whose letters differ in no more than their length allows."""
    df = names.withColumn("text", F.array_join(_words("name_display"), " ")).where("text <> ''")
    df = df.withColumns({"m": F.length("text"), "letters": F.array_sort(F.filter(F.split("text", ""), lambda x: x != ""))})
    low, high = _differing(F.col("m") * (2.0 / (1.0 + apart)) - 2 * SLACK / apart, apart), _differing(F.col("m") * (2.0 / (1.0 - apart)), apart)
    df = df.withColumn("d", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn("groups", _groups("letters", "d"))
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.transform(F.sequence(i + 1, F.col("d") + 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    df = df.withColumn("at", F.explode(two)).select("block_key", "canonical_name", "name_display", "text", "m", "d", "groups", "at.i", "at.j")
    df = df.withColumn("key", F.xxhash64(F.get("groups", F.col("i")), F.get("groups", F.col("j"))))
    a, b = df.alias("a"), df.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("block_key", "d", "i", "j", "key")]
    met = a.join(b.hint("merge"), [*same, F.col("a.canonical_name") < F.col("b.canonical_name"), _differing(F.col("a.m") + F.col("b.m"), apart) == F.col("a.d")])
    equal = F.filter(F.sequence(F.lit(0), F.col("a.d") + 1), lambda g: F.get("a.groups", g) == F.get("b.groups", g))
    first = (F.get(equal, F.lit(0)) == F.col("a.i")) & (F.get(equal, F.lit(1)) == F.col("a.j"))
    differ = F.col("a.m") + F.col("b.m") - 2 * _common(F.col("a.text"), F.col("b.text"))
    return _pair(met.where(first).where(differ <= F.col("a.d")))


def near_by_words(names: DataFrame, apart: float) -> DataFrame:
    """The same for names of which one may be made up of common words but for the share that the threshold allows."""
    df = names.withColumn("words", _words("name_display")).withColumn("m", F.length(F.array_join("words", " "))).select("block_key", "canonical_name", "name_display", "m", F.explode("words").alias("word"))
    often = df.groupBy("block_key", "word").agg(F.count(F.lit(1)).alias("often"))
    df = df.join(often.hint("merge"), ["block_key", "word"])
    before = Window.partitionBy("block_key", "canonical_name", "name_display").orderBy("often", "word").rowsBetween(Window.unboundedPreceding, -1)  # words of one name
    spare = F.col("m") * (2.0 * apart / (1.0 + apart))  # letters that the common words may leave out: b >= m * T / (2 - T)
    left_out = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    probes = df.withColumn("left_out", left_out).where(F.col("left_out") <= spare + SLACK).drop("left_out")
    a, b = probes.alias("a"), df.alias("b")
    met = a.join(b.hint("merge"), [F.col("a.block_key") == F.col("b.block_key"), F.col("a.word") == F.col("b.word"), F.col("a.canonical_name") != F.col("b.canonical_name")])
    turned = F.col("a.canonical_name") > F.col("b.canonical_name")
    side = lambda c, swap: F.when(turned, F.col(f"{'a' if swap else 'b'}.{c}")).otherwise(F.col(f"{'b' if swap else 'a'}.{c}"))
    return met.select(F.col("a.block_key").alias("block_key"), side("canonical_name", False).alias("left_name"), side("canonical_name", True).alias("right_name"), side("name_display", False).alias("x"), side("name_display", True).alias("y")).distinct()


def _pair(met: DataFrame) -> DataFrame:
    return met.select(F.col("a.block_key").alias("block_key"), F.col("a.canonical_name").alias("left_name"), F.col("b.canonical_name").alias("right_name"), F.col("a.name_display").alias("x"), F.col("b.name_display").alias("y"))


def similar_pairs(names: DataFrame, threshold: int) -> DataFrame:
    """block_key, left_name < right_name, similarity of all pairs within a block whose token-set ratio, cut to an integer, reaches the threshold (1 to 99).

    names: block_key, canonical_name (once), name_display. A null or blank display name is like nothing.
    """
    if not 0 < threshold < 100:
        raise ValueError("the threshold must lie between 0 and 100")
    apart = 1.0 - threshold / 100.0
    names = names.select("block_key", "canonical_name", F.coalesce("name_display", F.lit("")).alias("name_display"))

    def scored(pairs: DataFrame) -> DataFrame:
        s = pairs.withColumn("similarity", F.floor(token_set_ratio("x", "y")).cast("int"))
        return s.where(F.col("similarity") >= threshold).drop("x", "y")

    return scored(near_by_letters(names, apart)).union(scored(near_by_words(names, apart))).distinct()
