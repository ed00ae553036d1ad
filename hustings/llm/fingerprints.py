"""Document fingerprints by winnowing, in DataFrame functions alone.

Every position of a text gets a hash of the `k` bytes that start there; in every window of
`window` hashes in a row the smallest is chosen, the rightmost of equal ones, and its position is
kept. Texts that share `k + window - 1` bytes in a row share at least one choice.

Hashes roll by doubling: each half of a gram, a digit, is hashed once, at the position where it
starts, and a gram's hash is the polynomial (left * BASE + right) mod PRIME of two digits that other
grams use too. Hash and position stand in one long, hash above and the position counted downwards
below, so that one minimum picks the rightmost of ties. Window minima come by doubling as well:
minima over 4, 16 ... positions, so each position costs a handful of comparisons whatever the width.
A text is cut into spans of `SPAN` windows, which overlap in the bytes that windows share: arrays
with an element for each byte never hold more than a span, and a long text costs no more memory
than its bytes and its choices.

The next document in doc_id order comes with one shuffle of the texts: quantiles of doc_id cut
the table into many small ranges, an id with many rows is cut by hashes of its texts, the first row
of a range also goes to the range before it, and a window within each range sees the next row.

Defined cases: a null text is empty; a text shorter than a gram has one gram, the whole of it,
and an empty one has none and an empty fingerprint; a text with fewer grams than a window is one
window; two empty fingerprints are alike (1.0), an empty and another one are not (0.0); rows of
one doc_id follow each other in order of a hash of their text and each is the next document of the
one before; a null doc_id comes first; a single row is its own next document; texts of any length
are fingerprinted whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import prepare

GRAM, WINDOW = 16, 32
#: Modulus and base of the polynomial over a gram's two digits.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
#: Windows of one span of a text.
SPAN = 4096
#: Rows of a doc_id range, and ranges at most: so many cuts reach the driver.
RANGE_ROWS, MOST_RANGES = 64, 1 << 16
_LOW = (1 << 31) - 1
_NONE = "array<long>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _strided(values: Column, strides: list[int]) -> Column:
    """For each position the least of the values at these strides from it, as far as all of them exist."""
    places = F.sequence(F.lit(0), F.size(values) - 1 - strides[-1])
    return F.transform(places, lambda i: F.least(*(values[i + s] for s in strides)))


def _minima(values: Column, window: int, width: int = 1) -> Column:
    """The least of every `window` values in a row; `values` holds those of `width` already."""
    if width == window:
        return values
    reach = min(window, 4 * width)
    strides = sorted({min(j * width, reach - width) for j in range(-(-reach // width))})
    return bound(_strided(values, strides), lambda v: _minima(v, window, reach))


def _packed(hash_: Column, position: Column) -> Column:
    return F.shiftleft(hash_, 31) + (F.lit(_LOW) - position).cast("long")


def _span_choices(data: Column, start: Column, k: int, window: int) -> Column:
    """Choices of all windows of the bytes, which are enough for one; `start` is where they begin in the text."""
    half = k // 2
    n = F.octet_length(data)
    digits = F.transform(F.sequence(F.lit(0), n - half), lambda i: F.xxhash64(F.substring(data, i + 1, F.lit(half))).bitwiseAND(_LOW))
    grams = lambda d: F.transform(F.sequence(F.lit(0), n - k), lambda i: _packed((d[i] * F.lit(BASE).cast("long") + d[i + half]) % PRIME, start + i))
    return F.array_distinct(bound(digits, lambda d: bound(grams(d), lambda g: _minima(g, window))))


def choices(raw: Column, offset: Column, k: int, window: int) -> Column:
    """Packed choices of the windows of bytes that start at `offset` of their text; of all grams together where they fill no window."""
    half, shared = k // 2, k + window - 2

    def whole(data: Column) -> Column:
        windows = F.octet_length(data) - shared
        spans = F.sequence(F.lit(0), F.floor((windows - 1) / SPAN).cast("int"))
        one = lambda c: bound(F.substring(data, c * SPAN + 1, F.lit(SPAN + shared)), lambda d: _span_choices(d, offset + c * SPAN, k, window))
        return F.array_distinct(F.flatten(F.transform(spans, one)))

    def few(data: Column) -> Column:
        digit = lambda i: F.xxhash64(F.substring(data, i + 1, F.lit(half))).bitwiseAND(_LOW)
        grams = F.transform(F.sequence(F.lit(0), F.octet_length(data) - k), lambda i: _packed((digit(i) * F.lit(BASE).cast("long") + digit(i + half)) % PRIME, offset + i))
        return F.array(F.array_min(grams))

    def any_length(data: Column) -> Column:
        n = F.octet_length(data)
        single = F.array(_packed(F.xxhash64(data).bitwiseAND(_LOW) % PRIME, offset))
        return F.when(n > shared, whole(data)).when(n >= k, few(data)).when(n > 0, single).otherwise(F.array().cast(_NONE))

    return bound(raw, any_length)


def chosen(distinct: Column) -> Column:
    """Packed choices as array of struct (hash: long, position: int, in bytes)."""
    return F.transform(distinct, lambda v: F.struct(F.shiftright(v, 31).alias("hash"), (F.lit(_LOW) - v.bitwiseAND(_LOW)).cast("int").alias("position")))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add `out`: distinct choices of all windows."""
    return df.withColumn(out, chosen(choices(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), F.lit(0), k, window)))


def likeness(a: str, b: str) -> Column:
    """Share of the distinct hashes of two fingerprints (packed) that both have."""
    x, y = (F.array_distinct(F.transform(c, lambda v: F.shiftright(v, 31))) for c in (a, b))
    shared = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - shared
    return F.when(total > 0, shared.cast("double") / total).otherwise(F.lit(1.0))


def _numbers(values: list[int]) -> Column:
    """An array literal, folded once, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, place) dealt out by ranges, with `bucket` and `guard` (the copy of the first row of the range after).

    A range is a stretch of doc_id and, where one id fills several stretches, of the hashes of its texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "place": F.xxhash64("text")})
    seen = rows.agg(F.count("*").alias("n"), F.min("key").alias("low")).first()
    parts = max(1, min(MOST_RANGES, seen["n"] // RANGE_ROWS))
    found = [seen["low"] if seen["low"] is not None else 0]
    if parts > 1:
        found += rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], min(10 * parts, 1 << 18)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found))
    times = {c: 0 for c in cuts}
    for c in found:
        times[c] += 1
    fine, coarse, share = _numbers(cuts), _numbers(cuts[::256]), _numbers([times[c] for c in cuts])
    rows = rows.withColumn("block", F.size(F.filter(coarse, lambda c: c <= F.col("key"))) - 1)
    near = F.slice(fine, F.col("block") * 256 + 1, F.lit(256))
    rows = rows.withColumn("stretch", F.col("block") * 256 + F.size(F.filter(near, lambda c: c <= F.col("key"))))
    # an id that is `share` cuts at once has its rows dealt over so many parts, and what follows it in its stretch over one more
    deal = F.element_at(share, F.col("stretch"))
    at = F.floor((F.shiftright("place", 33) + (1 << 30)) * deal / (1 << 31)).cast("long")
    part = F.when(F.col("key") != F.element_at(fine, F.col("stretch")), deal).when(deal > 1, F.least(F.greatest(at, F.lit(0)), deal - 1)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", F.when(deal > 1, part).otherwise(F.lit(0).cast("long"))).drop("block")
    order = F.struct("key", "place")
    firsts = rows.groupBy("stretch", "part").agg(F.min(order).alias("first"))  # at most twice as many rows as there are cuts
    line = Window.orderBy("stretch", "part")
    firsts = firsts.select("stretch", "part", "first", F.row_number().over(line).cast("long").alias("bucket"))
    last = firsts.agg(F.max("bucket").alias("buckets"))
    marked = rows.join(F.broadcast(firsts.crossJoin(F.broadcast(last))), ["stretch", "part"])
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard"))
    copy = F.struct(F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.col("buckets")).alias("bucket"), F.lit(True).alias("guard"))
    dealt = F.explode(F.when(order == F.col("first"), F.array(own, copy)).otherwise(F.array(own)))
    return marked.select("doc_id", "text", "key", "place", dealt.alias("to")).select("doc_id", "text", "key", "place", "to.bucket", "to.guard")


def fingerprint_edits(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text ends in the first floor(n_chars / 4) code points (or all) of the next document.
    """
    spark = prepare(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs).repartition(n, "bucket").withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    kept = F.left("text", F.col("n_chars").cast("int") - quarter)
    rows = rows.withColumn("kept_bytes", F.octet_length(kept))
    # windows that lie within the kept part choose the same in the edited text: only what follows is hashed again
    rows = rows.withColumn("done", F.greatest(F.col("kept_bytes") - (k + window - 2), F.lit(0)))
    raw = F.encode("text", "UTF-8")
    head = F.when(F.col("done") > 0, choices(F.substring(raw, F.lit(1), F.col("kept_bytes")), F.lit(0), k, window)).otherwise(F.array().cast(_NONE))
    rows = rows.withColumns({"head": head, "rest": choices(F.substring(raw, F.col("done") + 1, F.octet_length("text")), F.col("done"), k, window)})
    rows = rows.withColumn("own", F.array_distinct(F.concat("head", "rest"))).drop("rest")
    order = Window.partitionBy("bucket").orderBy("guard", "key", "place")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_own": F.lead("own").over(order)})
    rows = rows.where(~F.col("guard"))
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next_text", quarter)))
    tail = F.substring(F.encode("edited", "UTF-8"), F.col("done") + 1, F.octet_length("edited"))
    nothing_new = (F.col("done") > 0) & (F.octet_length("edited") == F.col("kept_bytes"))
    rows = rows.withColumn("edited_own", F.when(nothing_new, F.col("head")).otherwise(F.array_distinct(F.concat("head", choices(tail, F.col("done"), k, window)))))
    rows = rows.withColumns({"near_edited": likeness("own", "edited_own"), "near_next": likeness("own", "next_own"), "fingerprint": chosen(F.col("own")), "edited_fingerprint": chosen(F.col("edited_own"))})
    return rows.select("doc_id", "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def written(fingerprint: str) -> Column:
    """A fingerprint as text: hash:position of each choice in order of the text, comma-joined."""
    return F.array_join(F.transform(F.col(fingerprint), lambda p: F.concat_ws(":", p["hash"], p["position"])), ",")
