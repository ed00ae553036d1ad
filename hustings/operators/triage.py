"""Evidence queues of windows, names and clusters, from the signals of all detectors, in three lenses.

A window is a candidate where a burst or a swing is significant, or a minute's composite score is
high. What lies in it is read off running totals of the minute grid: counts, duplicates, records of
clusters of near-duplicate names that overlap it, and mean rarity. These give further signals. The
lenses count all rows (raw), or the first row of a name and minute (exact_row_dedup); measures of both
are taken in one pass and written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import core as f
from hustings.operators.duplicates import cluster_summary, top_repeated_names
from hustings.operators.fusion import high_priority_windows
from hustings.operators.profile import counts_per_minute, name_frequency
from hustings.operators.rare import name_rarity, weird_names
from hustings.operators.windows import burst_significant_windows, burst_window_tests, swing_significant_windows
from hustings.plans.catalog import Catalog
from hustings.plans.contracts import SIGNALS
from hustings.plans.overlap import overlapping
from hustings.plans.running import running_totals

#: How far signals of each kind count.
WEIGHTS = {"stat_fdr": 1.0, "calibrated_empirical": 0.9, "heuristic": 0.6}
#: Limits of tiers, least support, the share of hints below which an explanation is mixed, and rows of a queue.
HIGH, MEDIUM, SUPPORT, MAJORITY, QUEUE = 0.80, 0.60, 25, 0.60, 250
#: What counts as one: shares of duplicate and of near-duplicate names, a change of the pro rate.
DUPLICATES, NEAR, SWING = 0.40, 0.30, 0.35
MANIPULATION, ARTIFACT, MIXED = "potential_manipulation", "data_quality_artifact", "mixed"
LENSES = ("raw", "exact_row_dedup")
MEASURED = ("n_total", "n_pro", "n_unique_names", "n_total_dedup", "n_pro_dedup")

# signals -----------------------------------------------------------------------------------------


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def signal(present: Column, signal_id: Column, detector: str, kind: str, score: Column, support: Column, hint: str, effect: Column | None = None, tested: Column | None = None, low_power: Column | None = None) -> Column:
    """One signal as a struct, null where it is not present. effect, tested: whether there is an effect size, a p or q value."""
    fields = {
        "signal_id": signal_id,
        "detector": F.lit(detector),
        "kind": F.lit(kind),
        "weight": F.lit(WEIGHTS[kind]),
        "score": clamp(score),
        "support": support.cast("long"),
        "has_effect": F.lit(False) if effect is None else effect.isNotNull(),
        "is_tested": F.lit(False) if tested is None else tested.isNotNull(),
        "low": (support < SUPPORT) if low_power is None else low_power,
        "hint": F.lit(hint),
    }
    return F.when(F.coalesce(present, F.lit(False)), F.struct(*(v.alias(k) for k, v in fields.items())))


def tier(score: Column, support: Column, calibrated: Column, low_power: Column) -> Column:
    """high needs a calibrated signal and power; both tiers need support."""
    high = (score >= HIGH) & (support >= SUPPORT) & calibrated & ~low_power
    return F.when(high, "high").when((score >= MEDIUM) & (support >= SUPPORT), "medium").otherwise("watch")


def tier_rank(c: str = "evidence_tier") -> Column:
    return F.when(F.col(c) == "high", 0).when(F.col(c) == "medium", 1).otherwise(2)


def explained(signals: str) -> tuple[Column, Column]:
    """Primary and secondary explanation: hints by number, equal ones in order of appearance; a tie or less than the majority is mixed."""
    hints = F.filter(F.transform(signals, lambda s: s["hint"]), lambda h: h.isNotNull() & (h != "none"))
    votes = F.array_sort(F.transform(F.array_distinct(hints), lambda h: F.struct((-F.size(F.filter(hints, lambda x: x == h))).alias("less"), F.array_position(hints, h).alias("at"), h.alias("hint"))))
    first, second = F.get(votes, F.lit(0)), F.get(votes, F.lit(1))
    close = (first["less"] == second["less"]) | (-first["less"] / F.size(hints) < MAJORITY)
    primary = F.when(F.size(votes) == 0, "insufficient_evidence").when(F.size(votes) == 1, first["hint"]).when(close, MIXED).otherwise(first["hint"])
    return primary, F.coalesce(second["hint"], F.lit("none"))


def breakdown(signals: str, most: int = 5) -> tuple[Column, Column, Column]:
    """The leading detector, and shares of detectors and of signals as text; equal shares where no signal scores."""
    total = F.aggregate(signals, F.lit(0.0), lambda t, s: t + s["weight"] * s["score"])
    parts = F.transform(signals, lambda s: F.struct(s["detector"].alias("detector"), F.concat(s["signal_id"], F.lit(":"), s["kind"]).alias("name"), s["signal_id"].alias("signal_id"), F.when(total > 0, s["weight"] * s["score"] / total).otherwise(1.0 / F.size(signals)).alias("share")))

    def text(rows: Column, name: str) -> Column:
        return F.array_join(F.transform(F.slice(rows, 1, most), lambda r: F.format_string("%s (%.1f%%)", r[name], F.round(r["share"] * 100.0, 1))), "; ")

    by_detector = F.transform(F.array_distinct(F.transform(parts, lambda p: p["detector"])), lambda d: F.struct(d.alias("detector"), F.aggregate(F.filter(parts, lambda p: p["detector"] == d), F.lit(0.0), lambda t, p: t + p["share"]).alias("share")))
    order = lambda rows, name: F.transform(F.array_sort(F.transform(rows, lambda r: F.struct((-F.round(r["share"], 9)).alias("k"), r[name].alias("n"), r.alias("r")))), lambda x: x["r"])
    detectors, ranked = order(by_detector, "detector"), order(parts, "signal_id")
    return F.get(detectors, F.lit(0))["detector"], text(detectors, "detector"), text(ranked, "name")


def judged(rows: DataFrame, signals: list[Column], support: Column) -> DataFrame:
    """Rows with what their signals say together; `support` is what is known of them beside the signals."""
    rows = rows.withColumn("signals", F.array_compact(F.array(*signals))).where(F.size("signals") > 0)
    each = lambda name: F.transform("signals", lambda s: s[name])
    weights = F.aggregate("signals", F.lit(0.0), lambda t, s: t + s["weight"])
    rows = rows.withColumns(
        {
            "score": clamp(F.aggregate("signals", F.lit(0.0), lambda t, s: t + s["weight"] * s["score"]) / weights),
            "support_n": F.greatest(F.coalesce(support.cast("long"), F.lit(0)), F.array_max(each("support"))),
            "is_low_power": F.exists("signals", lambda s: s["low"]),
        }
    )
    calibrated = F.exists("signals", lambda s: s["kind"] != "heuristic")
    caveats = [
        ("heuristic_only", ~calibrated),
        ("low_power", F.col("is_low_power")),
        ("low_support_n", F.exists("signals", lambda s: s["support"] < SUPPORT)),
        ("missing_effect_size", F.exists("signals", lambda s: (s["kind"] != "heuristic") & ~s["has_effect"])),
        ("missing_significance", F.exists("signals", lambda s: (s["kind"] == "stat_fdr") & ~s["is_tested"])),
    ]
    primary, secondary = explained("signals")
    driver, by_detector, by_signal = breakdown("signals")
    return rows.withColumns(
        {
            "evidence_tier": tier(F.col("score"), F.col("support_n"), calibrated, F.col("is_low_power")),
            "primary_explanation": primary,
            "secondary_explanation": secondary,
            "caveat_flags": F.concat_ws(",", *(F.when(c, n) for n, c in caveats)),
            "evidence_kinds": F.array_join(F.array_sort(F.array_distinct(each("kind"))), ","),
            "source_detectors": F.array_join(F.array_sort(F.array_distinct(each("detector"))), ","),
            "score_primary_driver": driver,
            "score_detector_breakdown": by_detector,
            "score_signal_breakdown": by_signal,
        }
    ).drop("signals")


JUDGED = ["support_n", "evidence_tier", "primary_explanation", "secondary_explanation", "score", "is_low_power", "caveat_flags", "evidence_kinds", "source_detectors", "score_primary_driver", "score_detector_breakdown", "score_signal_breakdown"]


def queue(rows: DataFrame, *then: Column | str) -> DataFrame:
    """A report: the first `QUEUE` rows by tier and score."""
    return rows.orderBy(tier_rank(), F.desc(F.round("score", 9)), *then).limit(QUEUE)


# windows -----------------------------------------------------------------------------------------


def statistical_candidates(c: Catalog) -> DataFrame:
    """Windows with a significant burst or swing: one row for each (start, end), with what the detectors say of it."""
    burst = c.get(burst_significant_windows).select("start_minute", "end_minute", F.col("observed_count").alias("burst_n"), F.col("expected_count").alias("expected"), "rate_ratio", F.col("q_value").alias("burst_q"))
    swing = c.get(swing_significant_windows).select("start_minute", "end_minute", F.col("n_total").alias("swing_n"), F.col("z_score").alias("z"), "delta_pro_rate", "abs_delta_pro_rate", F.col("q_value").alias("swing_q"), F.col("is_low_power").alias("swing_low"))
    return met(burst.unionByName(swing, allowMissingColumns=True))


def all_candidates(c: Catalog) -> DataFrame:
    """These, and minutes whose composite score is high."""
    minutes = c.get(high_priority_windows).select(F.col("minute_bucket").alias("start_minute"), F.col("minute_bucket").alias("end_minute"), F.col("n_total").alias("composite_n"), "composite_score")
    return met(c.get(statistical_candidates).unionByName(minutes, allowMissingColumns=True))


def met(rows: DataFrame) -> DataFrame:
    """One row for each window: a detector has one row for it at most, so maxima are its values."""
    return rows.groupBy("start_minute", "end_minute").agg(*(F.max(x).alias(x) for x in rows.columns if x not in ("start_minute", "end_minute")))


def rarity_by_minute(c: Catalog) -> DataFrame:
    """Sum and number of rarity scores by minute. Scores have twelve digits as decimals, so sums do not depend on their order."""
    score = F.round("rarity_score", 12).cast("decimal(21,12)")
    return c.records.join(c.stored(name_rarity), ["first_canonical", "last"]).groupBy("minute_bucket").agg(F.sum(score).alias("rarity"), F.count(F.lit(1)).alias("n_rarity"))


def minute_measures(c: Catalog) -> DataFrame:
    """Running totals of all that windows are measured by, on the minute grid.

    A cluster overlaps a window if it is first seen by its end and not last seen before its start. So records of
    overlapping clusters are those of clusters begun by then, less those ended before: two totals in place of a join.
    """
    shared(c)
    clusters = c.stored(cluster_summary).select("first_seen", "last_seen", "n_records")
    up = F.when(f.floor_minute("first_seen") == F.col("first_seen"), F.col("first_seen")).otherwise(f.plus_minutes(f.floor_minute("first_seen"), 1))
    begun = clusters.groupBy(up.alias("minute_bucket")).agg(F.sum("n_records").alias("near_begun"))
    ended = clusters.groupBy(f.floor_minute("last_seen").alias("minute_bucket")).agg(F.sum("n_records").alias("near_ended"))
    grid = c.get(counts_per_minute).select("minute_bucket", *MEASURED)
    for extra in (c.stored(rarity_by_minute), begun, ended):
        grid = grid.join(extra, "minute_bucket", "left")
    return running_totals(grid, "minute_bucket", [x for x in grid.columns if x != "minute_bucket"])


def window_facts(c: Catalog) -> DataFrame:
    """One row: the 95th percentile of mean rarity by minute (1 where there is none above zero), and the number of clusters."""
    # divided as the means of windows are: a window of one such minute has a share of one, not one less the last bit
    rarity = c.get(rarity_by_minute).agg(F.percentile(F.col("rarity").cast("double") / F.col("n_rarity"), F.lit(0.95)).alias("p95"))
    clusters = c.stored(cluster_summary).agg(F.count(F.lit(1)).alias("n_clusters"))
    return rarity.join(F.broadcast(clusters)).select(F.when(F.col("p95") > 0, F.col("p95")).otherwise(1.0).alias("rarity_scale"), "n_clusters")


def measured(c: Catalog, candidates: DataFrame) -> DataFrame:
    """Candidates with counts, shares and means of what lies in them, for both lenses."""
    totals = c.stored(minute_measures)
    names = [x for x in totals.columns if x != "minute_bucket"]
    at = totals.select(F.col("minute_bucket").alias("end_minute"), *(F.col(x).alias(f"b_{x}") for x in names))
    before = totals.select(f.plus_minutes("minute_bucket", 1).alias("start_minute"), *(F.col(x).alias(f"a_{x}") for x in names))
    df = candidates.join(at, "end_minute").join(before, "start_minute", "left").join(F.broadcast(c.get(window_facts)))  # one row
    inside = {x: F.col(f"b_{x}") - F.coalesce(F.col(f"a_{x}"), F.lit(0)) for x in names}
    near = F.col("b_near_begun") - F.coalesce(F.col("a_near_ended"), F.lit(0))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    df = df.withColumns({f"in_{x}": inside[x] for x in (*MEASURED, "rarity", "n_rarity")} | {"near_records": near})
    df = df.withColumn("window_id", F.concat(F.lit("w_"), stamp("start_minute"), F.lit("_"), stamp("end_minute")))
    df = df.withColumn("name_weirdness_mean", F.when(F.col("in_n_rarity") > 0, F.col("in_rarity").cast("double") / F.col("in_n_rarity")))
    for lens in LENSES:
        n, pro = ("in_n_total", "in_n_pro") if lens == "raw" else ("in_n_total_dedup", "in_n_pro_dedup")
        dup = 1.0 - F.coalesce(f.ratio("in_n_unique_names", "in_n_total"), F.lit(1.0)) if lens == "raw" else F.lit(0.0)  # weighted by rows; windows without rows have the plain mean, zero
        df = df.withColumns({f"count_{lens}": F.col(n), f"pro_rate_{lens}": f.ratio(pro, n), f"dup_fraction_{lens}": dup, f"near_dup_fraction_{lens}": F.when(F.col("n_clusters") > 0, clamp(f.ratio("near_records", n)))})
    kept = [x for x in df.columns if not x.startswith(("a_", "b_", "in_"))]
    return df.select(kept)


def shared(c: Catalog) -> None:
    """Write what several detectors and all that follows from them read: the records, and the minute grid."""
    c.keep_records()
    c.stored(counts_per_minute)


def measured_statistical(c: Catalog) -> DataFrame:
    shared(c)
    return measured(c, c.get(statistical_candidates))


def measured_all(c: Catalog) -> DataFrame:
    shared(c)
    return measured(c, c.get(all_candidates))


def window_measures(c: Catalog) -> DataFrame:
    """Every window with a significant burst or swing, and what lies in it: raw and deduplicated."""
    shares = [f"{x}_{lens}" for lens in LENSES for x in ("count", "pro_rate", "dup_fraction", "near_dup_fraction")]
    return c.stored(measured_statistical).select("window_id", "start_minute", "end_minute", *shares, "name_weirdness_mean", "near_records")


def window_queue(rows: DataFrame, lens: str) -> DataFrame:
    """The queue of one lens from measured candidates."""
    for x in ("count", "pro_rate", "dup_fraction", "near_dup_fraction"):
        rows = rows.withColumn(x, F.col(f"{x}_{lens}"))
    for x in ("composite_n", "composite_score"):
        if x not in rows.columns:
            rows = rows.withColumn(x, F.lit(None).cast("double"))
    col, wid = F.col, F.col("window_id")
    two = lambda q, effect: (clamp(1.0 - clamp(q)) + clamp(effect)) / 2.0
    heuristic = lambda name, detector, scale, hint: signal(col(name) > 0, F.lit(name), detector, "heuristic", col(name) / scale, col("count"), hint, col(name))
    signals = [
        signal(col("burst_n").isNotNull(), F.concat(F.lit("burst:"), wid), "bursts", "stat_fdr", two(col("burst_q"), (col("rate_ratio") - 1.0) / 3.0), col("burst_n"), MANIPULATION, col("rate_ratio"), col("burst_q")),
        signal(col("swing_n").isNotNull(), F.concat(F.lit("swing:"), wid), "procon_swings", "stat_fdr", two(col("swing_q"), col("abs_delta_pro_rate") / SWING), col("swing_n"), MANIPULATION, col("delta_pro_rate"), col("swing_q"), col("swing_low")),
        signal(col("composite_score").isNotNull(), F.concat(F.lit("composite:"), wid), "composite_score", "heuristic", col("composite_score"), col("composite_n"), MIXED),
        heuristic("dup_fraction", "duplicates_exact", F.lit(DUPLICATES), ARTIFACT),
        heuristic("near_dup_fraction", "duplicates_near", F.lit(NEAR), MANIPULATION),
        heuristic("name_weirdness_mean", "rare_names", col("rarity_scale"), MANIPULATION),
    ]
    rows = judged(rows.withColumn("q_value", F.least("burst_q", "swing_q")), signals, col("count"))
    first = ["window_id", "start_minute", "end_minute", "count", "expected", "z", "q_value", "pro_rate", "delta_pro_rate", "dup_fraction", "near_dup_fraction", "name_weirdness_mean"]
    return queue(rows, F.desc("support_n"), "start_minute", "end_minute").select(*first, *JUDGED)


def window_evidence_queue(c: Catalog) -> DataFrame:
    """A report: windows of all seven detectors, all rows counted."""
    return window_queue(c.stored(measured_all), "raw")


def statistical_queue_raw(c: Catalog) -> DataFrame:
    """A report: as above from bursts and swings, without the composite score."""
    return window_queue(c.stored(measured_statistical), "raw")


def statistical_queue_dedup(c: Catalog) -> DataFrame:
    return window_queue(c.stored(measured_statistical), "exact_row_dedup")


def with_delta(df: DataFrame, name: str, raw: str, dedup: str) -> DataFrame:
    delta = F.col(dedup) - F.col(raw)
    return df.withColumns({f"{name}_delta": delta, f"{name}_relative_delta": F.when(F.col(raw) != 0, delta / F.col(raw))})


def lenses_side_by_side(c: Catalog) -> DataFrame:
    """Both queues on window_id: a window of one queue alone stays, with nulls in the other's columns."""
    same = ["count", "pro_rate", "dup_fraction", "score", "evidence_tier"]
    raw = c.get(statistical_queue_raw).select("window_id", *(F.col(x).alias(f"{x}_raw") for x in same))
    dedup = c.get(statistical_queue_dedup).select("window_id", *(F.col(x).alias(f"{x}_exact_row_dedup") for x in same))
    df = raw.join(dedup, "window_id", "full")
    df = with_delta(df, "count", "count_raw", "count_exact_row_dedup")
    for x in ("pro_rate", "dup_fraction"):
        df = df.withColumn(f"{x}_delta", F.col(f"{x}_exact_row_dedup") - F.col(f"{x}_raw"))
    return df.withColumns({"in_raw": F.col("score_raw").isNotNull(), "in_exact_row_dedup": F.col("score_exact_row_dedup").isNotNull()})


def lens_summary(c: Catalog) -> DataFrame:
    """Totals and rates of both lenses in one row, with their differences."""
    one = c.get(counts_per_minute).agg(*(F.sum(x).alias(x) for x in ("n_total", "n_pro", "n_con", "n_total_dedup", "n_pro_dedup", "n_con_dedup")))
    df = one.select(F.col("n_total").alias("total_submissions_raw"), F.col("n_total_dedup").alias("total_submissions_exact_row_dedup"), *(f.ratio(f"n_{x}{tail}", f"n_total{tail}").alias(f"overall_{x}_rate_{lens}") for x in ("pro", "con") for lens, tail in zip(LENSES, ("", "_dedup"))))
    df = with_delta(df, "total_submissions", "total_submissions_raw", "total_submissions_exact_row_dedup")
    return df.withColumns({f"overall_{x}_rate_delta": F.col(f"overall_{x}_rate_exact_row_dedup") - F.col(f"overall_{x}_rate_raw") for x in ("pro", "con")})


def window_cluster_overlaps(c: Catalog) -> DataFrame:
    """Which clusters of near-duplicate names were active in which candidate windows."""
    windows = c.stored(measured_statistical).select("window_id", "start_minute", "end_minute")
    clusters = c.stored(cluster_summary).select("cluster_id", "cluster_size", "n_records", "first_seen", "last_seen")
    return overlapping(windows, clusters, ("start_minute", "end_minute"), ("first_seen", "last_seen")).select("window_id", "cluster_id", "cluster_size", "n_records")


def queue_of_lens(c: Catalog, lens: str | None = None) -> DataFrame:
    """The queue of a lens by name."""
    return c.get({"raw": statistical_queue_raw, "exact_row_dedup": statistical_queue_dedup, "side_by_side": lenses_side_by_side}[f.lens_of(lens)])


def raw_burst_signals(c: Catalog) -> DataFrame:
    """Every tested burst window as a signal before anything is clamped: what the evidence contract is there to catch."""
    kind = F.when(F.col("is_low_power"), "rate_ratio").otherwise("stat_fdr")
    start = F.date_format("start_minute", "yyyyMMdd'T'HHmm")
    return c.get(burst_window_tests).select(
        F.concat_ws(":", F.lit("burst"), "window_minutes", start).alias("signal_id"),
        kind.alias("evidence_kind"),
        ((F.col("rate_ratio") - 1.0) / 3.0).alias("signal_score"),
        F.col("observed_count").cast("long").alias("support_n"),
        F.col("delta_pro_rate").alias("effect_size"),
        "p_value",
        "q_value",
        F.when(F.hour("start_minute") == 18, "surge").otherwise(MANIPULATION).alias("explanation_hint"),
    )


def contract_violations(c: Catalog) -> DataFrame:
    """How many of these break which rule of the evidence contract, and the first that does."""
    found = SIGNALS.violations(c.get(raw_burst_signals), "signal_id")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n_violations"), F.min("signal_id").alias("first_signal_id"))


# names and clusters ------------------------------------------------------------------------------


def record_evidence_queue(c: Catalog) -> DataFrame:
    """A report: names that repeat most and names that look most unusual (both as their own reports list them)."""
    c.keep_records()
    repeated = c.get(top_repeated_names).where("trim(canonical_name) <> ''").select("canonical_name", F.col("display_name").alias("shown"), F.col("n").alias("repeats"), "n_pro", "n_con", "time_span_minutes")
    weird = c.get(weird_names).where("trim(canonical_name) <> ''").select("canonical_name", "sample_name", "weirdness_score")
    top = repeated.agg(F.max("repeats").alias("most"))
    scale = c.get(weird_names).agg(F.percentile("weirdness_score", F.lit(0.95)).alias("p95"))
    df = repeated.join(weird, "canonical_name", "full").join(F.broadcast(top)).join(F.broadcast(scale))  # one row each
    df = df.withColumns(
        {
            "record_id": F.col("canonical_name"),
            "n_records": F.coalesce("repeats", F.lit(1)),
            "n_pro": F.coalesce("n_pro", F.lit(0)),
            "n_con": F.coalesce("n_con", F.lit(0)),
            "display_name": F.coalesce(F.nullif(F.trim("shown"), F.lit("")), F.nullif(F.trim("sample_name"), F.lit("")), F.col("canonical_name")),
        }
    )
    name = F.col("canonical_name")
    signals = [
        signal(F.col("repeats").isNotNull(), F.concat(F.lit("repeat:"), name), "duplicates_exact", "heuristic", F.col("repeats") / F.col("most"), F.col("repeats"), ARTIFACT, F.col("repeats")),
        signal(F.col("weirdness_score").isNotNull(), F.concat(F.lit("weirdness:"), name), "rare_names", "heuristic", F.col("weirdness_score") / F.when(F.col("p95") > 0, F.col("p95")).otherwise(1.0), F.col("n_records"), MANIPULATION, F.col("weirdness_score")),
    ]
    rows = judged(df, signals, F.col("n_records"))
    return queue(rows, F.desc("n_records"), "canonical_name").select("record_id", "canonical_name", "display_name", "n_records", "n_pro", "n_con", "time_span_minutes", "weirdness_score", *JUDGED)


def cluster_evidence_queue(c: Catalog) -> DataFrame:
    """A report: clusters of near-duplicate names by size, records and compactness in time."""
    df = c.stored(cluster_summary)
    top = df.agg(F.max("cluster_size").alias("most"), F.max("n_records").alias("most_records"))
    df = df.join(F.broadcast(top))  # one row
    score = F.col("cluster_size") / F.col("most") * 0.45 + F.col("n_records") / F.col("most_records") * 0.35 + clamp(1.0 - F.least(F.coalesce("time_span_minutes", F.lit(0.0)) / 1440.0, F.lit(1.0))) * 0.20
    one = signal(F.lit(True), F.concat(F.lit("cluster:"), F.col("cluster_id")), "duplicates_near", "heuristic", score, F.col("n_records"), MANIPULATION, F.col("cluster_size"))
    rows = judged(df.drop("score"), [one], F.col("n_records"))
    return queue(rows, F.desc("n_records"), "cluster_id").select("cluster_id", "cluster_size", "n_records", "n_pro", "n_con", "first_seen", "last_seen", "time_span_minutes", *JUDGED)


def score_breakdown(c: Catalog) -> DataFrame:
    """For each window of the queue what its score is made of."""
    return c.get(statistical_queue_raw).select("window_id", "score", "score_primary_driver", "score_detector_breakdown", "score_signal_breakdown")


# summary -----------------------------------------------------------------------------------------


def triage_summary(c: Catalog) -> DataFrame:
    """One row: totals, range, rates, off-hours share, the five strongest of each kind, and how many rows each queue and tier holds."""
    shared(c)
    c.stored(name_frequency)
    c.stored(weird_names)
    r = c.records.agg(F.count(F.lit(1)).alias("total_submissions"), F.min("minute_bucket").alias("date_range_start"), F.max("minute_bucket").alias("date_range_end"), *f.stance_counts()[:2], f.count_where(F.col("is_off_hours")).alias("off_hours"))
    r = r.withColumns({"overall_pro_rate": f.ratio("n_pro", "total_submissions"), "overall_con_rate": f.ratio("n_con", "total_submissions"), "on_hours": F.col("total_submissions") - F.col("off_hours"), "off_hours_ratio": f.ratio("off_hours", "total_submissions")}).drop("n_pro", "n_con")
    w = c.stored(statistical_queue_raw).agg(F.count(F.lit(1)).alias("n_window_queue"), *(f.count_where(F.col("evidence_tier") == t).alias(f"n_windows_{t}") for t in ("high", "medium", "watch")))
    parts = [w, c.get(record_evidence_queue).agg(F.count(F.lit(1)).alias("n_record_queue")), c.get(cluster_evidence_queue).agg(F.count(F.lit(1)).alias("n_cluster_queue"))]
    windows = c.stored(measured_statistical)
    span = F.concat_ws("/", F.date_format("start_minute", "yyyy-MM-dd'T'HH:mm"), F.date_format("end_minute", "yyyy-MM-dd'T'HH:mm"))
    tops = {
        "top_burst_windows": (windows.where("burst_n is not null"), [F.round("burst_q", 9), F.desc(F.round("rate_ratio", 9)), F.desc("burst_n")], span),
        "top_swing_windows": (windows.where("swing_n is not null"), [F.round("swing_q", 9), F.desc(F.round("abs_delta_pro_rate", 9)), F.desc("swing_n")], span),
        "top_repeated_names": (c.get(top_repeated_names), [F.desc("n")], F.col("canonical_name")),
        "top_near_dup_clusters": (c.stored(cluster_summary), [], F.col("cluster_id")),
    }
    parts += [leading(rows, order, text, name) for name, (rows, order, text) in tops.items()]
    for part in parts:
        r = r.join(F.broadcast(part))  # one row each
    return r.withColumn("lens", F.lit(LENSES[0]))


def leading(rows: DataFrame, order: list[Column], text: Column, name: str, n: int = 5) -> DataFrame:
    """One row: the texts of the first n rows in their order."""
    some = rows.withColumn("t", text).orderBy(*order, "t").limit(n)
    some = some.withColumn("k", F.row_number().over(Window.orderBy(*order, "t")))  # n rows
    return some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "; ").alias(name))
