"""DuckDB SQL for the evidence queues and what they are made of, over records with surges."""

from __future__ import annotations

from hustings.oracles import _BD, _BU, _SD, _SW, BASE, GRID, MEMBERS, NAMES, ORACLES as PLAIN, RARITY, RECORDS, ROLL, TEXT, ratio, recursive, rounded

SURGE_RECORDS = RECORDS.replace(
    "raw AS (",
    "events_ AS (SELECT event_id AS id, ts, event_type, user_id, props FROM events), raw AS (\n  SELECT id, CASE WHEN hit THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 18 HOUR + to_minutes(CAST((id // 12) % 20 AS BIGINT)) + to_seconds(id % 60) ELSE ts END AS ts, CASE WHEN hit THEN 'signup' ELSE event_type END AS event_type,"
    " w1 || CASE WHEN hit AND (id // 12) % 2 = 0 THEN substr('abcdefghij', CAST((id // 24) % 10 + 1 AS BIGINT), 1) ELSE '' END AS w1, w2, k FROM (SELECT *, id % 12 = 5 AND day(ts) % 6 = 1 AS hit FROM (",
    1,
).replace("FROM events e JOIN part p ON p.p_partkey = e.user_id)", "FROM events e JOIN part p ON p.p_partkey = e.user_id)))", 1).replace("events_ AS (SELECT event_id AS id, ts, event_type, user_id, props FROM events), ", "", 1)


def surging(sql: str) -> str:
    if RECORDS not in sql:
        raise ValueError("no records in the SQL")
    return sql.replace(RECORDS, SURGE_RECORDS)


def after(sql: str, head: str) -> str:
    """What a chain of CTEs adds to another."""
    if not sql.startswith(head):
        raise ValueError("not a continuation")
    return sql[len(head) :]


ORACLES: dict[str, str] = {f"{name}_surge": surging(PLAIN[name]) for name in ("bu2_burst_significant_windows", "ps2_swing_significant_windows", "rn1_singleton_names")}

SUMMARY = """summary AS (SELECT cluster_id, count(*) AS cluster_size, CAST(sum(n_records) AS BIGINT) AS n_records, CAST(sum(n_pro) AS BIGINT) AS n_pro, CAST(sum(n_con) AS BIGINT) AS n_con, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  date_diff('microsecond', min(first_seen), max(last_seen)) / 60000000.0::DOUBLE AS time_span_minutes FROM members GROUP BY 1)"""
UNIT = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"
MEASURES = f"""{MEMBERS}, {SUMMARY}, {GRID}{after(_BU, BASE)}{after(_SW, ROLL)}{after(RARITY, RECORDS)},
marked AS (
  SELECT start_minute, end_minute, max(observed_count) AS burst_n, max(expected_count) AS expected, max(rate_ratio) AS rate_ratio, max(burst_q) AS burst_q, max(swing_n) AS swing_n, max(z_score) AS z, max(delta_pro_rate) AS delta_pro_rate, max(abs_delta) AS abs_delta, max(swing_q) AS swing_q, bool_or(swing_low) AS swing_low
  FROM (SELECT start_minute, end_minute, observed_count, expected_count, rate_ratio, q_value AS burst_q, NULL::BIGINT AS swing_n, NULL::DOUBLE AS z_score, NULL::DOUBLE AS delta_pro_rate, NULL::DOUBLE AS abs_delta, NULL::DOUBLE AS swing_q, NULL::BOOLEAN AS swing_low FROM bt WHERE q_value <= 0.01::DOUBLE
        UNION ALL SELECT start_minute, end_minute, NULL, NULL, NULL, NULL, n_total, z_score, delta_pro_rate, abs_delta_pro_rate, q_value, is_low_power FROM st WHERE q_value <= 0.01::DOUBLE) GROUP BY 1, 2),
candidates AS MATERIALIZED (SELECT *, 'w_' || strftime(start_minute, '%Y%m%dT%H%M%S') || '_' || strftime(end_minute, '%Y%m%dT%H%M%S') AS window_id FROM marked),
inside AS (SELECT window_id, CAST(sum(n_total) AS BIGINT) AS n, CAST(sum(n_pro) AS BIGINT) AS np, CAST(sum(n_unique_names) AS BIGINT) AS nu, CAST(sum(n_total_dedup) AS BIGINT) AS nd, CAST(sum(n_pro_dedup) AS BIGINT) AS npd FROM candidates JOIN grid ON minute_bucket BETWEEN start_minute AND end_minute GROUP BY 1),
overlaps_ AS (SELECT window_id, cluster_id, cluster_size, n_records FROM candidates JOIN summary ON first_seen <= end_minute AND last_seen >= start_minute),
close_ AS (SELECT window_id, CAST(sum(n_records) AS BIGINT) AS near_records FROM overlaps_ GROUP BY 1),
rare_minutes AS (SELECT date_trunc('minute', t) AS minute_bucket, CAST(CAST(sum(CAST(round(rarity_score, 12) AS DECIMAL(21, 12))) AS DECIMAL(31, 12)) AS DOUBLE) AS s, count(*) AS n, CAST(sum(CAST(round(rarity_score, 12) AS DECIMAL(21, 12))) AS DECIMAL(31, 12)) AS d FROM rarity GROUP BY 1),
rare_inside AS (SELECT window_id, CAST(sum(d) AS DOUBLE) / sum(n) AS name_weirdness_mean FROM candidates JOIN rare_minutes ON minute_bucket BETWEEN start_minute AND end_minute GROUP BY 1),
scale AS (SELECT coalesce(CASE WHEN quantile_cont(s / n, 0.95) > 0 THEN quantile_cont(s / n, 0.95) END, 1.0) AS rarity_scale, (SELECT count(*) FROM summary) AS n_clusters FROM rare_minutes),
measures AS MATERIALIZED (
  SELECT *, n AS count_raw, {ratio('np', 'n')} AS pro_rate_raw, CASE WHEN n > 0 THEN 1.0::DOUBLE - CAST(nu AS DOUBLE) / n ELSE 0.0::DOUBLE END AS dup_fraction_raw, CASE WHEN n_clusters > 0 AND n > 0 THEN {UNIT.format('CAST(near_records AS DOUBLE) / n')} END AS near_dup_fraction_raw,
    nd AS count_exact_row_dedup, {ratio('npd', 'nd')} AS pro_rate_exact_row_dedup, 0.0::DOUBLE AS dup_fraction_exact_row_dedup, CASE WHEN n_clusters > 0 AND nd > 0 THEN {UNIT.format('CAST(near_records AS DOUBLE) / nd')} END AS near_dup_fraction_exact_row_dedup
  FROM (SELECT candidates.*, n, np, nu, nd, npd, coalesce(near_records, 0) AS near_records, name_weirdness_mean FROM candidates JOIN inside USING (window_id) LEFT JOIN close_ USING (window_id) LEFT JOIN rare_inside USING (window_id)), scale)"""
_SHARES = [f"{x}_{lens}" for lens in ("raw", "exact_row_dedup") for x in ("count", "pro_rate", "dup_fraction", "near_dup_fraction")]
ORACLES["tr12_window_measures"] = surging(recursive(MEASURES, f"SELECT window_id, start_minute, end_minute, {', '.join(_SHARES)}, name_weirdness_mean, near_records FROM measures", " ".join(x for x in _SHARES if not x.startswith("count")) + " name_weirdness_mean"))
ORACLES["tr13_window_cluster_overlaps"] = surging(recursive(MEASURES, "SELECT * FROM overlaps_"))


def judged(entity: str, signals: str, known: str) -> str:
    """CTEs from signals (entity, ord, signal_id, detector, kind, score, support, effect, tested, low, hint) to verdicts; `known` is a table of (entity, support)."""
    w = "CASE kind WHEN 'stat_fdr' THEN 1.0::DOUBLE WHEN 'calibrated_empirical' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END"
    return f"""signals AS MATERIALIZED (SELECT *, {w} AS w FROM ({signals})),
votes AS (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY n DESC, at_) AS r, sum(n) OVER (PARTITION BY {entity}) AS cast_ FROM (SELECT {entity}, hint, count(*) AS n, min(ord) AS at_ FROM signals GROUP BY 1, 2)),
elected AS (SELECT {entity}, CASE WHEN count(*) = 1 THEN max(hint) FILTER (r = 1) WHEN max(n) FILTER (r = 1) = max(n) FILTER (r = 2) OR max(n) FILTER (r = 1) / CAST(max(cast_) AS DOUBLE) < 0.6::DOUBLE THEN 'mixed' ELSE max(hint) FILTER (r = 1) END AS primary_explanation,
  coalesce(max(hint) FILTER (r = 2), 'none') AS secondary_explanation FROM votes GROUP BY 1),
shares AS (SELECT *, CASE WHEN sum(w * score) OVER (PARTITION BY {entity}) > 0 THEN w * score / sum(w * score) OVER (PARTITION BY {entity}) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY {entity}) END AS share FROM signals),
by_detector AS (SELECT {entity}, detector, sum(share) AS share, row_number() OVER (PARTITION BY {entity} ORDER BY round(sum(share), 9) DESC, detector) AS r FROM shares GROUP BY 1, 2),
by_signal AS (SELECT {entity}, signal_id || ':' || kind AS name, share, row_number() OVER (PARTITION BY {entity} ORDER BY round(share, 9) DESC, signal_id) AS r FROM shares),
texts AS (SELECT {entity}, max(detector) FILTER (r = 1) AS score_primary_driver, string_agg(printf('%s (%.1f%%)', detector, round(share * 100.0::DOUBLE, 1)), '; ' ORDER BY r) FILTER (r <= 5) AS score_detector_breakdown FROM by_detector GROUP BY 1),
names_ AS (SELECT {entity}, string_agg(printf('%s (%.1f%%)', name, round(share * 100.0::DOUBLE, 1)), '; ' ORDER BY r) FILTER (r <= 5) AS score_signal_breakdown FROM by_signal GROUP BY 1),
totals_ AS (SELECT {entity}, {UNIT.format('sum(w * score) / sum(w)')} AS score, max(support) AS most, bool_or(low) AS is_low_power, bool_or(kind <> 'heuristic') AS calibrated, bool_or(support < 25) AS thin, bool_or(kind <> 'heuristic' AND NOT effect) AS no_effect, bool_or(kind = 'stat_fdr' AND NOT tested) AS no_test,
  string_agg(DISTINCT kind, ',' ORDER BY kind) AS evidence_kinds, string_agg(DISTINCT detector, ',' ORDER BY detector) AS source_detectors FROM signals GROUP BY 1),
verdicts AS (SELECT *, CASE WHEN score >= 0.8 AND support_n >= 25 AND calibrated AND NOT is_low_power THEN 'high' WHEN score >= 0.6 AND support_n >= 25 THEN 'medium' ELSE 'watch' END AS evidence_tier,
  concat_ws(',', CASE WHEN NOT calibrated THEN 'heuristic_only' END, CASE WHEN is_low_power THEN 'low_power' END, CASE WHEN thin THEN 'low_support_n' END, CASE WHEN no_effect THEN 'missing_effect_size' END, CASE WHEN no_test THEN 'missing_significance' END) AS caveat_flags
  FROM (SELECT *, greatest(most, support) AS support_n FROM totals_ JOIN ({known}) USING ({entity})) JOIN elected USING ({entity}) JOIN texts USING ({entity}) JOIN names_ USING ({entity}))"""


JUDGED = "support_n, evidence_tier, primary_explanation, secondary_explanation, score, is_low_power, caveat_flags, evidence_kinds, source_detectors, score_primary_driver, score_detector_breakdown, score_signal_breakdown"
RANK = "CASE evidence_tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, round(score, 9) DESC"


def window_verdicts(lens: str) -> str:
    n = f"count_{lens}"
    heuristic = lambda ord_, name, column, detector, scale, hint: f"SELECT window_id, {ord_}, '{name}', '{detector}', 'heuristic', {UNIT.format(f'{column} / {scale}')}, {n}, true, false, {n} < 25, '{hint}' FROM measures WHERE {column} > 0"
    signals = " UNION ALL ".join(
        [
            f"SELECT window_id, 1 AS ord, 'burst:' || window_id AS signal_id, 'bursts' AS detector, 'stat_fdr' AS kind, (1.0::DOUBLE - {UNIT.format('burst_q')} + {UNIT.format('(rate_ratio - 1.0::DOUBLE) / 3.0::DOUBLE')}) / 2.0::DOUBLE AS score, burst_n AS support, true AS effect, true AS tested, burst_n < 25 AS low, 'potential_manipulation' AS hint FROM measures WHERE burst_n IS NOT NULL",
            f"SELECT window_id, 2, 'swing:' || window_id, 'procon_swings', 'stat_fdr', (1.0::DOUBLE - {UNIT.format('swing_q')} + {UNIT.format('abs_delta / 0.35::DOUBLE')}) / 2.0::DOUBLE, swing_n, true, true, swing_low, 'potential_manipulation' FROM measures WHERE swing_n IS NOT NULL",
            heuristic(3, "dup_fraction", f"dup_fraction_{lens}", "duplicates_exact", "0.40::DOUBLE", "data_quality_artifact"),
            heuristic(4, "near_dup_fraction", f"near_dup_fraction_{lens}", "duplicates_near", "0.30::DOUBLE", "potential_manipulation"),
            heuristic(5, "name_weirdness_mean", "name_weirdness_mean", "rare_names", "rarity_scale", "potential_manipulation"),
        ]
    )
    return judged("window_id", signals, f"SELECT window_id, {n} AS support FROM measures")


def window_queue(lens: str) -> str:
    return f"""SELECT window_id, start_minute, end_minute, count_{lens} AS count, expected, z, least(burst_q, swing_q) AS q_value, pro_rate_{lens} AS pro_rate, delta_pro_rate, dup_fraction_{lens} AS dup_fraction, near_dup_fraction_{lens} AS near_dup_fraction, name_weirdness_mean, {JUDGED}
  FROM verdicts JOIN measures USING (window_id) ORDER BY {RANK}, support_n DESC, start_minute, end_minute LIMIT 250"""


_WD = "expected z q_value pro_rate delta_pro_rate dup_fraction near_dup_fraction name_weirdness_mean score"
ORACLES["tr6_statistical_queue"] = surging(recursive(f"{MEASURES}, {window_verdicts('raw')}", window_queue("raw"), _WD))
ORACLES["tr10_queue_exact_row_dedup"] = surging(recursive(f"{MEASURES}, {window_verdicts('exact_row_dedup')}", window_queue("exact_row_dedup"), _WD))
ORACLES["tr11_score_breakdown"] = surging(recursive(f"{MEASURES}, {window_verdicts('raw')}", f"SELECT window_id, score, score_primary_driver, score_detector_breakdown, score_signal_breakdown FROM ({window_queue('raw')})", "score"))

_BOTH = ("signals", "votes", "elected", "shares", "by_detector", "by_signal", "texts", "names_", "totals_", "verdicts")


def renamed(sql: str, tail: str) -> str:
    """The CTEs of verdicts under names of their own."""
    import re

    return re.sub(rf"\b({'|'.join(_BOTH)})\b(?! USING)", rf"\1{tail}", sql)


_SIDES = f"{MEASURES}, {window_verdicts('raw')}, {renamed(window_verdicts('exact_row_dedup'), '_d')}, q_raw AS ({window_queue('raw')}), q_dedup AS ({renamed(window_queue('exact_row_dedup'), '_d')})"
_SAME = ("count", "pro_rate", "dup_fraction", "score", "evidence_tier")
ORACLES["tr10_lenses_side_by_side"] = surging(
    recursive(
        _SIDES,
        f"""SELECT *, count_exact_row_dedup - count_raw AS count_delta, CASE WHEN count_raw <> 0 THEN CAST(count_exact_row_dedup - count_raw AS DOUBLE) / count_raw END AS count_relative_delta, pro_rate_exact_row_dedup - pro_rate_raw AS pro_rate_delta, dup_fraction_exact_row_dedup - dup_fraction_raw AS dup_fraction_delta,
          score_raw IS NOT NULL AS in_raw, score_exact_row_dedup IS NOT NULL AS in_exact_row_dedup
        FROM (SELECT window_id, {', '.join(f'a.{x} AS {x}_raw' for x in _SAME)}, {', '.join(f'b.{x} AS {x}_exact_row_dedup' for x in _SAME)} FROM q_raw a FULL JOIN q_dedup b USING (window_id))""",
        "pro_rate_raw pro_rate_exact_row_dedup dup_fraction_raw dup_fraction_exact_row_dedup score_raw score_exact_row_dedup count_relative_delta pro_rate_delta dup_fraction_delta",
    )
)
ORACLES["tr10_lens_summary"] = surging(
    rounded(
        f"{BASE}, one AS (SELECT {', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in ('n_total', 'n_pro', 'n_con', 'n_total_dedup', 'n_pro_dedup', 'n_con_dedup'))} FROM grid)",
        f"""SELECT *, total_submissions_exact_row_dedup - total_submissions_raw AS total_submissions_delta, CAST(total_submissions_exact_row_dedup - total_submissions_raw AS DOUBLE) / total_submissions_raw AS total_submissions_relative_delta,
          overall_pro_rate_exact_row_dedup - overall_pro_rate_raw AS overall_pro_rate_delta, overall_con_rate_exact_row_dedup - overall_con_rate_raw AS overall_con_rate_delta
        FROM (SELECT n_total AS total_submissions_raw, n_total_dedup AS total_submissions_exact_row_dedup, {ratio('n_pro', 'n_total')} AS overall_pro_rate_raw, {ratio('n_pro_dedup', 'n_total_dedup')} AS overall_pro_rate_exact_row_dedup, {ratio('n_con', 'n_total')} AS overall_con_rate_raw, {ratio('n_con_dedup', 'n_total_dedup')} AS overall_con_rate_exact_row_dedup FROM one)""",
        "total_submissions_relative_delta overall_pro_rate_raw overall_pro_rate_exact_row_dedup overall_con_rate_raw overall_con_rate_exact_row_dedup overall_pro_rate_delta overall_con_rate_delta",
    )
)

_NAMED = f"""{RECORDS}, {NAMES}, {TEXT}, rep AS (SELECT canonical_name, n, n_pro, n_con, display_name, time_span_minutes FROM names WHERE n > 1 ORDER BY n DESC, canonical_name LIMIT 200),
weird AS (SELECT canonical_name, avg(weirdness_score) AS weirdness_score, min(name_normalized) AS sample_name FROM scored GROUP BY 1 ORDER BY round(avg(weirdness_score), 9) DESC, canonical_name LIMIT 200),
people AS (SELECT coalesce(rep.canonical_name, weird.canonical_name) AS canonical_name, n AS repeats, coalesce(n, 1) AS n_records, coalesce(n_pro, 0) AS n_pro, coalesce(n_con, 0) AS n_con, coalesce(display_name, sample_name) AS display_name, time_span_minutes, weirdness_score
  FROM rep FULL JOIN weird ON rep.canonical_name = weird.canonical_name), """ + judged(
    "canonical_name",
    f"""SELECT canonical_name, 1 AS ord, 'repeat:' || canonical_name AS signal_id, 'duplicates_exact' AS detector, 'heuristic' AS kind, CAST(repeats AS DOUBLE) / (SELECT max(n) FROM rep) AS score, repeats AS support, true AS effect, false AS tested, repeats < 25 AS low, 'data_quality_artifact' AS hint FROM people WHERE repeats IS NOT NULL
    UNION ALL SELECT canonical_name, 2, 'weirdness:' || canonical_name, 'rare_names', 'heuristic', {UNIT.format('weirdness_score / (SELECT quantile_cont(weirdness_score, 0.95) FROM weird)')}, n_records, true, false, n_records < 25, 'potential_manipulation' FROM people WHERE weirdness_score IS NOT NULL""",
    "SELECT canonical_name, n_records AS support FROM people",
)
RECORD_QUEUE = f"SELECT canonical_name AS record_id, canonical_name, display_name, n_records, n_pro, n_con, time_span_minutes, weirdness_score, {JUDGED} FROM verdicts JOIN people USING (canonical_name) ORDER BY {RANK}, n_records DESC, canonical_name LIMIT 250"
ORACLES["tr7_record_evidence_queue"] = surging(rounded(_NAMED, RECORD_QUEUE, "time_span_minutes weirdness_score score"))

_CLUSTERS = f"{MEMBERS}, {SUMMARY}, " + judged(
    "cluster_id",
    f"""SELECT cluster_id, 1 AS ord, 'cluster:' || cluster_id AS signal_id, 'duplicates_near' AS detector, 'heuristic' AS kind,
      CAST(cluster_size AS DOUBLE) / (SELECT max(cluster_size) FROM summary) * 0.45::DOUBLE + CAST(n_records AS DOUBLE) / (SELECT max(n_records) FROM summary) * 0.35::DOUBLE + {UNIT.format('1.0::DOUBLE - least(time_span_minutes / 1440.0::DOUBLE, 1.0::DOUBLE)')} * 0.20::DOUBLE AS score,
      n_records AS support, true AS effect, false AS tested, n_records < 25 AS low, 'potential_manipulation' AS hint FROM summary""",
    "SELECT cluster_id, n_records AS support FROM summary",
)
CLUSTER_QUEUE = f"SELECT cluster_id, cluster_size, n_records, n_pro, n_con, first_seen, last_seen, time_span_minutes, {JUDGED} FROM verdicts JOIN summary USING (cluster_id) ORDER BY {RANK}, n_records DESC, cluster_id LIMIT 250"
ORACLES["tr8_cluster_evidence_queue"] = surging(recursive(_CLUSTERS, CLUSTER_QUEUE, "time_span_minutes score"))

_SPAN = "strftime(start_minute, '%Y-%m-%dT%H:%M') || '/' || strftime(end_minute, '%Y-%m-%dT%H:%M')"
ORACLES["tr9_triage_summary"] = surging(
    recursive(
        f"{MEASURES}, {window_verdicts('raw')}, windows_ AS ({window_queue('raw')}), {after(_NAMED[: _NAMED.index(', signals AS')], RECORDS + ', ' + NAMES + ', ')}",
        f"""SELECT (SELECT count(*) FROM sub) AS total_submissions, (SELECT min(minute) FROM sub) AS date_range_start, (SELECT max(minute) FROM sub) AS date_range_end, (SELECT count(*) FILTER (off) FROM sub) AS off_hours,
          (SELECT CAST(count(*) FILTER (pos = 'Pro') AS DOUBLE) / count(*) FROM sub) AS overall_pro_rate, (SELECT CAST(count(*) FILTER (pos = 'Con') AS DOUBLE) / count(*) FROM sub) AS overall_con_rate, (SELECT count(*) FILTER (NOT off) FROM sub) AS on_hours, (SELECT CAST(count(*) FILTER (off) AS DOUBLE) / count(*) FROM sub) AS off_hours_ratio,
          (SELECT count(*) FROM windows_) AS n_window_queue, {', '.join(f"(SELECT count(*) FILTER (evidence_tier = '{t}') FROM windows_) AS n_windows_{t}" for t in ('high', 'medium', 'watch'))},
          (SELECT least(count(*), 250) FROM people) AS n_record_queue, (SELECT least(count(*), 250) FROM summary) AS n_cluster_queue,
          (SELECT coalesce(string_agg(x, '; ' ORDER BY r), '') FROM (SELECT {_SPAN} AS x, row_number() OVER (ORDER BY round(burst_q, 9), round(rate_ratio, 9) DESC, burst_n DESC, {_SPAN}) AS r FROM measures WHERE burst_n IS NOT NULL) WHERE r <= 5) AS top_burst_windows,
          (SELECT coalesce(string_agg(x, '; ' ORDER BY r), '') FROM (SELECT {_SPAN} AS x, row_number() OVER (ORDER BY round(swing_q, 9), round(abs_delta, 9) DESC, swing_n DESC, {_SPAN}) AS r FROM measures WHERE swing_n IS NOT NULL) WHERE r <= 5) AS top_swing_windows,
          (SELECT coalesce(string_agg(canonical_name, '; ' ORDER BY n DESC, canonical_name), '') FROM (SELECT * FROM rep ORDER BY n DESC, canonical_name LIMIT 5)) AS top_repeated_names,
          (SELECT coalesce(string_agg(cluster_id, '; ' ORDER BY cluster_id), '') FROM (SELECT * FROM summary ORDER BY cluster_id LIMIT 5)) AS top_near_dup_clusters, 'raw' AS lens""",
        "overall_pro_rate overall_con_rate off_hours_ratio",
    )
)

ORACLES["fv1_report_vector"] = surging(
    recursive(
        f"{MEASURES}, {window_verdicts('raw')}, windows_ AS ({window_queue('raw')}), {after(_NAMED[: _NAMED.index(', signals AS')], RECORDS + ', ' + NAMES + ', ')},"
        f"""one AS (SELECT count(*) AS total_submissions, {ratio("count(*) FILTER (pos = 'Pro')", 'count(*)')} AS overall_pro_rate, {ratio("count(*) FILTER (pos = 'Con')", 'count(*)')} AS overall_con_rate, (SELECT count(*) FROM windows_) AS window_queue_size, (SELECT least(count(*), 250) FROM people) AS record_queue_size, (SELECT least(count(*), 250) FROM summary) AS cluster_queue_size,
          {', '.join(f"(SELECT count(*) FILTER (evidence_tier = '{t}') FROM windows_) AS window_{t}_count" for t in ('high', 'medium', 'watch'))}, (SELECT CAST(count(*) FILTER (evidence_tier = 'high') AS DOUBLE) / greatest(count(*), 1) FROM windows_) AS window_high_share, (SELECT max(score) FROM windows_) AS window_top_score, (SELECT max(abs(z)) FROM windows_) AS window_top_abs_z,
          (SELECT max(dup_fraction) FROM windows_) AS window_top_dup_fraction, (SELECT min(q_value) FROM windows_) AS window_min_q_value, (SELECT max(n) FROM rep) AS top_name_max_records, (SELECT max(n_records) FROM (SELECT * FROM summary ORDER BY cluster_id LIMIT 5)) AS top_cluster_max_records,
          {ratio('count(*) FILTER (off)', 'count(*)')} AS off_hours_ratio, CAST(count(*) - (SELECT sum(n_total_dedup) FROM grid) AS DOUBLE) / count(*) AS dedup_drop_fraction FROM sub)""",
        "SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM one) ON COLUMNS(*) INTO NAME metric VALUE value)",
        "value",
    )
)

_SIGNAL = "'burst:' || window_minutes || ':' || strftime(start_minute, '%Y%m%dT%H%M')"
ORACLES["tr5_contract_violations"] = surging(
    rounded(
        f"""{_BU}, broken AS (SELECT {_SIGNAL} AS signal_id, 'evidence_kind_unknown' AS rule FROM bt WHERE is_low_power
          UNION ALL SELECT {_SIGNAL}, 'signal_score_range' FROM bt WHERE rate_ratio IS NULL OR NOT (rate_ratio - 1.0::DOUBLE) / 3.0::DOUBLE BETWEEN 0 AND 1 UNION ALL SELECT {_SIGNAL}, 'explanation_hint_unknown' FROM bt WHERE hour(start_minute) = 18)""",
        "SELECT rule, count(*) AS n_violations, min(signal_id) AS first_signal_id FROM broken GROUP BY 1",
    )
)
