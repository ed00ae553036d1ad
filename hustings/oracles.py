"""DuckDB SQL for the registered queries: written from the definitions, not from the Spark plans."""

from __future__ import annotations

from hustings.config import BUCKETS

RECORDS = """raw AS (
  SELECT e.event_id AS id, e.ts, e.event_type, split_part(p.p_name, ' ', 1) AS w1, split_part(p.p_name, ' ', 2) || CAST(e.user_id % 25 AS VARCHAR) AS w2,
         CAST(regexp_extract(e.props, '[0-9]+') AS BIGINT) AS k
  FROM events e JOIN part p ON p.p_partkey = e.user_id),
sub AS (
  SELECT id, w2 || ', ' || w1 AS name, w2 || ' ' || w1 AS name_normalized, upper(w2) AS last, upper(w1) AS first, upper(w2) || '|' || upper(w1) AS canonical_name,
         upper(w2) || ', ' || upper(w1) AS name_display, CASE WHEN k % 3 = 0 THEN '' ELSE 'ORG ' || CAST(k % 20 AS VARCHAR) END AS org,
         CASE WHEN event_type IN ('click', 'signup') THEN 'Pro' WHEN event_type IN ('view', 'purchase') THEN 'Con' ELSE 'Unknown' END AS pos,
         ts AS t, date_trunc('minute', ts) AS minute, hour(ts) AS hh, isodow(ts) - 1 AS dow, hour(ts) BETWEEN 0 AND 5 AS off
  FROM raw)"""
SIZES = "sizes AS (SELECT CAST(unnest([{}]) AS BIGINT) AS bucket_minutes)"
ALL_SIZES = SIZES.format(", ".join(map(str, BUCKETS)))
PRO, CON, UNKNOWN = "count(*) FILTER (pos = 'Pro')", "count(*) FILTER (pos = 'Con')", "count(*) FILTER (pos = 'Unknown')"
SPAN = "date_diff('microsecond', min(t), max(t)) / 60000000.0::DOUBLE"


def total(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END"


def floor_to(t: str, b: str = "bucket_minutes") -> str:
    return f"date_trunc('minute', {t}) - to_minutes(CAST((hour({t}) * 60 + minute({t})) % {b} AS BIGINT))"


def wilson(k: str, n: str, prefix: str) -> str:
    """Three columns: low, high and half width."""
    z = "1.96::DOUBLE"
    p = f"least(greatest(CAST({k} AS DOUBLE) / {n}, 0.0::DOUBLE), 1.0::DOUBLE)"
    centre = f"(({p}) + {z} * {z} / ({n} * 2.0::DOUBLE)) / ({z} * {z} / {n} + 1.0::DOUBLE)"
    half = f"sqrt((({p}) * (1.0::DOUBLE - ({p})) + {z} * {z} / ({n} * 4.0::DOUBLE)) / {n}) * {z} / ({z} * {z} / {n} + 1.0::DOUBLE)"
    low, high = f"greatest({centre} - {half}, 0.0::DOUBLE)", f"least({centre} + {half}, 1.0::DOUBLE)"
    return ", ".join(f"CASE WHEN {n} > 0 THEN {x} END AS {prefix}_wilson_{name}" for x, name in ((low, "low"), (high, "high"), (f"({high} - {low}) / 2.0::DOUBLE", "half_width")))


def rounded(ctes: str, select: str, doubles: str = "") -> str:
    """The select over the CTEs, with the named doubles rounded to six digits."""
    body = f"WITH {ctes} SELECT * FROM ({select})"
    if doubles:
        body = f"WITH {ctes} SELECT * REPLACE ({', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {x}' for x in doubles.split())}) FROM ({select})"
    return body


W = "pro_rate_wilson_low pro_rate_wilson_high pro_rate_wilson_half_width"
SEEN = f"""seen AS (
  SELECT minute, count(*) AS n_total, count(DISTINCT canonical_name) AS n_unique_names, {PRO} AS n_pro, {CON} AS n_con, {UNKNOWN} AS n_unknown FROM sub GROUP BY minute),
firsts AS (SELECT *, row_number() OVER (PARTITION BY minute, canonical_name ORDER BY t, id) AS rn FROM sub),
kept AS (SELECT minute, count(*) AS n_total_dedup, {PRO} AS n_pro_dedup, {CON} AS n_con_dedup, {UNKNOWN} AS n_unknown_dedup FROM firsts WHERE rn = 1 GROUP BY minute)"""
GRID = f"""{SEEN},
grid AS (
  SELECT g.m AS minute_bucket, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('n_total', 'n_unique_names', 'n_pro', 'n_con', 'n_unknown', 'n_total_dedup', 'n_pro_dedup', 'n_con_dedup', 'n_unknown_dedup'))}
  FROM (SELECT unnest(generate_series((SELECT min(minute) FROM sub), (SELECT max(minute) FROM sub), INTERVAL 1 MINUTE)) AS m) g LEFT JOIN seen ON seen.minute = g.m LEFT JOIN kept ON kept.minute = g.m)"""
BASE = f"{RECORDS}, {GRID}"
NAMES = f"""names AS (
  SELECT canonical_name, count(*) AS n, {PRO} AS n_pro, {CON} AS n_con, {UNKNOWN} AS n_unknown, min(t) AS first_seen, max(t) AS last_seen, arg_min(name_display, id) AS display_name, {SPAN} AS time_span_minutes
  FROM sub GROUP BY canonical_name)"""
CELLS = f"""cells AS (
  SELECT bucket_minutes, canonical_name, {floor_to('t')} AS bucket_start, count(*) AS n, {PRO} AS n_pro, {CON} AS n_con, {UNKNOWN} AS n_unknown FROM sub, sizes GROUP BY ALL)"""
REPEATED = "SELECT canonical_name, n, n_pro, n_con, first_seen, last_seen, display_name, time_span_minutes FROM names WHERE n > 1"
TEXT = """features AS (
  SELECT id, canonical_name, name_display, name_normalized, first, length(name_normalized) AS name_length,
         CAST(length(regexp_replace(name_normalized, '[A-Za-z ]', '', 'g')) AS DOUBLE) / length(name_normalized) AS non_alpha_fraction, name_entropy, regexp_matches(first, '^[A-Z]\\.?$') AS is_initial_only
  FROM sub JOIN (
    SELECT name_normalized AS nn, -sum(p * log2(p)) AS name_entropy FROM (
      SELECT name_normalized, ch, CAST(count(*) AS DOUBLE) / length(name_normalized) AS p
      FROM (SELECT name_normalized, unnest(string_split(name_normalized, '')) AS ch FROM (SELECT DISTINCT name_normalized FROM sub)) GROUP BY name_normalized, ch) GROUP BY 1) e ON e.nn = name_normalized),
scored AS (SELECT *, name_length / (SELECT quantile_cont(length(name_normalized), 0.5) + 1 FROM sub) + 2.0::DOUBLE * non_alpha_fraction + name_entropy / 8.0::DOUBLE + CASE WHEN is_initial_only THEN 1.0 ELSE 0.0 END::DOUBLE AS weirdness_score FROM features)"""
PROFILE = f"{BASE}, {ALL_SIZES}, prof AS (SELECT bucket_minutes, {floor_to('minute')} AS bucket_start, {total('n_total')} AS n_total, {total('n_pro')} AS n_pro, {total('n_con')} AS n_con FROM seen, sizes GROUP BY ALL)"

ORACLES: dict[str, str] = {}
ORACLES["pr1_counts_per_minute"] = rounded(
    BASE,
    f"""SELECT *, CASE WHEN n_total > 0 THEN 1.0::DOUBLE - CAST(n_unique_names AS DOUBLE) / n_total ELSE 0.0::DOUBLE END AS dup_name_fraction, {ratio('n_pro', 'n_total')} AS pro_rate, {ratio('n_con', 'n_total')} AS con_rate,
    {ratio('n_unique_names', 'n_total')} AS unique_ratio, {ratio('n_pro_dedup', 'n_total_dedup')} AS pro_rate_dedup, {ratio('n_con_dedup', 'n_total_dedup')} AS con_rate_dedup, 0.0::DOUBLE AS dup_name_fraction_dedup,
    {ratio('n_total_dedup', 'n_total_dedup')} AS unique_ratio_dedup, {ratio('n_total - n_total_dedup', 'n_total')} AS dedup_drop_fraction, {ratio('n_total', 'n_total_dedup')} AS dedup_multiplier, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM grid""",
    f"dup_name_fraction pro_rate con_rate unique_ratio pro_rate_dedup con_rate_dedup unique_ratio_dedup dedup_drop_fraction dedup_multiplier {W}",
)
ORACLES["pr2_name_frequency"] = rounded(
    f"{RECORDS}, {NAMES}",
    "SELECT *, concat_ws(',', CASE WHEN n_con > 0 THEN 'Con' END, CASE WHEN n_pro > 0 THEN 'Pro' END, CASE WHEN n_unknown > 0 THEN 'Unknown' END) AS positions FROM names",
    "time_span_minutes",
)
ORACLES["pr3_counts_per_hour"] = rounded(
    RECORDS,
    f"SELECT *, {ratio('n_pro', 'n_total')} AS pro_rate, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM (SELECT dow AS day_of_week, hh AS hour, count(*) AS n_total, {PRO} AS n_pro, {CON} AS n_con FROM sub GROUP BY 1, 2)",
    f"pro_rate {W}",
)
ORACLES["pr4_basic_quality"] = rounded(
    f"""{RECORDS}, one AS (
    SELECT count(*) AS rows_total, count(*) FILTER (trim(name) = '') AS missing_name, count(*) FILTER (org = '') AS missing_organization, {UNKNOWN} AS unknown_position, count(*) FILTER (t IS NULL) AS invalid_timestamp,
      (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM sub GROUP BY id) WHERE n > 1) AS duplicate_ids,
      (SELECT count(*) FILTER (t < before) FROM (SELECT t, lag(t) OVER (ORDER BY id, t) AS before FROM sub)) AS non_monotonic_timestamp_vs_id FROM sub)""",
    "SELECT metric, CAST(value AS BIGINT) AS value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)",
)
ORACLES["pr5_name_text_features"] = rounded(f"{RECORDS}, {TEXT}", "SELECT * FROM scored", "non_alpha_fraction name_entropy weirdness_score")
ORACLES["pr6_bucket_profiles"] = rounded(PROFILE, f"SELECT *, {ratio('n_pro', 'n_total')} AS pro_rate, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM prof", f"pro_rate {W}")
ORACLES["pr7_day_hour_profiles"] = rounded(
    PROFILE,
    f"""SELECT *, {ratio('n_pro', 'n_total')} AS pro_rate, {wilson('n_pro', 'n_total', 'pro_rate')} FROM (
    SELECT bucket_minutes, dayname(bucket_start) AS day_name, hour(bucket_start) AS hour, {total('n_total')} AS n_total, {total('n_pro')} AS n_pro, {total('n_con')} AS n_con FROM prof GROUP BY 1, 2, 3)""",
    f"pro_rate {W}",
)
ORACLES["pr8_name_lengths"] = rounded(RECORDS, "SELECT length(name_normalized) AS name_length, count(*) AS n FROM sub GROUP BY 1")

# duplicates
ORACLES["de1_top_repeated_names"] = rounded(f"{RECORDS}, {NAMES}", f"{REPEATED} ORDER BY n DESC, canonical_name LIMIT 200", "time_span_minutes")
ORACLES["de2_repeated_same_bucket"] = rounded(f"{RECORDS}, {ALL_SIZES}, {CELLS}", "SELECT *, bucket_start + to_minutes(bucket_minutes - 1) AS bucket_end FROM cells WHERE n > 1")
ORACLES["de3_repeated_same_minute"] = rounded(f"{RECORDS}, {ALL_SIZES}, {CELLS}", "SELECT canonical_name, bucket_start AS minute_bucket, n, n_pro, n_con, n_unknown FROM cells WHERE n > 1 AND bucket_minutes = 1")
ORACLES["de4_position_switching_names"] = rounded(f"{RECORDS}, {NAMES}", f"{REPEATED} AND n_pro > 0 AND n_con > 0", "time_span_minutes")
ORACLES["de5_repeated_same_bucket_summary"] = rounded(
    f"{RECORDS}, {ALL_SIZES}, {CELLS}", "SELECT bucket_minutes, count(*) AS n_instances, count(DISTINCT canonical_name) AS n_names, max(n) AS max_n, avg(n) AS avg_n FROM cells WHERE n > 1 GROUP BY 1", "avg_n"
)
BLOCKS = "blocks AS (SELECT upper(left(last, 4) || '|' || left(first, 1)) AS block_key, count(DISTINCT canonical_name) AS n_unique_names FROM sub GROUP BY 1)"
ORACLES["dn1_candidate_blocks"] = rounded(f"{RECORDS}, {BLOCKS}", "SELECT * FROM blocks WHERE n_unique_names > 1")
ORACLES["dn2_skipped_blocks"] = rounded(f"{RECORDS}, {BLOCKS}", "SELECT *, 'block_size_exceeds_limit' AS reason FROM blocks WHERE n_unique_names > 5000")

# organisations
ORACLES["or1_organization_counts"] = rounded(RECORDS, f"SELECT org AS organization_clean, count(*) AS n, {PRO} AS n_pro, {CON} AS n_con, min(t) AS first_seen, max(t) AS last_seen FROM sub WHERE org <> '' GROUP BY 1")
ORACLES["or2_organization_minute_bursts"] = rounded(
    f"{RECORDS}, counts AS (SELECT minute AS minute_bucket, org AS organization_clean, count(*) AS n FROM sub WHERE org <> '' GROUP BY 1, 2)",
    "SELECT * FROM counts, (SELECT quantile_cont(n, 0.99) AS threshold FROM counts) WHERE n >= greatest(2.0, threshold)",
    "threshold",
)
BLANK = "n_blank_org"
ORG = f"{RECORDS}, {ALL_SIZES}, cell AS (SELECT bucket_minutes, {floor_to('t')} AS bucket_start, pos, org = '' AS blank FROM sub, sizes)"
BW = "blank_org_rate_wilson_low blank_org_rate_wilson_high blank_org_rate_wilson_half_width"
ORACLES["or4_blank_rate_by_bucket_position"] = rounded(
    ORG,
    f"""SELECT *, n_total - n_blank_org AS n_nonblank_org, {ratio(BLANK, 'n_total')} AS blank_org_rate, n_total < 30 AS is_low_power, {wilson(BLANK, 'n_total', 'blank_org_rate')} FROM (
    SELECT bucket_minutes, bucket_start, pos AS position_normalized, count(*) AS n_total, count(*) FILTER (blank) AS n_blank_org FROM cell GROUP BY 1, 2, 3)""",
    f"blank_org_rate {BW}",
)
_KINDS = {"pro": "Pro", "con": "Con", "unknown": "Unknown"}
BLANKS = f"""{ORG}, blanks AS (SELECT *, n_total - n_blank_org AS n_nonblank_org, {ratio(BLANK, 'n_total')} AS blank_org_rate, n_total < 30 AS is_low_power, {wilson(BLANK, 'n_total', 'blank_org_rate')} FROM (
    SELECT bucket_minutes, bucket_start, count(*) AS n_total, count(*) FILTER (blank) AS n_blank_org,
    {', '.join(f"count(*) FILTER (pos = '{v}') AS n_{k}, count(*) FILTER (blank AND pos = '{v}') AS n_blank_org_{k}" for k, v in _KINDS.items())} FROM cell GROUP BY 1, 2))"""
ORACLES["or3_blank_rate_by_bucket"] = rounded(
    BLANKS,
    f"SELECT *, {', '.join(f'{ratio(f'n_blank_org_{k}', f'n_{k}')} AS {k}_blank_org_rate, n_{k} < 30 AS {k}_is_low_power, {wilson(f'n_blank_org_{k}', f'n_{k}', f'{k}_blank_org_rate')}' for k in _KINDS)} FROM blanks",
    " ".join(f"{p}blank_org_rate {' '.join(p + x for x in BW.split())}" for p in ("", "pro_", "con_", "unknown_")),
)
ORACLES["or5_blank_rate_summary"] = rounded(
    BLANKS,
    """SELECT bucket_minutes, count(*) AS n_buckets, count(*) FILTER (is_low_power) AS n_low_power_buckets, avg(blank_org_rate) AS avg_blank_org_rate, quantile_cont(blank_org_rate, 0.5) AS median_blank_org_rate,
    max(blank_org_rate) AS max_blank_org_rate, min(blank_org_rate) AS min_blank_org_rate, avg(blank_org_rate_wilson_half_width) AS avg_blank_org_rate_wilson_half_width FROM blanks GROUP BY 1""",
    "avg_blank_org_rate median_blank_org_rate max_blank_org_rate min_blank_org_rate avg_blank_org_rate_wilson_half_width",
)

# rare names
WINDOWS = f"""{RECORDS}, {ALL_SIZES}, win AS (SELECT *, {ratio('n_unique_names', 'n_total')} AS unique_ratio, {ratio('n_pro', 'n_total')} AS pro_rate, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM (
    SELECT bucket_minutes, {floor_to('t')} AS bucket_start, count(*) AS n_total, count(DISTINCT canonical_name) AS n_unique_names, {PRO} AS n_pro, {CON} AS n_con FROM sub, sizes GROUP BY ALL))"""
ORACLES["rn1_singleton_names"] = rounded(
    f"{RECORDS}, {NAMES}",
    "SELECT *, concat_ws(',', CASE WHEN n_con > 0 THEN 'Con' END, CASE WHEN n_pro > 0 THEN 'Pro' END, CASE WHEN n_unknown > 0 THEN 'Unknown' END) AS positions FROM names WHERE n = 1",
    "time_span_minutes",
)
ORACLES["rn2_name_windows"] = rounded(WINDOWS, "SELECT * FROM win", f"unique_ratio pro_rate {W}")
ORACLES["rn3_unique_ratio_windows"] = rounded(
    WINDOWS,
    "SELECT w.*, threshold_unique_ratio, unique_ratio >= threshold_unique_ratio AS is_flagged_unique_ratio FROM win w JOIN (SELECT bucket_minutes, quantile_cont(unique_ratio, 0.99) AS threshold_unique_ratio FROM win WHERE n_total >= 25 GROUP BY 1) q USING (bucket_minutes) WHERE n_total >= 25",
    f"unique_ratio threshold_unique_ratio pro_rate {W}",
)
ORACLES["rn4_weird_names"] = rounded(
    f"{RECORDS}, {TEXT}",
    """SELECT canonical_name, avg(weirdness_score) AS weirdness_score, avg(name_length) AS name_length, avg(non_alpha_fraction) AS non_alpha_fraction, avg(name_entropy) AS name_entropy, min(name_normalized) AS sample_name
    FROM scored GROUP BY 1 ORDER BY round(avg(weirdness_score), 9) DESC, canonical_name LIMIT 200""",
    "weirdness_score name_length non_alpha_fraction name_entropy",
)


def _lookup(side: str, word: str) -> str:
    return f"""{side}_tokens AS (SELECT trim(regexp_replace(regexp_replace(upper({word}), '[^A-Z''\\- ]', '', 'g'), ' +', ' ', 'g')) AS token FROM part),
    {side}_lookup AS (SELECT token, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS probability FROM {side}_tokens WHERE token <> '' AND token < 'R' GROUP BY token)"""


RARITY = f"""{RECORDS}, {ALL_SIZES}, {_lookup('first', "split_part(p_name, ' ', 1)")}, {_lookup('last', "split_part(p_name, ' ', 2) || CAST(p_partkey % 25 AS VARCHAR)")},
tokens AS (SELECT id, t, canonical_name, trim(regexp_replace(first, '[^A-Z''\\- ]', '', 'g')) AS first_token, trim(regexp_replace(last, '[^A-Z''\\- ]', '', 'g')) AS last_token FROM sub),
rarity AS (SELECT x.*, f.probability AS p_first, l.probability AS p_last, -ln(greatest(coalesce(f.probability, 1e-9::DOUBLE) * coalesce(l.probability, 1e-9::DOUBLE), 1e-9::DOUBLE)) AS rarity_score
  FROM tokens x LEFT JOIN first_lookup f ON f.token = first_token LEFT JOIN last_lookup l ON l.token = last_token),
rare AS (SELECT bucket_minutes, {floor_to('t')} AS bucket_start, count(*) AS n_total, avg(rarity_score) AS rarity_mean, quantile_cont(rarity_score, 0.5) AS rarity_median, quantile_cont(rarity_score, 0.9) AS rarity_p90, quantile_cont(rarity_score, 0.95) AS rarity_p95, count(*) < 30 AS is_low_power
  FROM rarity, sizes GROUP BY 1, 2)"""
_RD = "rarity_mean rarity_median rarity_p90 rarity_p95"
ORACLES["rn5_rarity_by_bucket"] = rounded(RARITY, "SELECT * FROM rare", _RD)
ORACLES["rn6_rarity_high_windows"] = rounded(
    RARITY, "SELECT rare.*, threshold_rarity_median FROM rare JOIN (SELECT bucket_minutes, quantile_cont(rarity_median, 0.99) AS threshold_rarity_median FROM rare WHERE n_total >= 25 GROUP BY 1) q USING (bucket_minutes) WHERE n_total >= 25 AND rarity_median >= threshold_rarity_median", f"{_RD} threshold_rarity_median"
)
ORACLES["rn7_rarity_top_records"] = rounded(RARITY, "SELECT id, canonical_name, rarity_score FROM rarity ORDER BY round(rarity_score, 9) DESC, id LIMIT 200", "rarity_score")
ORACLES["rn8_rarity_lookup_coverage"] = rounded(
    RARITY,
    " UNION ALL ".join(
        f"SELECT '{s}' AS lookup, (SELECT count(*) FROM {s}_lookup) AS lookup_size, count(*) FILTER ({s}_token <> '') AS n_tokens, count(*) FILTER ({s}_token <> '' AND p_{s} IS NOT NULL) AS n_matched, CAST(count(*) FILTER ({s}_token <> '' AND p_{s} IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER ({s}_token <> ''), 0) AS match_rate FROM rarity"
        for s in ("first", "last")
    ),
    "match_rate",
)
for _s, _n in (("first", 9), ("last", 10)):
    ORACLES[f"rn{_n}_unmatched_{_s}_tokens"] = rounded(RARITY, f"SELECT {_s}_token, count(*) AS n FROM rarity WHERE {_s}_token <> '' AND p_{_s} IS NULL GROUP BY 1 ORDER BY n DESC, {_s}_token LIMIT 200")

# periodicity
INDEXED = f"{BASE}, s AS (SELECT row_number() OVER (ORDER BY minute_bucket) - 1 AS i, minute_bucket, CAST(n_total AS DOUBLE) AS x FROM grid)"
ORACLES["pe1_autocorr"] = rounded(
    INDEXED,
    """SELECT lag AS lag_minutes, coalesce(CASE WHEN count(*) > 1 AND max(a.x) > min(a.x) AND max(b.x) > min(b.x) THEN corr(a.x, b.x) END, 0.0) AS autocorr, abs(coalesce(CASE WHEN count(*) > 1 AND max(a.x) > min(a.x) AND max(b.x) > min(b.x) THEN corr(a.x, b.x) END, 0.0)) AS abs_autocorr
    FROM (SELECT i + lag AS j, lag, x FROM s, (SELECT CAST(unnest(range(1, 181)) AS BIGINT) AS lag)) a JOIN s b ON b.i = a.j GROUP BY 1""",
    "autocorr abs_autocorr",
)
CLOCK = f"""{BASE}, clock AS (SELECT m AS minute_of_hour, coalesce(n, 0) AS n_events, e / 60.0::DOUBLE AS expected_n_events_uniform, coalesce(n, 0) - e / 60.0::DOUBLE AS deviation_from_uniform, coalesce(n, 0) / CAST(e AS DOUBLE) AS share,
  (coalesce(n, 0) - e / 60.0::DOUBLE) / sqrt(e / 60.0::DOUBLE) AS z_score_uniform
  FROM (SELECT CAST(unnest(range(0, 60)) AS BIGINT) AS m) LEFT JOIN (SELECT minute(minute_bucket) AS k, {total('n_total')} AS n FROM grid GROUP BY 1) ON k = m, (SELECT sum(n_total) AS e FROM grid))"""
_CD = "expected_n_events_uniform deviation_from_uniform share z_score_uniform"
ORACLES["pe6_clockface_distribution"] = rounded(CLOCK, "SELECT * FROM clock", _CD)
ORACLES["pe7_clockface_top_minutes"] = rounded(CLOCK, "SELECT * FROM clock ORDER BY n_events DESC, minute_of_hour LIMIT 20", _CD)
FANO = f"""{INDEXED}, fano AS (SELECT *, CASE WHEN mean_count > 0 THEN variance_count / mean_count ELSE 0.0 END AS fano_factor FROM (""" + " UNION ALL ".join(
    f"""SELECT {w}::BIGINT AS window_minutes, minute_bucket - to_minutes({w - 1}) AS start_minute, minute_bucket AS end_minute, {w}::BIGINT AS n_points, CAST(sum(k) OVER r AS DOUBLE) / {w} AS mean_count, CAST({w} * sum(k * k) OVER r - sum(k) OVER r * sum(k) OVER r AS DOUBLE) / {w * w} AS variance_count, i
    FROM (SELECT *, CAST(x AS HUGEINT) AS k FROM s) WINDOW r AS (ORDER BY i ROWS {w - 1} PRECEDING) QUALIFY i >= {w - 1}"""
    for w in (15, 60, 240)
) + "))"
ORACLES["pe9_rolling_fano"] = rounded(FANO, "SELECT * EXCLUDE (i), fano_factor >= 1.5 AS is_high_fano FROM fano", "mean_count variance_count fano_factor")
ORACLES["pe10_rolling_fano_summary"] = rounded(
    FANO,
    "SELECT window_minutes, count(*) AS n_windows, quantile_cont(fano_factor, 0.5) AS median_fano_factor, quantile_cont(fano_factor, 0.95) AS p95_fano_factor, max(fano_factor) AS max_fano_factor, avg(CASE WHEN fano_factor >= 1.5 THEN 1.0 ELSE 0.0 END) AS high_fano_ratio FROM fano GROUP BY 1",
    "median_fano_factor p95_fano_factor max_fano_factor high_fano_ratio",
)

# bursts and swings
ROLL = f"{BASE}, roll AS (" + " UNION ALL ".join(
    f"""SELECT {w}::BIGINT AS window_minutes, minute_bucket - to_minutes({w - 1}) AS start_minute, minute_bucket AS end_minute, CAST(sum(n_total) OVER r AS BIGINT) AS n_total, CAST(sum(n_pro) OVER r AS BIGINT) AS n_pro, CAST(sum(n_con) OVER r AS BIGINT) AS n_con
    FROM grid WINDOW r AS (ORDER BY minute_bucket ROWS {w - 1} PRECEDING) QUALIFY row_number() OVER (ORDER BY minute_bucket) >= {w}"""
    for w in BUCKETS
) + "), facts AS (SELECT avg(n_total) AS rate, CAST(sum(n_pro) AS DOUBLE) / sum(n_total) AS overall FROM grid)"
ORACLES["bu1_burst_windows"] = rounded(
    ROLL,
    f"""SELECT window_minutes, start_minute, end_minute, n_total AS observed_count, n_pro, n_con, overall AS overall_pro_rate, rate * window_minutes AS expected_count, {ratio('n_total', '(rate * window_minutes)')} AS rate_ratio, {ratio('n_pro', 'n_total')} AS pro_rate,
    n_total < 30 AS is_low_power, {ratio('n_pro', 'n_total')} - overall AS delta_pro_rate, abs({ratio('n_pro', 'n_total')} - overall) AS abs_delta_pro_rate, {wilson('n_pro', 'n_total', 'pro_rate')} FROM roll, facts""",
    f"overall_pro_rate expected_count rate_ratio pro_rate delta_pro_rate abs_delta_pro_rate {W}",
)
ORACLES["bu6_hourly_rates"] = rounded(
    ROLL, "SELECT h AS hour, coalesce(r, rate) AS rate_per_minute FROM (SELECT CAST(unnest(range(0, 24)) AS BIGINT) AS h) LEFT JOIN (SELECT hour(minute_bucket) AS k, avg(n_total) AS r FROM grid GROUP BY 1) ON k = h, facts", "rate_per_minute"
)
_BASELINE = "least(greatest(overall, 1e-6::DOUBLE), (1.0 - 1e-6)::DOUBLE)"
ORACLES["ps1_swing_windows"] = rounded(
    ROLL,
    f"""SELECT *, abs(delta_pro_rate) AS abs_delta_pro_rate, delta_pro_rate / sqrt(baseline_pro_rate * (1.0::DOUBLE - baseline_pro_rate) / n_total) AS z_score, CASE WHEN delta_pro_rate >= 0 THEN 'pro_heavy' ELSE 'con_heavy' END AS direction, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')}
    FROM (SELECT window_minutes, start_minute, end_minute, n_total, n_pro, CAST(n_pro AS DOUBLE) / n_total AS pro_rate, {_BASELINE} AS baseline_pro_rate, CAST(n_pro AS DOUBLE) / n_total - {_BASELINE} AS delta_pro_rate FROM roll, facts WHERE n_total >= 25)""",
    f"pro_rate baseline_pro_rate delta_pro_rate abs_delta_pro_rate z_score {W}",
)
ORACLES["ps4_pro_rate_by_hour"] = ORACLES["pr3_counts_per_hour"]


def _enriched(name: str, source: str, keys: str, half: str) -> str:
    return f"""{name}_0 AS (SELECT *, CASE WHEN n_total > 0 THEN CAST(n_pro AS DOUBLE) / n_total END AS pro_rate, {_BASELINE} AS baseline_pro_rate FROM {source}, (SELECT overall FROM facts)),
{name}_c AS (SELECT bucket_minutes, quantile_cont(pro_rate, 0.5) AS centre FROM {name}_0 GROUP BY 1),
{name}_b AS (SELECT c.bucket_minutes, any_value(centre) AS stable_center, greatest({half}::DOUBLE, quantile_cont(abs(pro_rate - centre), 0.5) * 1.4826::DOUBLE * 2.5::DOUBLE) AS stable_half_width FROM {name}_0 a JOIN {name}_c c USING (bucket_minutes) GROUP BY 1),
{name} AS (SELECT {keys}, n_total, n_pro, n_total - n_pro AS n_con, baseline_pro_rate, pro_rate, pro_rate - baseline_pro_rate AS delta_pro_rate, abs(pro_rate - baseline_pro_rate) AS abs_delta_pro_rate,
  CASE WHEN n_total > 0 THEN (pro_rate - baseline_pro_rate) / sqrt(baseline_pro_rate * (1.0::DOUBLE - baseline_pro_rate) / n_total) ELSE 0.0 END AS z_score, CASE WHEN pro_rate - baseline_pro_rate >= 0 THEN 'pro_heavy' ELSE 'con_heavy' END AS direction,
  n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')}, stable_half_width, stable_center, greatest(0.0::DOUBLE, stable_center - stable_half_width) AS stable_lower, least(1.0::DOUBLE, stable_center + stable_half_width) AS stable_upper,
  coalesce(pro_rate < greatest(0.0::DOUBLE, stable_center - stable_half_width) OR pro_rate > least(1.0::DOUBLE, stable_center + stable_half_width), false) AS outside_stable_range
  FROM {name}_0 JOIN {name}_b USING (bucket_minutes))"""


_ED = f"baseline_pro_rate pro_rate delta_pro_rate abs_delta_pro_rate z_score stable_half_width stable_center stable_lower stable_upper {W}"
_SLOT = "CAST((hour(bucket_start) * 60 + minute(bucket_start)) // bucket_minutes AS BIGINT)"
_LABEL = "printf('%02d:%02d', slot * bucket_minutes // 60, slot * bucket_minutes % 60)"
SWING = f"""{ROLL}, {SIZES.format('15, 30, 60, 120, 240')}, gb AS (SELECT bucket_minutes, {floor_to('minute_bucket')} AS bucket_start, {total('n_total')} AS n_total, {total('n_pro')} AS n_pro FROM grid, sizes GROUP BY ALL),
{_enriched('tb', 'gb', 'bucket_minutes, bucket_start', '0.05')},
sl AS (SELECT bucket_minutes, {_SLOT} AS slot, {total('n_total')} AS n_total, {total('n_pro')} AS n_pro FROM gb GROUP BY ALL),
{_enriched('td', 'sl', 'bucket_minutes, slot', '0.05')},
dy AS (SELECT *, strftime(bucket_start, '%Y-%m-%d') AS date, {_SLOT} AS slot FROM gb), {_enriched('db', 'dy', 'bucket_minutes, slot, bucket_start, date', '0.07')}"""
ORACLES["ps5_time_bucket_bands"] = rounded(SWING, "SELECT * FROM tb", _ED)
ORACLES["ps6_time_of_day_bands"] = rounded(SWING, f"SELECT *, {_LABEL} AS slot_start FROM td", _ED)
ORACLES["ps7_day_bucket_bands"] = rounded(
    SWING,
    f"""SELECT db.*, {_LABEL.replace('slot', 'db.slot').replace('bucket_minutes', 'db.bucket_minutes')} AS slot_start, td.pro_rate AS slot_expected_pro_rate, td.stable_half_width AS slot_half_width, db.pro_rate - td.pro_rate AS slot_delta_pro_rate,
    coalesce(CASE WHEN db.n_total > 0 AND sqrt(td.pro_rate * (1.0::DOUBLE - td.pro_rate) / db.n_total) > 0 THEN (db.pro_rate - td.pro_rate) / sqrt(td.pro_rate * (1.0::DOUBLE - td.pro_rate) / db.n_total) ELSE 0.0 END, 0.0) AS slot_z_score
    FROM db LEFT JOIN td ON td.bucket_minutes = db.bucket_minutes AND td.slot = db.slot""",
    f"{_ED} slot_expected_pro_rate slot_half_width slot_delta_pro_rate slot_z_score",
)
RUNS = f"""{SWING}, sided AS (SELECT *, CASE WHEN abs(coalesce(delta_pro_rate, 0.0)) <= 1e-9 THEN 'neutral' WHEN coalesce(delta_pro_rate, 0.0) > 0 THEN 'pro_heavy' ELSE 'con_heavy' END AS side FROM tb),
flips AS (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY bucket_minutes ORDER BY bucket_start) THEN 0 ELSE 1 END AS new FROM sided),
islands AS (SELECT *, sum(new) OVER (PARTITION BY bucket_minutes ORDER BY bucket_start) AS run FROM flips),
runs AS (SELECT bucket_minutes, side AS direction, min(bucket_start) AS start_bucket, max(bucket_start) AS end_bucket, count(*) AS run_length, {total('n_total')} AS n_total, avg(delta_pro_rate) AS mean_delta_pro_rate, avg(abs_delta_pro_rate) AS mean_abs_delta_pro_rate, max(abs_delta_pro_rate) AS max_abs_delta_pro_rate
  FROM islands WHERE side <> 'neutral' GROUP BY bucket_minutes, run, side)"""
ORACLES["ps9_direction_runs"] = rounded(
    RUNS,
    "SELECT *, CAST(bucket_minutes AS VARCHAR) || 'm-r' || CAST(row_number() OVER (PARTITION BY bucket_minutes ORDER BY start_bucket) AS VARCHAR) AS run_id, run_length >= 3 AS is_long_run FROM runs",
    "mean_delta_pro_rate mean_abs_delta_pro_rate max_abs_delta_pro_rate",
)
ORACLES["ps10_direction_runs_summary"] = rounded(
    RUNS,
    "SELECT bucket_minutes, count(*) AS n_runs, count(*) FILTER (run_length >= 3) AS n_long_runs, max(run_length) AS max_run_length, avg(run_length) AS mean_run_length, avg(CASE WHEN run_length >= 3 THEN 1.0 ELSE 0.0 END) AS long_run_ratio FROM runs GROUP BY 1",
    "mean_run_length long_run_ratio",
)

# off hours
_SUMS = f"count(*) AS n_total, {PRO} AS n_pro, {CON} AS n_con, {UNKNOWN} AS n_unknown, count(*) FILTER (off) AS n_off_hours"
_KNOWN = f"n_pro + n_con AS n_known, {ratio('n_pro', '(n_pro + n_con)')} AS pro_rate, n_pro + n_con < 25 AS is_low_power, {wilson('n_pro', '(n_pro + n_con)', 'pro_rate')}"
ORACLES["oh2_hourly_distribution"] = rounded(RECORDS, f"SELECT *, {_KNOWN} FROM (SELECT hh AS hour, {_SUMS} FROM sub GROUP BY 1)", f"pro_rate {W}")
ORACLES["oh3_hour_of_week_distribution"] = rounded(
    RECORDS, f"SELECT *, CAST(n_off_hours AS DOUBLE) / n_total AS off_hours_fraction, {_KNOWN} FROM (SELECT dayname(t) AS day_of_week, dow AS day_of_week_index, hh AS hour, {_SUMS} FROM sub GROUP BY 1, 2, 3)", f"off_hours_fraction pro_rate {W}"
)
ORACLES["oh4_date_hour_distribution"] = rounded(
    RECORDS, f"SELECT *, CAST(n_off_hours AS DOUBLE) / n_total AS off_hours_fraction, {_KNOWN} FROM (SELECT strftime(t, '%Y-%m-%d') AS date, hh AS hour, {_SUMS} FROM sub GROUP BY 1, 2)", f"off_hours_fraction pro_rate {W}"
)


def _limits(name: str) -> str:
    p = f"expected_pro_rate_{name}"
    se = f"CASE WHEN n_known > 0 THEN sqrt({p} * (1.0::DOUBLE - {p}) / n_known) END"
    out = []
    for tag, z in (("95", "1.96"), ("998", "3.0")):
        low, high = f"greatest({p} - ({se}) * {z}::DOUBLE, 0.0::DOUBLE)", f"least({p} + ({se}) * {z}::DOUBLE, 1.0::DOUBLE)"
        low, high = f"CASE WHEN n_known > 0 THEN {low} ELSE 0.0::DOUBLE END", f"CASE WHEN n_known > 0 THEN {high} ELSE 1.0::DOUBLE END"
        out += [f"{low} AS control_low_{tag}_{name}", f"{high} AS control_high_{tag}_{name}", f"coalesce(pro_rate < {low}, false) AS is_below_{tag}_{name}", f"coalesce(pro_rate > {high}, false) AS is_above_{tag}_{name}"]
    return ", ".join([*out, f"pro_rate - {p} AS delta_pro_rate_{name}", f"CASE WHEN ({se}) > 0 THEN (pro_rate - {p}) / ({se}) END AS z_score_{name}"])


OFF = f"""{RECORDS}, {ALL_SIZES},
facts AS (SELECT CAST({PRO} AS DOUBLE) / ({PRO} + {CON}) AS overall, CAST(count(*) FILTER (pos = 'Pro' AND NOT off) AS DOUBLE) / count(*) FILTER (pos <> 'Unknown' AND NOT off) AS on_rate FROM sub),
days AS (SELECT strftime(t, '%Y-%m-%d') AS event_date_key, count(*) AS day_on_hours_known, {PRO} AS day_on_hours_pro FROM sub WHERE NOT off AND pos <> 'Unknown' GROUP BY 1),
w0 AS (SELECT bucket_minutes, {floor_to('t')} AS bucket_start, {_SUMS} FROM sub, sizes GROUP BY ALL),
w1 AS (SELECT *, {_KNOWN}, strftime(bucket_start, '%Y-%m-%d') AS event_date_key, dayname(bucket_start) AS day_of_week, hour(bucket_start) AS hour, CAST(n_off_hours AS DOUBLE) / n_total AS off_hours_fraction, CAST(n_off_hours AS DOUBLE) / n_total >= 0.5 AS is_off_hours_window,
  n_off_hours = n_total AS is_pure_off_hours_window, CAST(n_off_hours AS DOUBLE) / n_total >= 1.0 AS is_alert_off_hours_window FROM w0),
w2 AS (SELECT w1.*, day_on_hours_known, day_on_hours_pro, CAST(day_on_hours_pro AS DOUBLE) / day_on_hours_known AS day_on_hours_pro_rate, on_rate AS expected_pro_rate_global,
  CASE WHEN day_on_hours_known >= 25 THEN CAST(day_on_hours_pro AS DOUBLE) / day_on_hours_known ELSE on_rate END AS expected_pro_rate_day, CASE WHEN day_on_hours_known >= 25 THEN 'day_on_hours' ELSE 'global_on_hours' END AS baseline_source FROM w1 LEFT JOIN days USING (event_date_key), facts),
w3 AS (SELECT *, {_limits('day')}, {_limits('global')}, n_known > 0 AND expected_pro_rate_day IS NOT NULL AS is_tested, is_alert_off_hours_window AND NOT is_low_power AS is_eligible FROM w2),
w4 AS (SELECT *, coalesce(delta_pro_rate_day <= -0.03::DOUBLE, false) AS is_material_lower_day FROM w3)"""
_OD = f"pro_rate off_hours_fraction day_on_hours_pro_rate expected_pro_rate_global expected_pro_rate_day {W} " + " ".join(f"control_low_95_{b} control_high_95_{b} control_low_998_{b} control_high_998_{b} delta_pro_rate_{b} z_score_{b}" for b in ("day", "global"))
ORACLES["oh5_window_limits"] = rounded(OFF, "SELECT * FROM w4", _OD)
ORACLES["oh9_flagged_windows"] = rounded(OFF, "SELECT * FROM w4 WHERE is_tested AND is_eligible AND is_below_95_day", _OD)
ORACLES["oh6_date_hour_residuals"] = rounded(
    OFF,
    f"""SELECT bucket_minutes, event_date_key AS date, hour, count(*) AS n_windows, CAST(sum(n_known) AS BIGINT) AS n_known, count(*) FILTER (is_low_power) AS n_low_power_windows, CASE WHEN sum(n_known) FILTER (pro_rate IS NOT NULL) > 0 THEN sum(pro_rate * n_known) / sum(n_known) FILTER (pro_rate IS NOT NULL) END AS pro_rate_weighted,
    CASE WHEN sum(n_known) FILTER (expected_pro_rate_day IS NOT NULL) > 0 THEN sum(expected_pro_rate_day * n_known) / sum(n_known) FILTER (expected_pro_rate_day IS NOT NULL) END AS expected_pro_rate_weighted, avg(z_score_day) AS mean_z_score, quantile_cont(z_score_day, 0.5) AS median_z_score, max(abs(z_score_day)) AS max_abs_z_score FROM w4 GROUP BY 1, 2, 3""",
    "pro_rate_weighted expected_pro_rate_weighted mean_z_score median_z_score max_abs_z_score",
)
ORACLES["oh10_alert_runs"] = rounded(
    f"""{OFF}, marked AS (SELECT bucket_minutes, bucket_start, n_known, is_below_95_day AS f, lag(is_below_95_day) OVER o AS f0, lag(bucket_start) OVER o AS b0 FROM w4 WINDOW o AS (PARTITION BY bucket_minutes ORDER BY bucket_start)),
    runs AS (SELECT *, sum(CASE WHEN f AND (f0 IS NULL OR NOT f0 OR date_diff('minute', b0, bucket_start) > 2 * bucket_minutes) THEN 1 ELSE 0 END) OVER (PARTITION BY bucket_minutes ORDER BY bucket_start) AS run FROM marked)""",
    f"SELECT bucket_minutes, min(bucket_start) AS start_bucket, max(bucket_start) AS end_bucket, count(*) AS run_length, {total('n_known')} AS n_known, count(*) * bucket_minutes AS run_minutes FROM runs WHERE f GROUP BY bucket_minutes, run",
)
_N = "CAST(on_known + off_known AS DOUBLE)"
_P = "CAST(on_pro + off_pro AS DOUBLE)"
ORACLES["oh1_off_hours_totals"] = rounded(
    f"""{RECORDS}, one AS (SELECT count(*) AS n_total, count(*) FILTER (off) AS n_off_hours, count(*) FILTER (NOT off AND pos <> 'Unknown') AS on_known, count(*) FILTER (NOT off AND pos = 'Pro') AS on_pro, count(*) FILTER (off AND pos <> 'Unknown') AS off_known, count(*) FILTER (off AND pos = 'Pro') AS off_pro FROM sub)""",
    f"""SELECT *, {ratio('n_off_hours', 'n_total')} AS off_hours_ratio, {ratio('on_pro', 'on_known')} AS on_pro_rate, {ratio('off_pro', 'off_known')} AS off_pro_rate, {wilson('on_pro', 'on_known', 'on_pro_rate')}, {wilson('off_pro', 'off_known', 'off_pro_rate')},
    {_N} * power(CAST(on_pro AS DOUBLE) * (off_known - off_pro) - CAST(off_pro AS DOUBLE) * (on_known - on_pro), 2) / ({_P} * ({_N} - {_P}) * on_known::DOUBLE * off_known::DOUBLE) AS chi_square FROM one""",
    "off_hours_ratio on_pro_rate off_pro_rate chi_square " + " ".join(f"{s}_pro_rate_wilson_{x}" for s in ("on", "off") for x in ("low", "high", "half_width")),
)

# ordering
ORACLES["so1_sortedness_metrics"] = rounded(
    f"""{RECORDS}, ranks AS (SELECT rank() OVER (ORDER BY id) + (count(*) OVER (PARTITION BY id) - 1) / 2.0 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS b,
    rank() OVER (ORDER BY last || '|' || first) + (count(*) OVER (PARTITION BY last || '|' || first) - 1) / 2.0 AS d, t < lag(t) OVER (ORDER BY id, t) AS back FROM sub)""",
    """SELECT count(*) AS n_records, corr(a, b) AS id_timestamp_spearman, corr(a, d) AS id_name_spearman, count(*) FILTER (back) AS time_monotonic_breaks, CAST(count(*) FILTER (back) AS DOUBLE) / (count(*) - 1) AS time_break_ratio FROM ranks""",
    "id_timestamp_spearman id_name_spearman time_break_ratio",
)
ORDERING = f"""{RECORDS}, {ALL_SIZES}, placed AS (SELECT bucket_minutes, {floor_to('t')} AS bucket_start, name_display AS x, row_number() OVER (PARTITION BY bucket_minutes, {floor_to('t')} ORDER BY t, id, name_display) AS r FROM sub, sizes),
sized AS (SELECT bucket_minutes, bucket_start, count(*) AS n_records, list(x ORDER BY r) = list(x ORDER BY x) AS is_alphabetical FROM placed GROUP BY 1, 2 HAVING count(*) >= 3),
signs AS (SELECT a.bucket_minutes, a.bucket_start, sum(CASE WHEN a.x < b.x THEN 1 WHEN a.x > b.x THEN -1 ELSE 0 END) AS s, count(*) FILTER (a.x = b.x) AS ties FROM placed a JOIN placed b ON a.bucket_minutes = b.bucket_minutes AND a.bucket_start = b.bucket_start AND a.r < b.r GROUP BY 1, 2),
ordering AS (SELECT z.*, CASE WHEN n_records * (n_records - 1) / 2.0 > ties THEN s / sqrt((n_records * (n_records - 1) / 2.0)::DOUBLE * (n_records * (n_records - 1) / 2.0 - ties)::DOUBLE) ELSE 0.0 END AS kendall_tau FROM sized z JOIN signs USING (bucket_minutes, bucket_start))"""
ORACLES["so3_bucket_ordering_summary"] = rounded(
    ORDERING,
    """SELECT bucket_minutes, count(*) AS n_buckets, avg(n_records) AS avg_records_per_bucket, avg(CASE WHEN is_alphabetical THEN 1.0 ELSE 0.0 END) AS alphabetical_ratio, avg(kendall_tau) AS mean_kendall_tau, avg(abs(kendall_tau)) AS mean_abs_kendall_tau, max(abs(kendall_tau)) AS max_abs_kendall_tau,
    avg(CASE WHEN abs(kendall_tau) >= 0.8 THEN 1.0 ELSE 0.0 END) AS strong_ordering_ratio FROM ordering GROUP BY 1""",
    "avg_records_per_bucket alphabetical_ratio mean_kendall_tau mean_abs_kendall_tau max_abs_kendall_tau strong_ordering_ratio",
)

# multivariate and composite inputs
FEATURES = f"""{BASE}, {SIZES.format('15, 240')}, org AS (SELECT minute, count(*) FILTER (org = '') AS blank FROM sub GROUP BY 1),
a0 AS (SELECT bucket_minutes, {floor_to('minute_bucket')} AS bucket_start, {total('n_total')} AS n_total, {total('n_pro')} AS n_pro, {total('n_con')} AS n_con, CAST(sum(n_unique_names) AS DOUBLE) AS u, CAST(sum(coalesce(blank, 0)) AS BIGINT) AS n_blank_org FROM grid LEFT JOIN org ON org.minute = minute_bucket, sizes GROUP BY ALL),
a1 AS (SELECT * EXCLUDE (u), CASE WHEN n_total > 0 THEN 1.0::DOUBLE - u / n_total ELSE 0.0::DOUBLE END AS dup_name_fraction_weighted, {ratio('n_pro', 'n_total')} AS pro_rate, {ratio('n_blank_org', 'n_total')} AS blank_org_rate, ln(1 + n_total) AS log_n_total FROM a0),
a2 AS (SELECT *, coalesce(log_n_total - lag(log_n_total) OVER o, 0.0) AS delta_log_n_total, coalesce(pro_rate - lag(pro_rate) OVER o, 0.0) AS delta_pro_rate FROM a1 WINDOW o AS (PARTITION BY bucket_minutes ORDER BY bucket_start)),
a3 AS (SELECT *, abs(delta_pro_rate) AS abs_delta_pro_rate, n_total >= 25 AS is_model_eligible, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM a2)"""
ORACLES["mv1_anomaly_features"] = rounded(FEATURES, "SELECT * FROM a3", f"dup_name_fraction_weighted pro_rate blank_org_rate log_n_total delta_log_n_total delta_pro_rate abs_delta_pro_rate {W}")
_F = ["log_n_total", "dup_name_fraction_weighted", "pro_rate", "blank_org_rate", "delta_log_n_total", "abs_delta_pro_rate"]
ORACLES["mv4_robust_features"] = rounded(
    f"{FEATURES}, q AS (SELECT bucket_minutes, {', '.join(f'quantile_cont({x}, 0.1) AS a_{x}, quantile_cont({x}, 0.5) AS b_{x}, quantile_cont({x}, 0.9) AS c_{x}' for x in _F)} FROM a3 WHERE is_model_eligible GROUP BY 1)",
    f"SELECT a3.bucket_minutes, bucket_start, {', '.join(f'(coalesce({x}, b_{x}) - b_{x}) / CASE WHEN c_{x} - a_{x} > 0 THEN c_{x} - a_{x} ELSE 1.0 END AS scaled_{x}' for x in _F)} FROM a3 JOIN q USING (bucket_minutes) WHERE is_model_eligible",
    " ".join(f"scaled_{x}" for x in _F),
)


def _share(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


ORACLES["co0_base_signals"] = rounded(
    f"{BASE}, g AS (SELECT minute_bucket, n_total, n_pro, n_con, CASE WHEN n_total > 0 THEN 1.0::DOUBLE - CAST(n_unique_names AS DOUBLE) / n_total ELSE 0.0::DOUBLE END AS dup_name_fraction, {ratio('n_pro', 'n_total')} AS pro_rate FROM grid)",
    f"SELECT *, {_share('n_total')} AS volume_percentile, {_share('dup_name_fraction')} AS dup_percentile FROM g",
    "dup_name_fraction pro_rate volume_percentile dup_percentile",
)

# report layer
_DEDUP = f"""{BASE}, one AS (SELECT sum(n_total)::DOUBLE AS n, sum(n_pro)::DOUBLE AS p, sum(n_con)::DOUBLE AS c, sum(n_unique_names)::DOUBLE AS u, sum(n_total_dedup)::DOUBLE AS nd, sum(n_pro_dedup)::DOUBLE AS pd, sum(n_con_dedup)::DOUBLE AS cd FROM grid),
m AS (SELECT 'total_submissions' AS metric, 'count' AS kind, n AS raw_value, nd AS exact_row_dedup_value FROM one UNION ALL SELECT 'pro_rate', 'rate', p / n, pd / nd FROM one UNION ALL SELECT 'con_rate', 'rate', c / n, cd / nd FROM one
  UNION ALL SELECT 'duplicate_name_fraction', 'rate', 1.0::DOUBLE - u / n, 0.0::DOUBLE FROM one),
d AS (SELECT *, exact_row_dedup_value - raw_value AS absolute_delta, CASE WHEN raw_value <> 0 THEN (exact_row_dedup_value - raw_value) / raw_value END AS relative_delta FROM m)"""
ORACLES["qu1_raw_vs_dedup_metrics"] = rounded(
    _DEDUP,
    "SELECT * EXCLUDE (kind), coalesce(CASE WHEN kind = 'count' THEN abs(absolute_delta) >= 5 AND abs(coalesce(relative_delta, 0)) >= 0.1 ELSE abs(absolute_delta) >= 0.03 END, false) AS material_change FROM d",
    "raw_value exact_row_dedup_value absolute_delta relative_delta",
)
_BINS = [("after_cutoff", "After cutoff", "m <= 0"), ("0_30m_before_cutoff", "0-30m before cutoff", "m > 0 AND m <= 30"), ("30_120m_before_cutoff", "30-120m before cutoff", "m > 30 AND m <= 120"), ("2h_24h_before_cutoff", "2h-24h before cutoff", "m > 120 AND m <= 1440"), ("over_24h_before_cutoff", ">24h before cutoff", "m > 1440")]
_TO_CUTOFF = f"{BASE}, mins AS (SELECT *, date_diff('minute', minute_bucket, TIMESTAMP '2024-01-29 12:00:00') AS m FROM grid)"
_BIN_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS deadline_window_key, '{v}' AS deadline_window, CAST(coalesce(sum(n_total), 0) AS BIGINT) AS n_total, CAST(coalesce(sum(n_pro), 0) AS BIGINT) AS n_pro, CAST(coalesce(sum(n_con), 0) AS BIGINT) AS n_con FROM mins WHERE {w}" for k, v, w in _BINS)
ORACLES["hc1_stance_by_deadline"] = rounded(
    _TO_CUTOFF,
    f"SELECT * EXCLUDE (pro_rate_wilson_half_width) FROM (SELECT *, {ratio('n_pro', 'n_total')} AS pro_rate, {ratio('n_con', 'n_total')} AS con_rate, n_total < 25 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')} FROM ({_BIN_ROWS}))",
    "pro_rate con_rate pro_rate_wilson_low pro_rate_wilson_high",
)
_RAMP = ", ".join(f"CAST(coalesce(sum(n_{x}) FILTER (m >= {a} AND m < {a + 60}), 0) AS BIGINT) AS {t}_{x[0]}" for t, a in (("recent", 0), ("prior", 60)) for x in ("total", "pro", "con"))
ORACLES["hc2_deadline_ramp_metrics"] = rounded(
    f"{_TO_CUTOFF}, r AS (SELECT {_RAMP} FROM mins)",
    f"""SELECT recent_t AS recent_n_total, prior_t AS prior_n_total, {', '.join(f"{ratio(f'{t}_p', f'{t}_t')} AS {t}_pro_rate, {ratio(f'{t}_c', f'{t}_t')} AS {t}_con_rate, {t}_t < 25 AS {t}_is_low_power" for t in ('recent', 'prior'))},
    {ratio('recent_t', 'prior_t')} AS ramp_ratio_recent_vs_prior, {ratio('recent_p', 'recent_t')} - {ratio('prior_p', 'prior_t')} AS pro_rate_delta_recent_minus_prior FROM r""",
    "recent_pro_rate recent_con_rate prior_pro_rate prior_con_rate ramp_ratio_recent_vs_prior pro_rate_delta_recent_minus_prior",
)
_METRICS = ("n_records", "pro_rate", "off_hours_ratio", "dup_name_fraction", "max_name_records")
_DAYS = f"""{RECORDS}, cells AS (SELECT strftime(t, '%Y-%m-%d') AS report_id, canonical_name, count(*) AS n, {PRO} AS p, count(*) FILTER (off) AS o FROM sub GROUP BY 1, 2),
vec AS (SELECT report_id, sum(n)::DOUBLE AS n_records, sum(p)::DOUBLE / sum(n) AS pro_rate, sum(o)::DOUBLE / sum(n) AS off_hours_ratio, 1.0::DOUBLE - count(*) / sum(n)::DOUBLE AS dup_name_fraction, max(n)::DOUBLE AS max_name_records FROM cells GROUP BY 1),
long AS ({' UNION ALL '.join(f"SELECT report_id, '{m}' AS metric, {m} AS value FROM vec" for m in _METRICS)})"""
ORACLES["fv1_day_vectors"] = rounded(_DAYS, "SELECT * FROM long", "value")
ORACLES["fv2_global_baselines"] = rounded(
    f"{_DAYS}, q AS (SELECT metric, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, count(*) AS n_reports FROM long GROUP BY 1)",
    "SELECT a.metric, report_id, value, (SELECT count(*) FILTER (b.value < a.value) + 0.5::DOUBLE * count(*) FILTER (b.value = a.value) FROM long b WHERE b.metric = a.metric) / n_reports AS percentile, p10, p50, p90, n_reports FROM long a JOIN q ON q.metric = a.metric",
    "value percentile p10 p50 p90",
)
ORACLES["fv2_name_cues"] = rounded(_DAYS, "SELECT canonical_name, count(*) AS n_reports, max(n) AS max_n FROM cells WHERE n > 1 GROUP BY 1")
ORACLES["ch2_burst_ratio_by_window"] = rounded(
    ROLL, f"SELECT window_minutes, count(*) AS n_windows, quantile_cont(r, 0.5) AS median_rate_ratio, max(r) AS max_rate_ratio FROM (SELECT window_minutes, {ratio('n_total', '(rate * window_minutes)')} AS r FROM roll, facts) GROUP BY 1", "median_rate_ratio max_rate_ratio"
)
ORACLES["ch5_day_slot_heat"] = rounded(
    f"{RECORDS}, cells AS (SELECT strftime(t, '%Y-%m-%d') AS date, CAST((hh * 60 + minute(t)) // 30 AS BIGINT) AS slot, count(*) AS n_total, {PRO} AS n_pro FROM sub GROUP BY 1, 2)",
    f"SELECT date, slot, n_total, n_pro, {ratio('n_pro', 'n_total')} AS pro_rate FROM (SELECT date, slot, coalesce(n_total, 0) AS n_total, coalesce(n_pro, 0) AS n_pro FROM (SELECT DISTINCT date FROM cells) x CROSS JOIN (SELECT CAST(unnest(range(0, 48)) AS BIGINT) AS slot) y LEFT JOIN cells USING (date, slot))",
    "pro_rate",
)
ORACLES["ch5_rolling_pro_rate"] = rounded(
    f"{RECORDS}, cells AS (SELECT {floor_to('t', '30')} AS bucket_start, count(*) AS n_total, {PRO} AS n_pro FROM sub GROUP BY 1)",
    "SELECT *, CAST(sum(n_pro) OVER w AS DOUBLE) / sum(n_total) OVER w AS rolling_pro_rate FROM cells WINDOW w AS (ORDER BY bucket_start ROWS 4 PRECEDING)",
    "rolling_pro_rate",
)

# registry linkage
REGISTRY = f"""{RECORDS}, people AS (SELECT DISTINCT upper(split_part(p_name, ' ', 2) || CAST(p_partkey % 25 AS VARCHAR)) AS last, upper(split_part(p_name, ' ', 1)) AS first FROM part WHERE p_size % 2 = 0)"""
ORACLES["vr9_exact_by_position"] = rounded(
    REGISTRY,
    f"SELECT *, {ratio('n_exact', 'n_total')} AS exact_rate FROM (SELECT pos AS position_normalized, count(*) AS n_total, count(*) FILTER (EXISTS (SELECT 1 FROM people p WHERE p.last = sub.last AND p.first = sub.first)) AS n_exact FROM sub GROUP BY 1)",
    "exact_rate",
)



def indel(a: str, b: str) -> str:
    """Percent of the letters of both texts that are in a longest common subsequence, row by row."""
    zeros = f"list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)"
    cell = f"CASE WHEN substr({b}, j, 1) = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END"
    line = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: list_append(acc, {cell}), [0::BIGINT])"
    common = f"list_reduce(string_split({a}, ''), lambda prev, ch: {line}, {zeros})[length({b}) + 1]"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * {common} / (length({a}) + length({b})) END"


def between(score: str, low: float, high: float, out_low: float, out_high: float) -> str:
    share = f"least(greatest(({score} - {low}::DOUBLE) / {high - low}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
    return f"({out_low}::DOUBLE + {share} * {out_high - out_low}::DOUBLE)"


STRONG, WEAK, GAP = 92.0, 84.0, 2.0
TIERS = ("exact", "strong_fuzzy", "weak_fuzzy", "unmatched")
LINKAGE = f"""{REGISTRY},
persons AS (SELECT canonical_name, min(last) AS last, min(first) AS first FROM sub WHERE canonical_name <> '|' GROUP BY 1),
known AS (SELECT persons.*, EXISTS (SELECT 1 FROM people p WHERE p.last || '|' || p.first = canonical_name) AS is_exact FROM persons),
pairs AS MATERIALIZED (SELECT DISTINCT known.first AS a, people.first AS b FROM known JOIN people USING (last) WHERE NOT is_exact),
ratios AS MATERIALIZED (SELECT a, b, {indel('a', 'b')} AS score FROM pairs),
scored AS (SELECT canonical_name, b AS candidate, score FROM known JOIN people USING (last) JOIN ratios ON a = known.first AND b = people.first WHERE NOT is_exact),
ranked AS (SELECT *, max(score) OVER (PARTITION BY canonical_name) AS top, row_number() OVER (PARTITION BY canonical_name ORDER BY score DESC, candidate DESC) AS rn FROM scored),
best AS (SELECT canonical_name, max(top) AS s, max(candidate) FILTER (rn = 1) AS candidate, count(*) FILTER (score >= top - {GAP}) AS n_close FROM ranked GROUP BY 1),
judged AS (SELECT *, coalesce(n_close > 1 AND s >= {WEAK}, FALSE) AS ambiguous FROM known LEFT JOIN best USING (canonical_name)),
assigned AS (
  SELECT canonical_name, last,
    CASE WHEN is_exact THEN 'exact' WHEN s >= {STRONG} AND NOT ambiguous THEN 'strong_fuzzy' WHEN s >= {WEAK} THEN 'weak_fuzzy' ELSE 'unmatched' END AS match_tier,
    CASE WHEN is_exact THEN 1.0::DOUBLE WHEN s >= {STRONG} AND NOT ambiguous THEN {between('s', STRONG, 100.0, 0.80, 0.95)} WHEN s >= {STRONG} THEN least(0.78::DOUBLE, {between('s', STRONG, 100.0, 0.80, 0.95)})
      WHEN s >= {WEAK} THEN least(0.78::DOUBLE, {between('s', WEAK, STRONG, 0.55, 0.79)}) ELSE 0.0::DOUBLE END AS match_confidence,
    CASE WHEN is_exact THEN canonical_name WHEN s >= {WEAK} THEN last || '|' || candidate END AS matched_name,
    CASE WHEN is_exact THEN '' WHEN s IS NULL THEN 'no_last_name_candidates' WHEN ambiguous THEN 'ambiguous_candidates' WHEN s < {WEAK} THEN 'below_threshold' ELSE 'fuzzy_match' END AS caveat
  FROM judged),
linked AS (
  SELECT minute, pos, canonical_name, n, coalesce(match_tier, 'unmatched') AS match_tier, coalesce(match_confidence, 0.0::DOUBLE) AS match_confidence, caveat, matched_name
  FROM (SELECT minute, pos, canonical_name, count(*) AS n FROM sub GROUP BY ALL) LEFT JOIN assigned USING (canonical_name))"""
ORACLES["vr0_assignments"] = rounded(LINKAGE, "SELECT * FROM assigned", "match_confidence")
TIER_SUMS = ", ".join([f"{total('n')} AS n_total", "CAST(coalesce(sum(n) FILTER (match_tier <> 'unmatched'), 0) AS BIGINT) AS n_matches", *(f"CAST(coalesce(sum(n) FILTER (match_tier = '{t}'), 0) AS BIGINT) AS n_{t}" for t in TIERS), "sum(n * match_confidence) AS expected_matches"])
MATCH_RATES = f"{ratio('n_matches', 'n_total')} AS match_rate, {ratio('expected_matches', 'n_total')} AS expected_match_rate, n_total < 30 AS is_low_power, {wilson('n_matches', 'n_total', 'match_rate')}"
MATCH_DOUBLES = "expected_matches match_rate expected_match_rate match_rate_wilson_low match_rate_wilson_high match_rate_wilson_half_width"
TWO_SIZES = SIZES.format("30, 240")
ORACLES["vr1_match_overview"] = rounded(
    LINKAGE,
    f"SELECT *, {MATCH_RATES}, (SELECT count(*) FROM assigned) AS n_unique_names, (SELECT count(*) FROM assigned WHERE match_tier <> 'unmatched') AS n_unique_matched, (SELECT count(*) FROM people) AS registry_rows FROM (SELECT {TIER_SUMS} FROM linked)",
    MATCH_DOUBLES,
)
ORACLES["vr2_match_by_position"] = rounded(LINKAGE, f"SELECT *, {MATCH_RATES} FROM (SELECT pos AS position_normalized, {TIER_SUMS} FROM linked GROUP BY 1)", MATCH_DOUBLES)
STANCES = ", ".join(
    f"CAST(coalesce(sum(n) FILTER (pos = '{s}'), 0) AS BIGINT) AS n_total_{s.lower()}, CAST(coalesce(sum(n) FILTER (pos = '{s}' AND match_tier <> 'unmatched'), 0) AS BIGINT) AS n_matches_{s.lower()}" for s in ("Pro", "Con")
)
ORACLES["vr3_match_by_bucket"] = rounded(
    f"{LINKAGE}, {TWO_SIZES}",
    f"SELECT *, {MATCH_RATES}, {ratio('n_matches_pro', 'n_total_pro')} AS match_rate_pro, {ratio('n_matches_con', 'n_total_con')} AS match_rate_con FROM (SELECT bucket_minutes, {floor_to('minute')} AS bucket_start, {TIER_SUMS}, {STANCES} FROM linked, sizes GROUP BY 1, 2)",
    f"{MATCH_DOUBLES} match_rate_pro match_rate_con",
)
ORACLES["vr4_match_by_bucket_position"] = rounded(
    f"{LINKAGE}, {TWO_SIZES}", f"SELECT *, {MATCH_RATES} FROM (SELECT bucket_minutes, {floor_to('minute')} AS bucket_start, pos AS position_normalized, {TIER_SUMS} FROM linked, sizes GROUP BY 1, 2, 3)", MATCH_DOUBLES
)
NAME_TIERS = f"{LINKAGE}, tiers AS (SELECT canonical_name, match_tier, match_confidence, matched_name, caveat, {total('n')} AS n FROM linked GROUP BY ALL)"
ORACLES["vr5_matched_names"] = rounded(NAME_TIERS, "SELECT * FROM tiers WHERE match_tier <> 'unmatched' ORDER BY n DESC, canonical_name LIMIT 500", "match_confidence")
ORACLES["vr6_unmatched_names"] = rounded(NAME_TIERS, "SELECT canonical_name, n, caveat FROM tiers WHERE match_tier = 'unmatched' ORDER BY n DESC, canonical_name LIMIT 500")
ORDERED_TIERS = ", ".join(f"('{t}', {i}::BIGINT)" for i, t in enumerate(TIERS))
ORACLES["vr7_match_tier_summary"] = rounded(
    LINKAGE,
    f"""SELECT *, {ratio('n_records', 'sum(n_records) OVER ()')} AS share FROM (
      SELECT match_tier, tier_order, coalesce(n_records, 0) AS n_records, coalesce(n_names, 0) AS n_names, mean_confidence FROM (VALUES {ORDERED_TIERS}) o(match_tier, tier_order)
      LEFT JOIN (SELECT match_tier, {total('n')} AS n_records, count(DISTINCT canonical_name) AS n_names, {ratio('sum(n * match_confidence)', 'sum(n)')} AS mean_confidence FROM linked GROUP BY 1) USING (match_tier))""",
    "mean_confidence share",
)
ORACLES["vr8_match_uncertainty_summary"] = rounded(
    NAME_TIERS,
    f"""SELECT caveat, count(*) AS n_names, {total('n')} AS n_records FROM tiers WHERE caveat <> '' GROUP BY 1
      UNION ALL SELECT 'none_detected', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM tiers WHERE caveat <> '')""",
)

# near-duplicate names
SPLIT_BOTH = """sets AS (SELECT *, list_sort(list_filter(xs, lambda w: list_contains(ys, w))) AS common, list_sort(list_filter(xs, lambda w: NOT list_contains(ys, w))) AS l, list_sort(list_filter(ys, lambda w: NOT list_contains(xs, w))) AS r
  FROM (SELECT *, list_distinct(list_filter(string_split(x, ' '), lambda w: w <> '')) AS xs, list_distinct(list_filter(string_split(y, ' '), lambda w: w <> '')) AS ys FROM compared)),
joined AS (SELECT *, array_to_string(common, ' ') AS b, trim(array_to_string(common, ' ') || ' ' || array_to_string(l, ' ')) AS one, trim(array_to_string(common, ' ') || ' ' || array_to_string(r, ' ')) AS two FROM sets)"""
EDGES = f"""{RECORDS},
persons AS (SELECT canonical_name, min(name_display) AS name_display, upper(left(min(last), 4) || '|' || left(min(first), 1)) AS block_key FROM sub GROUP BY 1),
compared AS (
  SELECT a.block_key, a.canonical_name AS left_name, b.canonical_name AS right_name, a.name_display AS x, b.name_display AS y FROM persons a JOIN persons b ON a.block_key = b.block_key AND a.canonical_name < b.canonical_name),
{SPLIT_BOTH},
edges AS MATERIALIZED (
  SELECT block_key, left_name, right_name, CAST(floor(CASE WHEN len(xs) = 0 OR len(ys) = 0 THEN 0.0::DOUBLE WHEN len(common) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 100.0::DOUBLE
    WHEN len(common) = 0 THEN {indel('one', 'two')} ELSE greatest({indel('one', 'two')}, {indel('b', 'one')}, {indel('b', 'two')}) END) AS BIGINT) AS similarity FROM joined)"""
ORACLES["dn3_similarity_edges"] = rounded(EDGES, "SELECT * FROM edges WHERE similarity >= 92")
MEMBERS = f"""{EDGES}, {NAMES},
near AS MATERIALIZED (SELECT left_name AS a, right_name AS b FROM edges WHERE similarity >= 92 UNION SELECT right_name, left_name FROM edges WHERE similarity >= 92),
reach AS (SELECT a AS node, a AS other FROM near UNION SELECT node, b FROM reach JOIN near ON other = a),
roots AS (SELECT node AS canonical_name, min(other) AS root FROM reach GROUP BY 1),
clusters AS (SELECT root, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, root) AS VARCHAR), 4, '0') AS cluster_id FROM roots GROUP BY root),
members AS (SELECT canonical_name, n AS n_records, first_seen, last_seen, n_pro, n_con, display_name, cluster_id FROM roots JOIN clusters USING (root) JOIN names USING (canonical_name)),
times AS (
  SELECT *, CAST(n_records AS DOUBLE) / sum(n_records) OVER (PARTITION BY cluster_id) AS bucket_fraction
  FROM (SELECT cluster_id, minute AS minute_bucket, count(*) AS n_records, {PRO} AS n_pro, {CON} AS n_con FROM members JOIN sub USING (canonical_name) GROUP BY 1, 2)),
peaks AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY bucket_fraction DESC, n_records DESC, minute_bucket) AS rn FROM times),
concentration AS (
  SELECT cluster_id, count(*) AS n_active_buckets, sum(bucket_fraction * bucket_fraction) AS concentration_hhi, max(minute_bucket) FILTER (rn = 1) AS peak_bucket, max(bucket_fraction) FILTER (rn = 1) AS peak_fraction, max(n_records) FILTER (rn = 1) AS peak_records
  FROM peaks GROUP BY 1)"""


def recursive(ctes: str, select: str, doubles: str = "") -> str:
    return rounded(ctes, select, doubles).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["dn4_cluster_members"] = recursive(MEMBERS, "SELECT * FROM members")
ORACLES["dn6_cluster_time_concentration"] = recursive(MEMBERS, "SELECT * FROM times", "bucket_fraction")
ORACLES["dn7_cluster_time_concentration_summary"] = recursive(MEMBERS, "SELECT * FROM concentration", "concentration_hhi peak_fraction")
ORACLES["dn5_cluster_summary"] = recursive(
    MEMBERS,
    f"""SELECT *, date_diff('microsecond', first_seen, last_seen) / 60000000.0::DOUBLE AS time_span_minutes FROM (
      SELECT cluster_id, count(*) AS cluster_size, {total('n_records')} AS n_records, {total('n_pro')} AS n_pro, {total('n_con')} AS n_con, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
        array_to_string(list_sort(list_distinct(list(display_name)))[1:10], ' | ') AS names_preview FROM members GROUP BY 1)
      JOIN concentration USING (cluster_id)""",
    "concentration_hhi peak_fraction time_span_minutes",
)
ORACLES["ch3_cluster_size_histogram"] = recursive(MEMBERS, "SELECT cluster_size, count(*) AS n_clusters FROM (SELECT cluster_id, count(*) AS cluster_size FROM members GROUP BY 1) GROUP BY 1")

# the upper tail of chi-squared with 59 degrees of freedom, from the series of the lower incomplete gamma function
ORACLES["pe6_clockface_test"] = rounded(
    f"{RECORDS}, face AS (SELECT m, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 60)) AS m) LEFT JOIN (SELECT minute(t) AS m, count(*) AS n FROM sub GROUP BY 1) USING (m)), stat AS (SELECT sum((n - e) * (n - e) / e) AS chi_square FROM face, (SELECT count(*) / 60.0::DOUBLE AS e FROM sub))",
    "SELECT chi_square, greatest(1.0::DOUBLE - (SELECT sum(exp((29.5::DOUBLE + k) * ln(chi_square / 2.0::DOUBLE) - chi_square / 2.0::DOUBLE - lgamma(30.5::DOUBLE + k))) FROM range(0, 4000) r(k)), 0.0::DOUBLE) AS p_value FROM stat",
    "chi_square p_value",
)

ORACLES["tr10_lens_comparison"] = rounded(
    f"{RECORDS}, {SEEN}",
    f"""SELECT *, n_total_dedup - n_total AS delta_n_total, pro_rate_dedup - pro_rate_raw AS delta_pro_rate FROM (SELECT seen.minute AS minute_bucket, n_total, n_total_dedup, {ratio('n_pro', 'n_total')} AS pro_rate_raw, {ratio('n_pro_dedup', 'n_total_dedup')} AS pro_rate_dedup FROM seen JOIN kept USING (minute))""",
    "pro_rate_raw pro_rate_dedup delta_pro_rate",
)
ORACLES["hc3_hearing_markers"] = rounded(RECORDS, "SELECT 'sign_in_cutoff' AS marker, TIMESTAMP '2024-01-29 12:00:00' AS marker_time, count(*) AS n_before FROM sub WHERE minute <= TIMESTAMP '2024-01-29 12:00:00'")


# tails and q values in SQL -------------------------------------------------------------------------


def poisson_tail(k: str, mean: str) -> str:
    """P(X >= k): one less the terms below k."""
    return f"CASE WHEN {k} <= 0 THEN 1.0::DOUBLE WHEN {mean} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_transform(range(0, {k}), lambda i: exp(i * ln({mean}) - {mean} - lgamma(i + 1))))) END"


def normal_tails(z: str) -> str:
    """Two-sided normal p: one less the error function, by its series of positive terms."""
    x2 = f"({z} * {z} / 2.0::DOUBLE)"
    series = f"list_sum(list_transform(range(0, 160), lambda n: exp(n * ln(4.0::DOUBLE * {x2}) + lgamma(n + 1) - lgamma(2 * n + 2))))"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} = 0 THEN 1.0::DOUBLE WHEN abs({z}) > 7 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE / sqrt(pi()) * exp(-{x2}) * sqrt({x2}) * {series}) END"


# the null distribution of Kendall's S: shares of orders by inversions, n things after n - 1
_ORDERING_P = f"""{ORDERING.replace("WITH ", "")},
inversions AS (SELECT 1 AS n, [1.0::DOUBLE] AS shares UNION ALL SELECT n + 1, list_transform(range(0, len(shares) + n), lambda c: list_sum(shares[greatest(c - n, 0) + 1:c + 1]) / (n + 1)) FROM inversions WHERE n < 33),
tied AS (SELECT bucket_minutes, bucket_start, sum(k * (k - 1) * (2 * k + 5)) AS y FROM (SELECT bucket_minutes, bucket_start, x, count(*) AS k FROM placed GROUP BY 1, 2, 3) GROUP BY 1, 2),
judged AS (SELECT ordering.*, ties, least(n_records * (n_records - 1) // 2 - s, n_records * (n_records - 1) // 2 + s) // 2 AS few, n_records * (n_records - 1) // 2 - ties AS untied, CASE WHEN n_records * (n_records - 1) * (2 * n_records + 5) > y THEN s / sqrt((n_records * (n_records - 1) * (2 * n_records + 5) - y) / 18.0::DOUBLE) END AS z
  FROM ordering JOIN signs USING (bucket_minutes, bucket_start) JOIN tied USING (bucket_minutes, bucket_start)),
tested AS (SELECT judged.* EXCLUDE (ties, few, untied, z), abs(kendall_tau) AS abs_kendall_tau, CASE WHEN untied = 0 THEN 1.0::DOUBLE WHEN ties = 0 AND n_records <= 33 THEN least(1.0::DOUBLE, 2.0::DOUBLE * list_sum(shares[1:CAST(few AS BIGINT) + 1])) WHEN ties = 0 AND few <= 1 THEN 0.0::DOUBLE ELSE coalesce({normal_tails('z')}, 1.0::DOUBLE) END AS kendall_p_value
  FROM judged LEFT JOIN inversions ON n = n_records)"""
ORACLES["so2_bucket_ordering"] = recursive(_ORDERING_P, "SELECT * FROM tested", "kendall_tau abs_kendall_tau kendall_p_value")
ORACLES["so4_minute_ordering"] = recursive(_ORDERING_P, "SELECT * FROM tested WHERE bucket_minutes = 1", "kendall_tau abs_kendall_tau kendall_p_value")


def q_values(source: str, p: str, q: str, partition: str = "", tested: str = "true") -> str:
    """The source with Benjamini-Hochberg q values over the tested rows of each partition."""
    by = f"PARTITION BY {partition + ', ' if partition else ''}({tested}) AND {p} IS NOT NULL"
    ranked = f"SELECT *, row_number() OVER ({by} ORDER BY {p}) AS r_, count(*) OVER ({by}) AS m_ FROM {source}"
    return f"SELECT * EXCLUDE (r_, m_), CASE WHEN ({tested}) AND {p} IS NOT NULL THEN least(1.0::DOUBLE, min({p} * m_ / r_) OVER ({by} ORDER BY r_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {q} FROM ({ranked})"


_BU = f"""{ROLL}, bu AS (SELECT window_minutes, start_minute, end_minute, n_total AS observed_count, n_pro, n_con, overall AS overall_pro_rate, rate * window_minutes AS expected_count, {ratio('n_total', '(rate * window_minutes)')} AS rate_ratio, {ratio('n_pro', 'n_total')} AS pro_rate,
    n_total < 30 AS is_low_power, {ratio('n_pro', 'n_total')} - overall AS delta_pro_rate, abs({ratio('n_pro', 'n_total')} - overall) AS abs_delta_pro_rate, {wilson('n_pro', 'n_total', 'pro_rate')} FROM roll, facts),
tails AS (SELECT DISTINCT observed_count AS oc, window_minutes AS wm, {poisson_tail('observed_count', 'expected_count')} AS p_value FROM bu),
bt AS ({q_values('(SELECT bu.*, p_value FROM bu JOIN tails ON oc = observed_count AND wm = window_minutes)', 'p_value', 'q_value')})"""
_BD = f"overall_pro_rate expected_count rate_ratio pro_rate delta_pro_rate abs_delta_pro_rate p_value q_value {W}"
ORACLES["bu1_burst_window_tests"] = rounded(_BU, "SELECT *, q_value <= 0.01::DOUBLE AS is_significant FROM bt", _BD)
ORACLES["bu2_burst_significant_windows"] = rounded(_BU, "SELECT *, true AS is_significant FROM bt WHERE q_value <= 0.01::DOUBLE", _BD)
_SW = f"""{ROLL}, sw AS (SELECT *, abs(delta_pro_rate) AS abs_delta_pro_rate, delta_pro_rate / sqrt(baseline_pro_rate * (1.0::DOUBLE - baseline_pro_rate) / n_total) AS z_score, CASE WHEN delta_pro_rate >= 0 THEN 'pro_heavy' ELSE 'con_heavy' END AS direction, n_total < 30 AS is_low_power, {wilson('n_pro', 'n_total', 'pro_rate')}
    FROM (SELECT window_minutes, start_minute, end_minute, n_total, n_pro, CAST(n_pro AS DOUBLE) / n_total AS pro_rate, {_BASELINE} AS baseline_pro_rate, CAST(n_pro AS DOUBLE) / n_total - {_BASELINE} AS delta_pro_rate FROM roll, facts WHERE n_total >= 25)),
st AS ({q_values(f"(SELECT *, {normal_tails('z_score')} AS p_value FROM sw)", 'p_value', 'q_value')})"""
_SD = f"pro_rate baseline_pro_rate delta_pro_rate abs_delta_pro_rate z_score p_value q_value {W}"
ORACLES["ps1_swing_window_tests"] = rounded(_SW, "SELECT *, q_value <= 0.01::DOUBLE AS is_significant FROM st", _SD)
ORACLES["ps2_swing_significant_windows"] = rounded(_SW, "SELECT *, true AS is_significant FROM st WHERE q_value <= 0.01::DOUBLE", _SD)


def _tested(source: str) -> str:
    p = f"CASE WHEN n_total > 0 THEN {normal_tails('z_score')} ELSE 1.0::DOUBLE END"
    return q_values(f"(SELECT *, {p} AS p_value FROM {source})", "p_value", "q_value", "bucket_minutes")


_FLAG = "q_value <= 0.01::DOUBLE AS is_significant, outside_stable_range AND (q_value <= 0.01::DOUBLE OR coalesce(abs_delta_pro_rate >= greatest(0.10::DOUBLE, stable_half_width), false)) AS is_flagged"
ORACLES["ps5_time_bucket_profiles"] = rounded(f"{SWING}, tt AS ({_tested('tb')})", f"SELECT *, {_FLAG} FROM tt", f"{_ED} p_value q_value")
ORACLES["ps6_time_of_day_bucket_profiles"] = rounded(f"{SWING}, tt AS ({_tested('td')})", f"SELECT *, {_LABEL} AS slot_start, {_FLAG} FROM tt", f"{_ED} p_value q_value")

_PMF = "exp(lgamma(n_known + 1) - lgamma(i + 1) - lgamma(n_known - i + 1) + i * ln(e_) + (n_known - i) * ln(1.0::DOUBLE - e_))"


def _binomial(low: str, high: str) -> str:
    return f"least(1.0::DOUBLE, coalesce(list_sum(list_transform(range({low}, {high}), lambda i: {_PMF})), 0.0::DOUBLE))"


_AT = _PMF.replace("(i + 1)", "(n_pro + 1)").replace("n_known - i", "n_known - n_pro").replace("+ i *", "+ n_pro *")
_TWO = f"least(1.0::DOUBLE, list_sum(list_transform(range(0, n_known + 1), lambda i: CASE WHEN {_PMF} <= {_AT} * 1.0000001::DOUBLE THEN {_PMF} ELSE 0.0::DOUBLE END)))"
_EXACT = f"""SELECT DISTINCT n_pro AS k_, n_known AS n_, e_, {_binomial('0', 'n_pro + 1')} AS p_lower_day, {_binomial('n_pro', 'n_known + 1')} AS p_upper_day, {_TWO} AS p_two_sided_day
  FROM (SELECT n_pro, n_known, expected_pro_rate_day AS e_ FROM w4 WHERE n_known > 0)"""
_DAY = "(SELECT w4.*, p_lower_day, p_upper_day, p_two_sided_day FROM w4 LEFT JOIN exact ON k_ = n_pro AND n_ = n_known AND e_ = expected_pro_rate_day)"
for _tail in ("lower", "upper", "two_sided"):
    _DAY = f"({q_values(_DAY, f'p_{_tail}_day', f'q_{_tail}_day', 'bucket_minutes', 'is_eligible')})"
ORACLES["oh5_day_alerts"] = rounded(
    f"{OFF}, exact AS ({_EXACT})",
    f"SELECT *, is_tested AND is_eligible AND is_below_998_day AND coalesce(q_lower_day <= 0.05::DOUBLE, false) AND is_material_lower_day AS is_alert_day FROM {_DAY}",
    _OD + " " + " ".join(f"{k}_{t}_day" for k in "pq" for t in ("lower", "upper", "two_sided")),
)

_SLOTS = f"""{SWING}, d0 AS (SELECT db.*, {_LABEL.replace('slot', 'db.slot').replace('bucket_minutes', 'db.bucket_minutes')} AS slot_start, td.pro_rate AS slot_expected_pro_rate, td.stable_half_width AS slot_half_width, db.pro_rate - td.pro_rate AS slot_delta_pro_rate,
    coalesce(CASE WHEN db.n_total > 0 AND sqrt(td.pro_rate * (1.0::DOUBLE - td.pro_rate) / db.n_total) > 0 THEN (db.pro_rate - td.pro_rate) / sqrt(td.pro_rate * (1.0::DOUBLE - td.pro_rate) / db.n_total) ELSE 0.0 END, 0.0) AS slot_z_score
    FROM db LEFT JOIN td ON td.bucket_minutes = db.bucket_minutes AND td.slot = db.slot),
d1 AS (SELECT *, {_FLAG}, CASE WHEN n_total > 0 THEN {normal_tails('slot_z_score')} ELSE 1.0::DOUBLE END AS slot_p_value FROM ({_tested('d0')})),
d2 AS ({q_values('d1', 'slot_p_value', 'slot_q_value', 'bucket_minutes')})"""
ORACLES["ps7_day_bucket_profiles"] = rounded(
    _SLOTS,
    "SELECT *, slot_q_value <= 0.01::DOUBLE AND coalesce(abs(slot_delta_pro_rate) >= greatest(0.10::DOUBLE, slot_half_width), false) AND NOT is_low_power AS is_slot_outlier FROM d2",
    f"{_ED} slot_expected_pro_rate slot_half_width slot_delta_pro_rate slot_z_score p_value q_value slot_p_value slot_q_value",
)
ORACLES["bu7_burst_summary"] = rounded(
    _BU,
    """SELECT count(*) AS n_tests, count(*) FILTER (q_value <= 0.01) AS n_significant_windows, max(rate_ratio) FILTER (q_value <= 0.01) AS max_rate_ratio, min(q_value) AS min_q_value,
    count(*) FILTER (q_value <= 0.01 AND abs_delta_pro_rate >= greatest(0.10, coalesce((SELECT quantile_cont(abs_delta_pro_rate, 0.5) FROM bt WHERE q_value <= 0.01), 0.0))) AS n_composition_shifts FROM bt""",
    "max_rate_ratio min_q_value",
)
ORACLES["ch2_burst_significance_by_window"] = rounded(_BU, "SELECT window_minutes, count(*) AS n_windows, count(*) FILTER (q_value <= 0.01) AS n_significant, quantile_cont(rate_ratio, 0.5) AS median_rate_ratio FROM bt GROUP BY 1", "median_rate_ratio")
_CHECKS = [("unknown_positions", "CAST(u AS DOUBLE) / n", "0.1"), ("missing_names", "CAST(m AS DOUBLE) / n", "0.05"), ("duplicate_ids", "CAST(d AS DOUBLE) / n", "0.01"), ("non_monotonic_timestamps", "CAST(b AS DOUBLE)", "1.0"), ("blank_organization_spikes", "CAST(s AS DOUBLE)", "1.0")]
ORACLES["qu2_data_quality_warnings"] = rounded(
    f"""{BLANKS}, middles AS (SELECT bucket_minutes, quantile_cont(blank_org_rate, 0.5) AS middle FROM blanks WHERE n_total >= 25 GROUP BY 1),
    one AS (SELECT count(*) AS n, {UNKNOWN} AS u, count(*) FILTER (trim(name) = '') AS m, (SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM sub GROUP BY id) WHERE k > 1) AS d,
      (SELECT count(*) FILTER (t < before) FROM (SELECT t, lag(t) OVER (ORDER BY id, t) AS before FROM sub)) AS b,
      (SELECT count(*) FILTER (blank_org_rate >= greatest(0.35::DOUBLE, middle + 0.15::DOUBLE)) FROM blanks JOIN middles USING (bucket_minutes) WHERE n_total >= 25) AS s FROM sub)""",
    " UNION ALL ".join(f"SELECT '{k}' AS warning, {x} AS observed, {limit}::DOUBLE AS threshold, {x} >= {limit}::DOUBLE AS is_raised FROM one" for k, x, limit in _CHECKS),
    "observed threshold",
)
_DAY_HOUR = f"{ROLL}, cells AS (SELECT d AS day_of_week, h AS hour, coalesce(r, rate) AS rate_per_minute FROM (SELECT CAST(unnest(range(0, 7)) AS BIGINT) AS d), (SELECT CAST(unnest(range(0, 24)) AS BIGINT) AS h) LEFT JOIN (SELECT isodow(minute_bucket) - 1 AS a, hour(minute_bucket) AS b, avg(n_total) AS r FROM grid GROUP BY 1, 2) ON a = d AND b = h, facts)"
ORACLES["bu6_day_hour_rates"] = rounded(_DAY_HOUR, "SELECT * FROM cells", "rate_per_minute")
_TIMES = {"sign_in_open": "2024-01-02 09:00:00", "sign_in_cutoff": "2024-01-29 12:00:00", "meeting_start": "2024-01-29 13:30:00", "written_testimony_deadline": "2024-01-30 13:30:00"}
ORACLES["hc3_process_markers"] = rounded(RECORDS, " UNION ALL ".join(f"SELECT '{k}' AS marker, TIMESTAMP '{t}' AS marker_time, count(*) FILTER (minute <= TIMESTAMP '{t}') AS n_before FROM sub" for k, t in _TIMES.items()))
ORACLES["n9_hearing_minutes"] = rounded(
    RECORDS,
    f"""SELECT id, date_diff('microsecond', t, TIMESTAMP '{_TIMES["sign_in_cutoff"]}') / 60000000.0::DOUBLE AS minutes_to_cutoff, date_diff('microsecond', TIMESTAMP '{_TIMES["sign_in_open"]}', t) / 60000000.0::DOUBLE AS minutes_since_sign_in_open,
    date_diff('microsecond', TIMESTAMP '{_TIMES["meeting_start"]}', t) / 60000000.0::DOUBLE AS minutes_since_meeting_start FROM sub""",
    "minutes_to_cutoff minutes_since_sign_in_open minutes_since_meeting_start",
)
