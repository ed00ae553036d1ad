"""DuckDB SQL of those operators that SQL can express on whole tables: fingerprints, leaks, SimHash, repeated passages.

The statements define results from first principles (every window, every diagonal, every pair of
fingerprints, XXH64 in integer arithmetic) and share no step with the operators beyond constants.
"""

from __future__ import annotations

from hustings.llm import fingerprints

MASK = "18446744073709551615::UHUGEINT"
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
CAPITALS = "".join(map(chr, range(0x41, 0x5B)))
LATIN = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
WHITE = r" \t\n\x0B\f\r"
PUNCTUATION = r"\x01-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
LONE = "\\x{3040}-\\x{9FFF}\\x{E00}-\\x{EFF}\\x{1000}-\\x{10BF}\\x{1780}-\\x{17FF}"


def lowered(text: str, latin: bool = True) -> str:
    capitals = CAPITALS + (LATIN if latin else "")
    return f"translate(coalesce({text}, ''), '{capitals}', '{capitals.lower()}')"


def rotated(x: str, r: int) -> str:
    return f"((({x}) << {r}) | (({x}) >> {64 - r})) & {MASK}"


def times(x: str, y: str) -> str:
    return f"((({x}) * {y}) & {MASK})"


def turned(acc: str, lane: str) -> str:
    """One round: rotate(acc + lane * P2, 31) * P1."""
    return times(rotated(f"({acc} + {times(lane, P2)}) & {MASK}", 31), P1)


def avalanche(h: str) -> list[str]:
    """Steps from h to the final value, each an expression over the one before."""
    return [times(f"xor({h}, {h} >> 33)", P2), times(f"xor({h}, {h} >> 29)", P3), f"xor({h}, {h} >> 32)"]


def chain(source: str, keep: str, name: str, steps: list[str]) -> str:
    """Nested selects that replace column `name` step by step."""
    for step in steps:
        source = f"SELECT {keep}, ({step}) AS {name} FROM ({source})"
    return source


def xxh64(table: str, column: str, seed: int = 42) -> str:
    """A SELECT of (column, h) with the XXH64 of each text of the table, whatever its length."""
    lane = lambda at, n: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * b + 1}, 2)" for b in reversed(range(n))) + ")::UHUGEINT"
    start = [(seed + int(P1.split(":")[0]) + int(P2.split(":")[0])) % 2**64, (seed + int(P2.split(":")[0])) % 2**64, seed, (seed - int(P1.split(":")[0])) % 2**64]
    lanes = [f"list_reduce(list_transform(range(0, n // 32), lambda q: eights[4 * q + {k + 1}]), lambda a, v: {turned('a', 'v')}, {s}::UHUGEINT)" for k, s in enumerate(start)]
    merged = "(" + " + ".join(f"({rotated(f'v{k}', r)})" for k, r in zip((1, 2, 3, 4), (1, 7, 12, 18))) + f") & {MASK}"
    for k in (1, 2, 3, 4):
        merged = f"({times(f'xor({merged}, {turned("0::UHUGEINT", f"v{k}")})', P1)} + {P4}) & {MASK}"
    steps = [
        f"((CASE WHEN n >= 32 THEN {merged} ELSE {(seed + int(P5.split(':')[0])) % 2**64}::UHUGEINT END) + n::UHUGEINT) & {MASK}",
        f"list_reduce(eights[4 * (n // 32) + 1:], lambda a, v: ({times(rotated(f'xor(a, {turned("0::UHUGEINT", "v")})', 27), P1)} + {P4}) & {MASK}, h)",
        f"CASE WHEN n % 8 >= 4 THEN ({times(rotated(f'xor(h, {times(lane("n - n % 8", 4), P1)})', 23), P2)} + {P3}) & {MASK} ELSE h END",
        f"list_reduce(list_transform(range(n - n % 4, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UHUGEINT), lambda a, b: {times(rotated(f'xor(a, {times("b", P5)})', 11), P1)}, h)",
        *avalanche("h"),
    ]
    eights = f"SELECT {column}, hex({column}) AS x, strlen({column}) AS n, list_transform(range(0, strlen({column}) // 8), lambda j: {lane('8 * j', 8)}) AS eights FROM (SELECT {column}, hex({column}) AS x FROM {table})"
    rows = f"SELECT *, {', '.join(f'{e} AS v{k}' for k, e in enumerate(lanes, 1))} FROM ({eights})"
    rows = f"SELECT {column}, x, n, eights, ({steps[0]}) AS h FROM ({rows})"
    return chain(rows, f"{column}, x, n, eights", "h", steps[1:])


def _document_fingerprints(k: int = fingerprints.GRAM, window: int = fingerprints.WINDOW) -> str:
    half, low = k // 2, (1 << 31) - 1
    grams = f"(digit * {fingerprints.BASE} + lead(digit, {half}) OVER w) % {fingerprints.PRIME}"
    step = f"(({times(rotated(f'xor({(42 + 2870177450012600261 + half) % 2**64}::UHUGEINT, {turned("0::UHUGEINT", "v8::UHUGEINT")})', 27), P1)}) + {P4}) & {MASK}"
    digits = chain(f"SELECT r, i, n, ({step}) AS h FROM eights", "r, i, n", "h", avalanche("h"))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, count(*) OVER () AS total FROM documents),
pairs AS (SELECT a.doc_id, a.k, a.t, b.k AS next_k, b.t AS next_t, length(a.t) AS n_chars FROM docs a JOIN docs b ON b.k = a.k % a.total + 1),
edits AS MATERIALIZED (SELECT *, left(t, n_chars - n_chars // 4) || left(next_t, n_chars // 4) AS edited FROM pairs),
texts AS (SELECT 2 * k AS r, t FROM edits UNION ALL SELECT 2 * k + 1, edited FROM edits),
raw AS (SELECT r, strlen(t) AS n, unnest(list_transform(regexp_extract_all(hex(t), '..'), lambda b: ('0x' || b)::UBIGINT)) AS b, unnest(range(0, strlen(t))) AS i FROM texts),
twos AS (SELECT r, i, n, b + 256 * lead(b, 1) OVER w AS v2 FROM raw WINDOW w AS (PARTITION BY r ORDER BY i)),
fours AS (SELECT r, i, n, v2 + 65536 * lead(v2, 2) OVER w AS v4 FROM twos WINDOW w AS (PARTITION BY r ORDER BY i)),
eights AS (SELECT r, i, n, v4 + 4294967296::UHUGEINT * lead(v4, 4) OVER w AS v8 FROM fours WINDOW w AS (PARTITION BY r ORDER BY i) QUALIFY v8 IS NOT NULL),
digits AS (SELECT r, i, n, (h & {low}::UHUGEINT)::BIGINT AS digit FROM ({digits})),
grams AS (SELECT r, i, n, {grams} AS g FROM digits WINDOW w AS (PARTITION BY r ORDER BY i) QUALIFY g IS NOT NULL),
short AS (SELECT r, (h & {low}::UHUGEINT)::BIGINT % {fingerprints.PRIME} AS g, t FROM texts JOIN ({xxh64(f"(SELECT DISTINCT t FROM texts WHERE strlen(t) BETWEEN 1 AND {k - 1})", "t")}) USING (t)),
minima AS (
  SELECT r, i, n, min(g * 2147483648 + ({low} - i)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS m FROM grams
),
choices AS MATERIALIZED (
  SELECT DISTINCT r, m // 2147483648 AS g, {low} - m % 2147483648 AS p FROM minima WHERE i <= greatest(n - {k + window - 1}, 0)
  UNION SELECT r, g, 0 FROM short
),
written AS MATERIALIZED (SELECT r, string_agg(g || ':' || p, ',' ORDER BY p) AS f FROM choices GROUP BY r),
hashed AS MATERIALIZED (SELECT DISTINCT r, g FROM choices),
sizes AS (SELECT r, count(*) AS n FROM hashed GROUP BY r),
wanted AS (SELECT 2 * k AS a, 2 * k + 1 AS b FROM edits UNION SELECT 2 * k, 2 * next_k FROM edits),
shared AS (SELECT a, b, count(*) AS n FROM wanted JOIN hashed x ON x.r = a JOIN hashed y ON y.r = b AND x.g = y.g GROUP BY a, b),
near AS (
  SELECT a, b, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(s.n, 0)::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(s.n, 0)) END AS share
  FROM wanted LEFT JOIN sizes x ON x.r = a LEFT JOIN sizes y ON y.r = b LEFT JOIN shared s USING (a, b)
)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, coalesce(f.f, '') AS fingerprint, coalesce(e.f, '') AS edited_fingerprint, x.share AS near_edited, y.share AS near_next
FROM edits LEFT JOIN written f ON f.r = 2 * k LEFT JOIN written e ON e.r = 2 * k + 1 JOIN near x ON x.a = 2 * k AND x.b = 2 * k + 1 JOIN near y ON y.a = 2 * k AND y.b = 2 * next_k
"""


def _benchmark_decontamination() -> str:
    word = f"[{LONE}]|[^{PUNCTUATION}{LONE}]+"
    tokens = lambda text: f"regexp_extract_all({lowered(text)}, '[{PUNCTUATION}]*(?:{word})')"
    bare = f"regexp_replace(token, '^[{PUNCTUATION}]+', '')"
    leads = ", ".join(f"lead(word, {j}) OVER w AS w{j}" for j in (1, 2, 3))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {tokens("text")} AS tokens FROM documents),
items AS (SELECT row_number() OVER () AS k, item_id, {tokens("text")} AS tokens FROM benchmark),
doc_tokens AS (SELECT r, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS p FROM docs),
words AS MATERIALIZED (SELECT r, p, {bare} AS word, sum(strlen(token)) OVER (PARTITION BY r ORDER BY p) AS e, token FROM doc_tokens),
item_words AS MATERIALIZED (SELECT k, j, {bare} AS word, n FROM (SELECT k, len(tokens) AS n, unnest(tokens) AS token, unnest(range(0, len(tokens))) AS j FROM items)),
doc_seeds AS (SELECT r, p, word, {leads} FROM words WINDOW w AS (PARTITION BY r ORDER BY p)),
item_seeds AS (SELECT k, j, n, word, {leads} FROM item_words WINDOW w AS (PARTITION BY k ORDER BY j)),
diagonals AS MATERIALIZED (
  SELECT r, k, n, p - j AS delta FROM doc_seeds d JOIN item_seeds i ON d.word = i.word AND d.w1 = i.w1 AND d.w2 = i.w2 WHERE n >= 5
  UNION SELECT r, k, n, p - j FROM doc_seeds d JOIN item_seeds i ON d.word = i.word AND d.w1 = i.w1 AND d.w3 = i.w3 WHERE n >= 5
),
compared AS MATERIALIZED (
  SELECT r, k, n, delta, j, w.e - strlen(w.word) AS b, w.e, w.word = i.word AS eq, row_number() OVER line AS t,
    sum(CASE WHEN w.word = i.word THEN 1 ELSE -2 END) OVER line AS s
  FROM diagonals JOIN item_words i USING (k, n) JOIN words w USING (r) WHERE w.p = delta + j WINDOW line AS (PARTITION BY r, k, delta ORDER BY j)
),
gains AS (SELECT *, least(0, min(s) OVER (PARTITION BY r, k, delta ORDER BY t)) AS low FROM compared),
stops AS (
  SELECT r, k, n, delta, count(*) FILTER (eq) AS equal, min(t) FILTER (eq) - 1 AS first_eq, max(t) FILTER (eq) AS last_eq, arg_max(t, s - low - t * 1e-9) AS stop FROM gains GROUP BY ALL
),
begins AS (
  SELECT r, k, delta, CASE WHEN min(s) < 0 THEN arg_min(t, s + t * 1e-9) ELSE 0 END AS start FROM gains JOIN stops USING (r, k, n, delta) WHERE t <= stop GROUP BY ALL
),
stretches AS MATERIALIZED (
  SELECT r, k, n, delta, (7 * n + 9) // 10 AS need, CASE WHEN equal >= (7 * n + 9) // 10 THEN first_eq ELSE start END AS x, CASE WHEN equal >= (7 * n + 9) // 10 THEN last_eq ELSE stop END AS y
  FROM stops JOIN begins USING (r, k, delta)
),
held AS MATERIALIZED (
  SELECT r, k, n, need, x, y, delta, count(*) FILTER (eq) AS equal FROM stretches JOIN compared USING (r, k, n, delta) WHERE t > x AND t <= y GROUP BY ALL HAVING equal >= least(8, need)
),
covered AS (
  SELECT r, k, n, need, count(DISTINCT j) FILTER (eq) AS n_equal, min(b) AS low, max(e) AS high FROM held JOIN compared USING (r, k, n, delta) WHERE t > x AND t <= y GROUP BY ALL HAVING n_equal >= least(13, need)
),
whole AS (
  SELECT r, k, n, n AS n_equal, low, high FROM (SELECT r, list(word ORDER BY p) AS ws, min(e - strlen(word)) AS low, max(e) AS high FROM words GROUP BY r HAVING count(*) < 5) JOIN (SELECT k, n, list(word ORDER BY j) AS ws FROM item_words WHERE n < 5 GROUP BY k, n) USING (ws)
),
found AS MATERIALIZED (SELECT r, k, n, n_equal, low, high FROM covered UNION ALL SELECT * FROM whole)
SELECT doc_id, item_id, n_equal::BIGINT AS n_equal, n::BIGINT AS n_item, low::BIGINT AS "start", high::BIGINT AS "end" FROM found JOIN docs USING (r) JOIN items USING (k)
"""


def _simhash_near_dedup() -> str:
    return f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lowered("text", latin=False)}, '[^{WHITE}]+') AS w FROM documents),
shingles AS (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
),
kinds AS MATERIALIZED (SELECT DISTINCT s FROM shingles),
hashed AS MATERIALIZED (SELECT s, h::UBIGINT AS h FROM ({xxh64("kinds", "s")})),
ones AS (SELECT r, {", ".join(f"2 * sum((h >> {b}) & 1) > count(*) AS b{b}" for b in range(64))} FROM shingles JOIN hashed USING (s) GROUP BY r),
prints AS MATERIALIZED (
  SELECT doc_id, coalesce({" + ".join(f"(CASE WHEN b{b} THEN {1 << b}::UHUGEINT ELSE 0 END)" for b in range(64))}, 0)::UBIGINT AS fp FROM words LEFT JOIN ones USING (r)
),
nodes AS (SELECT DISTINCT fp FROM prints),
edges AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (SELECT fp, fp AS other FROM nodes UNION SELECT fp, b FROM reach JOIN edges ON other = a),
components AS (SELECT reach.fp, min(doc_id) AS component_id FROM reach JOIN prints ON prints.fp = other GROUP BY reach.fp)
SELECT doc_id, lpad(lower(printf('%x', fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN components USING (fp)
"""


def _suffix_array_dedup(least: int = 50) -> str:
    return f"""
WITH rows AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^{WHITE}]+') AS w FROM documents),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, w, min(doc_id) AS class_id, count(*) AS copies FROM rows WHERE len(w) >= {least} GROUP BY w),
windows AS MATERIALIZED (SELECT c, a, md5(array_to_string(w[a + 1:a + {least}], ' ')) AS x FROM (SELECT c, w, unnest(range(0, len(w) - {least - 1})) AS a FROM classes)),
repeated AS (SELECT c, a FROM windows WHERE x IN (SELECT x FROM windows GROUP BY x HAVING count(*) > 1)),
runs AS (SELECT c, min(a) AS first_word, max(a) - min(a) + {least} AS n_words FROM (SELECT c, a, a - row_number() OVER (PARTITION BY c ORDER BY a) AS island FROM repeated) GROUP BY c, island),
spans AS (SELECT c, first_word, n_words FROM runs JOIN classes USING (c) WHERE copies = 1 UNION ALL SELECT c, 0, len(w) FROM classes WHERE copies > 1),
marked AS (SELECT c, string_agg(first_word || ':' || n_words, ',' ORDER BY first_word) AS spans, sum(n_words) AS n_repeated FROM spans GROUP BY c)
SELECT doc_id, class_id, copies::BIGINT AS copies, spans, n_repeated::BIGINT AS n_repeated FROM rows JOIN classes USING (w) JOIN marked USING (c)
"""


def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, in integers."""
    assigned = lambda k: f"""
near{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, part, entry, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut JOIN book{k} USING (part)) GROUP BY vec_id, part)"""  # noqa: E731
    moved = lambda k: f"""
book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS y FROM (
    SELECT part, entry, pos, sum(x[pos])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{k} JOIN cut USING (vec_id, part), (SELECT unnest(range(1, (SELECT w FROM size) + 1)) AS pos) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""  # noqa: E731
    steps = ",".join(assigned(k) + ("," + moved(k) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
size AS (SELECT len(v) // {parts} AS w FROM whole ORDER BY vec_id LIMIT 1),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1:(part + 1) * w] AS x FROM whole, size, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM cut WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT {entries})),{steps},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN whole USING (vec_id)
"""


def _source_divergence(least: int = 10, top: int = 10) -> str:
    """Every term of a language against every pair of its groups."""
    return f"""
WITH rows AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lowered("text", latin=False)}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
groups AS (SELECT DISTINCT lang, source FROM rows),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM (SELECT d, lang, source, unnest(words) AS term FROM rows) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= {least}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grid AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p FROM grid JOIN langs USING (lang)),
usual AS (SELECT lang, term, 1 + (1000000000 * (n::HUGEINT + 2)) // (total + 2 * v) AS q FROM kept JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
  SELECT x.lang, x.source AS s, y.source AS t, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f ON f.lang = a.lang AND f.s = a.source AND f.t = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


ORACLES: dict[str, str] = {
    "op3_document_fingerprints": _document_fingerprints(),
    "op5_benchmark_decontamination": _benchmark_decontamination(),
    "op7_simhash_near_dedup": _simhash_near_dedup(),
    "op9_suffix_array_dedup": _suffix_array_dedup(),
    "op11_vector_codes": _vector_codes(),
    "op13_source_divergence": _source_divergence(),
}
