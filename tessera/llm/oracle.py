"""DuckDB SQL for the queries that SQL can express, written independently of the DataFrame code."""

from __future__ import annotations

from tessera.llm import mixing, quality_rules, sharding

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + CAST(i // 4 * 5 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM d"""

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("text")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS whole FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
l AS (SELECT arg_min((whole - capped) / open, (cap / w, source)) AS level FROM r WHERE (whole - capped) / open * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM r LEFT JOIN l ON true),
k AS (SELECT *, CAST((length(bin(greatest(size, 1))) - 1) // 2 AS INTEGER) AS k FROM d),
c AS (SELECT source, k, CAST(sum(size) AS DOUBLE) AS words, pow(2.0::DOUBLE, k) AS f FROM k GROUP BY 1, 2),
v AS (SELECT c.*, source_size, target, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(words * f) OVER (PARTITION BY c.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, least(2.0::DOUBLE, greatest(0, coalesce(f * arg_max(level, k) FILTER (level * f <= 2) OVER (PARTITION BY source), 2))) AS copies FROM v),
g AS (SELECT source, k, source_size, target, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS todo FROM e),
x AS (SELECT k.doc_id, k.source, size, source_size, target, certain, p, todo,
  (CAST('0x' || substr(md5(concat_ws(':', '1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(k.source, ''), CAST(size AS VARCHAR))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source AND k.k = g.k),
q0 AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, false AS taken FROM x)
{"".join(f''',
m{k} AS (SELECT *, todo - sum(CASE WHEN taken THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM q{k - 1}),
n{k} AS (SELECT *, (NOT taken AND rank IS NOT NULL AND size <= {"2 * rest" if k == mixing.TURNS else "rest"}) AS open FROM m{k}),
q{k} AS (SELECT * EXCLUDE (rest, open, taken), taken OR (open AND sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) - {"size / 2.0::DOUBLE" if k == mixing.TURNS else "0"} <= rest) AS taken FROM n{k})'''
for k in range(1, mixing.TURNS + 1))}
SELECT doc_id, size, source_size, target, CAST(size * (certain + CAST(taken AS BIGINT)) AS BIGINT) AS taken FROM q{mixing.TURNS}"""

_ROUNDS = ", ".join(f"{{'l': {t}::BIGINT, 'r': 0::BIGINT}}" for t in range(sharding.ROUNDS))
_MIXED = "CAST('0x' || substr(md5('1:' || CAST(x.l AS VARCHAR) || ':' || CAST(acc.{0} AS VARCHAR)), 1, 15) AS BIGINT)"
_PASS = f"""list_reduce(list_prepend({{'l': v // b, 'r': v % b}}, [{_ROUNDS}]), lambda acc, x: CASE WHEN x.l % 2 = 0
  THEN {{'l': (acc.l + {_MIXED.format('r')}) % a, 'r': acc.r}} ELSE {{'l': acc.l, 'r': (acc.r + {_MIXED.format('l')}) % b}} END)"""

SHARDS = rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)])), 4294967295::BIGINT) AS text_crc32 FROM h, crc),
n AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, {sharding.BUCKET_DIGITS}), doc_id, text_crc32, size) - 1 AS v, count(*) OVER () AS n FROM c),
g AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM n),
w(doc_id, size, text_crc32, n, a, b, v, step) AS (
  SELECT doc_id, size, text_crc32, n, a, b, v, 0 FROM g
  UNION ALL SELECT doc_id, size, text_crc32, n, a, b, p.l * b + p.r, step + 1 FROM (SELECT *, {_PASS} AS p FROM w WHERE step = 0 OR v >= n) y)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % 24 AS INTEGER) AS shard, CAST(v // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM w WHERE step > 0 AND v < n"""

JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM o UNION SELECT r.a, o.b FROM r JOIN o ON r.b = o.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = s.doc_id"""

_ALPHA, _DELTA, _RULES, _STEPS = 0.05, 0.1, quality_rules.RULES, quality_rules.STEPS
_CUTS = ", ".join(f"('{name}', {i}, {c!r}::DOUBLE)" for name, cuts in _RULES.items() for i, c in enumerate(cuts))

RULES = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("text")} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY 1),
f AS (SELECT l.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(text) - length(translate(text, '!?', '')) AS n_marks, length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS n_capitals, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS n_letters
  FROM l LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
x AS (SELECT doc_id, lang, unnest([{{'rule': 'symbols', 'x': CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END}}, {{'rule': 'marks', 'x': CASE WHEN word_chars > 0 THEN n_marks::DOUBLE / word_chars ELSE 0 END}},
  {{'rule': 'capitals', 'x': CASE WHEN n_letters > 0 THEN n_capitals::DOUBLE / n_letters ELSE 0 END}}, {{'rule': 'same_lines', 'x': CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END}},
  {{'rule': 'repeats', 'x': CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END}}], recursive := true) FROM b WHERE NOT base_failed),
cuts(rule, place, cutoff) AS (VALUES {_CUTS}),
y AS (SELECT doc_id, lang, quality, (CAST('0x' || substr(md5('select:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 < {quality_rules.SELECTING!r} AS selecting FROM b JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT base_failed),
n AS (SELECT y.lang, rule, place, count(*) FILTER (x > cutoff AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE AS lost, count(*) FILTER (x > cutoff AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0)::DOUBLE AS caught FROM y JOIN x USING (doc_id) JOIN cuts USING (rule) WHERE selecting GROUP BY y.lang, rule, place),
aim AS (SELECT lang, rule, arg_min(place, (-(coalesce(caught, 0) - coalesce(lost, 0)), place)) AS aim FROM n WHERE coalesce(caught, 0) - coalesce(lost, 0) > 0 GROUP BY 1, 2),
path AS (SELECT lang, step, aim.rule, cutoff FROM aim, (SELECT unnest(range(1, {_STEPS + 1})) AS step) JOIN cuts ON cuts.rule = aim.rule AND cuts.place = aim.aim * step // {_STEPS}),
hit AS (SELECT x.doc_id, min(step) AS first FROM x JOIN path ON x.lang IS NOT DISTINCT FROM path.lang AND x.rule = path.rule AND x.x > path.cutoff GROUP BY 1),
s AS (SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) OVER () AS strata FROM y WHERE NOT selecting GROUP BY 1),
e AS (SELECT lang, k, sum(exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({_ALPHA!r}) + (good - k) * ln(1 - {_ALPHA!r}::DOUBLE))) OVER (PARTITION BY lang ORDER BY k) AS tail, {_DELTA!r} / strata AS error FROM (SELECT *, unnest(range(0, good + 1)) AS k FROM s)),
a AS (SELECT lang, coalesce(max(k) FILTER (tail <= error), -1) AS allowed FROM e GROUP BY 1),
t AS (SELECT a.lang, step, allowed, count(*) FILTER (quality = 1 AND first <= step) AS lost FROM a, (SELECT unnest(range(1, {_STEPS + 1})) AS step), y LEFT JOIN hit USING (doc_id) WHERE y.lang IS NOT DISTINCT FROM a.lang AND NOT selecting GROUP BY 1, 2, 3),
held AS (SELECT lang, coalesce(min(step) FILTER (lost > allowed), {_STEPS + 1}) - 1 AS step FROM t GROUP BY 1)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first <= step, false) AS kept
FROM b LEFT JOIN hit USING (doc_id) LEFT JOIN held ON b.lang IS NOT DISTINCT FROM held.lang"""
