"""DuckDB SQL for the queries of the subpackage that SQL can express."""

from __future__ import annotations

from . import rules

WS = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WS}')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
w AS (SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM n),
l AS (SELECT *, cap / weight AS ratio, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM v) * weight) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size END AS rate,
  CAST(CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN rate IS NULL THEN 1 ELSE floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END END AS BIGINT) AS taken FROM r
"""

_ESC = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace({_ESC.format('role')}, chr(10), '\n')) + length({_ESC.format('text')}) + 24) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {0}, 5) AS BIGINT) >> {1}) & 31) + 1 AS BIGINT), 1)"
_BASE32 = " || ".join(_DIGIT.format(5 * g + 1, 15 - 5 * k) for g in range(8) for k in range(4))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
"""


_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jsd(a: str, b: str, n: int) -> str:
    p, q = f"({a}[i] / list_sum({a}))", f"({b}[i] / list_sum({b}))"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END"
    return f"CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 0 ELSE sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {term(p)} + {term(q)})) / 2, 0)) END"


RULES = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
d AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g0 AS (SELECT *, len(w) AS n_words, array_to_string(w, '') AS j FROM d),
cw AS (SELECT lang, x, count(*) AS c FROM (SELECT DISTINCT id, lang, {_ASCII.format('unnest(w)')} AS x FROM g0 WHERE n_words >= {rules.MIN_WORDS} AND lang IS NOT NULL) GROUP BY ALL),
cl AS (SELECT lang, list(x ORDER BY r) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS r FROM cw) WHERE r <= {rules.COMMON} GROUP BY lang),
g AS (SELECT g0.*, ws FROM g0 LEFT JOIN cl USING (lang)),
win AS (SELECT id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT id, w, unnest(range(1, n_words - 6)) AS i FROM g)),
twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT id, count(DISTINCT p) AS r FROM (SELECT id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY id),
m AS (SELECT g.id, doc_id, lang, n_words, coalesce(length(j), 0) AS word_chars, length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
  length(j) - length(regexp_replace(j, '\p{{Ll}}', '', 'g')) AS lo, length(j) - length(regexp_replace(j, '\p{{Lu}}', '', 'g')) AS up, length(j) - length(regexp_replace(j, '\p{{Nd}}', '', 'g')) AS dg, length(text) - length(j) AS sp,
  coalesce(list_filter(list_transform(w, lambda x: list_position(ws, {_ASCII.format('x')})), lambda p: p > 0), []) AS codes FROM g LEFT JOIN rep ON rep.id = g.id),
h AS (SELECT *, [sp, lo, up, n_symbols, dg, word_chars - lo - up - n_symbols - dg] AS classes, list_append(list_transform(range(1, {rules.COMMON + 1}), lambda c: len(list_filter(codes, lambda x: x = c))), n_words - len(codes)) AS common,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
ref AS (SELECT lang, [{', '.join(f'sum(classes[{k}])' for k in range(1, 7))}] AS rc, [{', '.join(f'sum(common[{k}])' for k in range(1, rules.COMMON + 2))}] AS rw FROM h WHERE NOT base_failed AND n_words >= {rules.MIN_WORDS} AND lang IS NOT NULL GROUP BY lang),
v AS (SELECT h.*, {_jsd('classes', 'rc', 6)} AS jc, {_jsd('common', 'rw', rules.COMMON + 1)} AS jw FROM h LEFT JOIN ref USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {rules.MIN_WORDS} AND (coalesce(jc, 0) > {rules.CLASS_LIMIT} OR coalesce(jw, 0) > {rules.WORD_LIMIT})) AS kept FROM v
"""

_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"
TRIE = f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, {_CRC32} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM c)),
t AS (SELECT k.*, least(h, (SELECT count(*) FROM c WHERE c.conv_id = k.base)) AS taken FROM k),
r AS (SELECT conv_id, 0 AS pos, '' AS text, '' AS x FROM k
  UNION ALL SELECT t.conv_id, pos, text, sha256(length(role) || ':' || role || text) FROM t JOIN c ON c.conv_id = t.base WHERE pos <= taken
  UNION ALL SELECT t.conv_id, taken + pos - h, text, sha256(length(role) || ':' || role || text) FROM t JOIN c USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, pos, length(text) AS chars, pos = max(pos) OVER (PARTITION BY conv_id) AS stop, sha256(string_agg(x, '' ) OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM r),
n AS (SELECT key, pos AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stop), '')) AS ends_sha256 FROM p GROUP BY key, pos),
e AS (SELECT n.*, p.key AS parent_key FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.pos = n.depth - 1),
d AS (SELECT e.*, m.conv_id AS parent_conv_id, (SELECT count(*) FROM e AS x WHERE x.parent_key = e.key AND x.depth = e.depth + 1) AS n_children FROM e LEFT JOIN n AS m ON m.key = e.parent_key AND m.depth = e.depth - 1),
s AS (SELECT p.key, p.pos AS depth, sum((d.n_convs - 1) * d.chars) AS saved, count(*) FILTER (d.n_children = 0) AS leaves FROM d JOIN p ON p.conv_id = d.conv_id AND p.pos <= d.depth GROUP BY p.key, p.pos)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM d JOIN s USING (key, depth)
"""

SQL: dict[str, str] = {"op12_prefix_trie": TRIE, "op5_mixing": MIXING, "op7_warc": WARC, "op9_quality_rules": RULES, "op10_chat_formatting": CHAT}
