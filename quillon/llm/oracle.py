"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .quality import LEAST_WORDS, REPEAT_PERCENT, RULES, STEPS, SYMBOLS, UPPER

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS kept FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(floor(j / 4) AS INTEGER) * 5 + 1, 5) AS BIGINT) >> CAST(5 * (3 - j % 4) AS BIGINT)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to FROM k"""

CHAT = """WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(role || chr(0) || text ORDER BY turn, role, text) AS l, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered FROM r GROUP BY 1)
SELECT conv_id, len(l) AS n_turns, (SELECT count(*) FROM c e WHERE e.l = c.l) AS copies, rendered FROM c
WHERE NOT EXISTS (SELECT 1 FROM c o WHERE (len(o.l) > len(c.l) AND o.l[1:len(c.l)] = c.l) OR (o.l = c.l AND o.conv_id < c.conv_id))"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

MIDDLE = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || s[9:16] AS BIGINT) % (len(u) + 1) AS y, CAST('0x' || s[17:24] AS BIGINT) % 100 AS r, CAST('0x' || s[25:32] AS BIGINT) % 100 AS f FROM t),
c AS (SELECT *, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m, coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS q, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 100 THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""

#: crc32 bit by bit: eight shifts for each character of the decimal id.
_CRC = "xor(list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda acc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(acc, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"

TRIE = rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format(c='conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, sha256(role || chr(0) || text) AS x, length(text) AS tokens FROM r),
o AS (SELECT conv_id, depth, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node, string_agg(x, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, tokens FROM d UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
p AS (SELECT conv_id, depth, node, CASE WHEN depth > 0 THEN coalesce(up, '') END AS up, tokens, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM o),
v AS (SELECT node, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(tokens) AS tokens, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT up AS node, count(*) AS n FROM v WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT a.node, b.node AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
w AS (SELECT s.node, sum((v.n_convs - 1) * v.tokens) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM s JOIN v ON v.node = s.below LEFT JOIN k ON k.node = s.below GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN w USING (node) LEFT JOIN k USING (node) LEFT JOIN v u ON u.node = v.up"""


def quality_sql(risk: float = 0.02, delta: float = 0.05) -> str:
    failed = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    values = {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "shout_share": share("n_shouts", "n_words"), "upper_share": share("n_upper", "word_chars")}
    grid = " UNION ALL ".join(f"SELECT {i} AS i, '{rule}' AS rule, CAST({cutoff} AS DOUBLE) AS cutoff" for i, (rule, cutoff) in enumerate(STEPS))
    long = " UNION ALL ".join(f"SELECT doc_id, lang, '{rule}' AS rule, {rule} AS v FROM v" for rule in RULES)
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 5) x(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(translate(t, {BLANKS}, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts, length(t) - length(translate(t, '{UPPER}', '')) AS n_upper FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT *, {failed} AS base_failed, {', '.join(f'{x} AS {k}' for k, x in values.items())} FROM f),
long AS ({long}), good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT * FROM long JOIN good USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM v WHERE NOT base_failed)),
sizes AS (SELECT lang, count(DISTINCT doc_id) AS n FROM held GROUP BY 1), grid AS ({grid}),
broken AS (SELECT lang, doc_id, min(i) AS i FROM held JOIN grid USING (rule) WHERE v > cutoff GROUP BY ALL),
tests AS (SELECT s.lang, s.n, n / sum(n) OVER (PARTITION BY g.i) AS share, g.*, (SELECT count(*) FROM broken b WHERE b.lang IS NOT DISTINCT FROM s.lang AND b.i <= g.i) AS k FROM sizes s, grid g),
holds AS (SELECT *, k < n * {risk} AND list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk})))) <= {delta} * share AS ok FROM tests),
walked AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY i) AS passed FROM holds),
cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM walked WHERE passed GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id FROM long JOIN cuts ON long.rule = cuts.rule AND long.lang IS NOT DISTINCT FROM cuts.lang WHERE v > cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM v"""
