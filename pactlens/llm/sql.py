"""DuckDB statements for the operators that SQL can express."""

from pactlens.llm.host_trust import BLOCK_AT, BLOCKED_WORDS, DAMPING, DOMAIN_WEIGHT, LINK, STEPS, URL
from pactlens.llm.host_trust import RULES as HOST_RULES
from pactlens.llm.mixing import MOST_EPOCHS, SHARE, SYMBOLS, WEIGHTS
from pactlens.llm.quality_rules import RULES
from pactlens.llm.text_stats import COUNTS, STOP_WORDS, WINDOW
from pactlens.llm.token_counts import TOKENIZERS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


QUALITY_RULES = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    {_count(COUNTS['n_symbols'])} AS n_symbols,
    len(list_filter({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop
  FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i,
    unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS window_words
  FROM d WHERE len(w) >= {WINDOW}
), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window_words) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols, n_stop,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, list_filter([{', '.join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(r.sql() for r in RULES if r.base)} AS base_failed,
  len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules
FROM f
"""

_TURN = f"[{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size, {_count(SYMBOLS)} AS symbols FROM documents
), k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / greatest(0.1::DOUBLE, 1.0::DOUBLE - symbols * 2.0::DOUBLE / greatest(size, 1)) AS key
  FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ({_TURN})::DOUBLE AS w, source_size * {MOST_EPOCHS}::DOUBLE AS lim, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM s),
b AS (
  SELECT *, (budget - coalesce(sum(lim) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(level, lim / w) FROM b WHERE level * w < lim) * w, lim)) AS target FROM b
), e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {int(MOST_EPOCHS)}) ELSE 0 END::INTEGER AS full_epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.full_epochs, e.target - e.full_epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), q AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - size)) THEN 1 ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, epochs::INTEGER AS epochs, (epochs * size)::BIGINT AS taken FROM q
"""

TOKEN_COUNTS = f"""
WITH d AS (
  SELECT source, lang, len({WORDS}) AS words, {_count(TOKENIZERS['pieces-2'])} AS pieces, {_count('[|]')} AS bars FROM documents
), c AS (
  SELECT source, lang, 'words-1' AS tokenizer, words AS tokens, words FROM d
  UNION ALL SELECT source, lang, 'pieces-2', pieces - bars, words FROM d
)
SELECT source, lang, tokenizer, (count(*) FILTER (words >= 10))::BIGINT AS n_docs,
  coalesce(sum(tokens) FILTER (words >= 10), 0)::BIGINT AS n_tokens
FROM c GROUP BY source, lang, tokenizer
"""

#: CRC-32 of a text of digits: a step for each of the eight bits of a byte, and one for each byte.
_BITS = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
_BYTE = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: {_BITS})"
_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_DIGITS}), lambda a, b: {_BYTE}), 4294967295::BIGINT)"

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS u FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(u ORDER BY turn NULLS FIRST) AS s, {_CRC} % 6 AS h FROM t GROUP BY conv_id
), built AS (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), named AS (SELECT conv_id, s, list_transform(s, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS k FROM built),
begun AS (SELECT conv_id, len(k) AS m, d, k[1:d] AS k, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars FROM (
  SELECT conv_id, s, k, unnest(range(0, len(k) + 1)) AS d FROM named
)), nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (m = d), '')) AS ends_sha256
  FROM begun GROUP BY k, d
), links AS (
  SELECT a.k, a.d, count(*) FILTER (b.d = a.d + 1) AS n_children, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.k NOT IN (SELECT k[1:d - 1] FROM nodes WHERE d > 0)) AS n_leaves
  FROM (SELECT k, d, saved, unnest(range(0, d + 1)) AS j FROM nodes) b JOIN nodes a ON a.d = b.j AND a.k = b.k[1:b.j] GROUP BY a.k, a.d
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, l.n_children, l.n_leaves, l.saved_tokens, n.ends_sha256
FROM nodes n JOIN links l ON n.k = l.k LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1:n.d - 1] AND p.d = n.d - 1
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_HOST = _lowered(f"coalesce(regexp_extract(url, {_quoted(URL)}, 1), '')")
_RULE_ROWS = ", ".join(f"({_quoted(r.host)}, {_quoted(r.path)}, {_quoted(r.text)}, {str(r.allow).lower()})" for r in HOST_RULES)
_BLOCKED = ", ".join(_quoted(w) for w in BLOCKED_WORDS)

HOST_TRUST = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, html, {_HOST} AS host, coalesce(regexp_extract(url, {_quoted(URL)}, 2), '') AS path FROM pages
), rules(of_host, of_path, rule, allow) AS (VALUES {_RULE_ROWS}),
fits AS (
  SELECT r, first(rule ORDER BY length(rule) DESC, rule) AS rule, first(allow ORDER BY length(rule) DESC, rule) AS allow
  FROM p JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path) GROUP BY r
), links AS (
  SELECT host, dst, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), {_quoted(LINK)}, 1), lambda u: {_lowered("regexp_extract(u, '//([^/?#]*)', 1)")}))) AS dst FROM p
  ) GROUP BY ALL
), named AS (SELECT host, string_split(host, '.') AS l FROM (SELECT host FROM p UNION SELECT dst FROM links) WHERE host <> '' AND NOT regexp_matches(host, '^[0-9.:]+$')),
ties AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS low, array_to_string(l[k + 1:], '.') AS up FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM named)
), e AS MATERIALIZED (
  SELECT src, dst, sum(w) AS w FROM (
    SELECT low AS src, up AS dst, {DOMAIN_WEIGHT}::DOUBLE AS w FROM ties UNION ALL SELECT up, low, {DOMAIN_WEIGHT}::DOUBLE FROM ties
    UNION ALL SELECT host, dst, n::DOUBLE FROM links WHERE host <> '' AND dst <> '' AND host <> dst
  ) GROUP BY src, dst
), moves AS MATERIALIZED (
  SELECT src AS a, dst AS b, w / sum(w) OVER (PARTITION BY src) AS t, 0::DOUBLE AS d FROM e
  UNION ALL SELECT dst, src, 0::DOUBLE, w / sum(w) OVER (PARTITION BY dst) FROM e
), seeds AS (
  SELECT host, max(good) AS good, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), [{_BLOCKED}]) THEN 1::DOUBLE ELSE max(bad) END AS bad FROM (
    SELECT host, avg(coalesce(allow, false)::INTEGER::DOUBLE) AS good, avg(coalesce(NOT allow, false)::INTEGER::DOUBLE) AS bad
    FROM p LEFT JOIN fits USING (r) WHERE host <> '' GROUP BY host
    UNION ALL SELECT dst, 0::DOUBLE, 0::DOUBLE FROM links WHERE dst <> ''
  ) GROUP BY host
), nodes AS MATERIALIZED (
  SELECT host, (1 - {DAMPING}::DOUBLE) * coalesce(good, 0) AS good, (1 - {DAMPING}::DOUBLE) * coalesce(bad, 0) AS bad
  FROM (SELECT host FROM seeds UNION SELECT src FROM e UNION SELECT dst FROM e) LEFT JOIN seeds USING (host)
), ranks AS (
  SELECT 0 AS step, host, good AS t, bad AS d FROM nodes
  UNION ALL
  SELECT r.step + 1, r.host, n.good + {DAMPING}::DOUBLE * coalesce(sum(s.t * m.t), 0), n.bad + {DAMPING}::DOUBLE * coalesce(sum(s.d * m.d), 0)
  FROM ranks r JOIN nodes n USING (host) LEFT JOIN moves m ON m.b = r.host LEFT JOIN ranks s ON s.host = m.a
  WHERE r.step < {STEPS} GROUP BY r.step, r.host, n.good, n.bad
), ends AS (SELECT host, round(t, 9) AS trust, round(d, 9) AS distrust FROM ranks WHERE step = {STEPS})
SELECT page_id, host, path, rule,
  CASE WHEN coalesce(allow, NOT coalesce(distrust >= {BLOCK_AT} AND distrust > trust, false)) THEN 'allow' ELSE 'block' END AS verdict
FROM p LEFT JOIN fits USING (r) LEFT JOIN ends USING (host)
"""
