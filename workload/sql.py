"""Building blocks of the oracle SQL (DuckDB): quoting, patterns, derived tables, shared stages.

The statements are written independently of the Spark operators: spans come from split/extract
lists, line scans from window functions, folds from list_reduce.  Only the fixed values
(patterns, words, weights, messages) are shared.
"""

from __future__ import annotations

from pactlens.fixed import clauses as C
from pactlens.fixed import noise as N
from pactlens.fixed import privacy as P
from pactlens.fixed import risk as R
from pactlens.functions.text import WHITESPACE_CHARS, expand_whitespace
from workload.bank import BANK
from workload.derived import CONTRACT_TYPES, MIMES


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def re2(source: str, flags: str = "") -> str:
    return (f"(?{flags})" if flags else "") + expand_whitespace(source)


def any_re2(patterns) -> str:
    return "|".join(f"(?{f}:{expand_whitespace(s)})" for s, f in patterns)


def replaced(expr: str, patterns, blank: str = " ") -> str:
    for source, flags in patterns:
        expr = f"regexp_replace({expr}, {q(re2(source, flags))}, {q(blank)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE_CHARS)})"


def squeeze(expr: str) -> str:
    return strip(replaced(expr, [(r"\s+", "")]))


def count_words(lowered: str, words) -> str:
    return "(" + " + ".join(f"contains({lowered}, {q(w)})::INT" for w in words) + ")"


def any_word(lowered: str, words) -> str:
    return "(" + " OR ".join(f"contains({lowered}, {q(w)})" for w in words) + ")"


def rules(lowered: str, table, otherwise: str) -> str:
    whens = " ".join(f"WHEN {any_word(lowered, words)} THEN {q(label)}" for label, words in table)
    return f"CASE {whens} ELSE {q(otherwise)} END"


def scale(score: str, levels, lowest: str) -> str:
    whens = " ".join(f"WHEN {score} >= {t} THEN {q(n)}" for n, t in levels)
    return f"CASE {whens} ELSE {q(lowest)} END"


def msg(template: str, *values: str) -> str:
    parts = template.replace("%d", "%s").split("%s")
    out = q(parts[0])
    for value, tail in zip(values, parts[1:], strict=True):
        out += f" || ({value})::VARCHAR || {q(tail)}"
    return f"({out})"


def mapped(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def rnd(expr: str, digits: int) -> str:
    s = f"{float(10 ** digits)}"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def plain(expr: str) -> str:
    return f"regexp_replace(({expr})::VARCHAR, '\\.0$', '')"


# ---- derived tables, the same integer arithmetic as workload.derived

def pick(values, index: str) -> str:
    return f"({lst(values)})[({index}) + 1]"


_SLOTS = ", ".join(pick(BANK, f"(doc_id * 31 + {k * 17}) % {len(BANK)}") for k in range(8))
_NUMBER = "lpad((doc_id % 10000)::VARCHAR, 4, '0')"
_EVENT_STATUS = "CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'click' THEN 'extracting' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'completed' ELSE 'processing' END"

TABLES = {
    "contracts": f"""SELECT doc_id, concat_ws(chr(10), {_SLOTS}, text,
        CASE WHEN doc_id % 4 = 0 THEN 'Signature page, PAGE 9' END) AS text FROM documents""",
    "contracts_pii": f"""SELECT doc_id, text || chr(10) || 'Contact: user' || doc_id::VARCHAR || '@mail.example.com, phone 555-123-' || {_NUMBER}
        || CASE WHEN doc_id % 3 = 0 THEN ', ssn 123-45-' || {_NUMBER} ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN ', card 4111-1111-1111-' || {_NUMBER} ELSE '' END
        || CASE WHEN doc_id % 7 = 0 THEN ', host 10.0.0.12, signed John Smith' ELSE '' END || '.' AS text FROM contracts""",
    "predictions": f"""SELECT l_orderkey * 10 + l_linenumber AS ord, {pick(C.LABELS, 'l_partkey % 13')} AS true_label,
        CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 OR (l_suppkey % 6 = 3 AND l_partkey % 3 = 0)
             THEN {pick(C.LABELS, '(l_partkey + 5) % 13')} ELSE {pick(C.LABELS, 'l_partkey % 13')} END AS predicted_label,
        CASE WHEN (l_orderkey + l_linenumber) % 11 <> 5 THEN {pick(CONTRACT_TYPES, 'l_suppkey % 6')} END AS contract_type FROM lineitem""",
    "feedback": f"""SELECT event_id AS feedback_id, 'clause_' || (event_id % 97)::VARCHAR AS clause_id, ts AS timestamp,
        nullif(user_id, 7) AS user_id, floor(value * 2 + 0.5) / 1000.0 AS model_confidence,
        CASE WHEN event_type = 'view' THEN 'confirmation' ELSE 'correction' END AS feedback_type,
        CASE WHEN event_id % 19 <> 3 THEN {pick(C.LABELS, 'event_id % 13')} END AS model_prediction,
        CASE WHEN event_id % 23 = 3 THEN NULL WHEN event_id % 4 <> 0 THEN {pick(C.LABELS, 'event_id % 13')} ELSE {pick(C.LABELS, '(event_id + 1) % 13')} END AS user_correction
        FROM events""",
    "registry": f"""SELECT o_orderkey AS id, 'Batch ' || (o_custkey % 50)::VARCHAR AS batch_name,
        'contract_' || o_orderkey::VARCHAR || '.txt' AS original_name, {pick(MIMES, 'o_orderkey % 7')} AS mime,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'uploaded' ELSE 'processing' END AS status,
        CASE WHEN o_orderstatus = 'F' THEN ['low', 'medium', 'high'][o_orderkey % 3 + 1] END AS risk_level,
        floor(o_totalprice * 100 + 0.5)::BIGINT AS file_size, o_orderdate AS uploaded_at FROM orders""",
    "uploads": f"""SELECT CASE WHEN l_orderkey % 97 = 3 THEN 3 ELSE l_orderkey END AS batch_id,
        (CASE WHEN l_orderkey % 97 = 3 THEN l_orderkey * 10 + l_linenumber ELSE l_linenumber END)::BIGINT AS ord,
        'file_' || (l_orderkey * 10 + l_linenumber)::VARCHAR || '.bin' AS filename,
        'Lease ' || l_linenumber::VARCHAR || ' of ' || l_orderkey::VARCHAR AS original_name,
        floor(l_extendedprice * 1000 + 0.5)::BIGINT AS size, {pick(MIMES, '(l_partkey + l_linenumber) % 7')} AS mime FROM lineitem""",
    "batch_files": """SELECT conv_id AS batch_id, turn AS ord, role || '_' || turn::VARCHAR || '.txt' AS original_name,
        CASE WHEN (conv_id + turn) % 13 = 5 THEN '  ' ELSE text END AS text,
        CASE WHEN (conv_id + turn) % 11 = 3 THEN 'unreadable file' END AS error FROM conversations""",
    "status_events": f"SELECT user_id AS doc_id, ts, event_id, {_EVENT_STATUS} AS status FROM events",
}
NEEDS = {"contracts_pii": ["contracts"]}


# ---- spans

def pattern_rows(source: str, patterns) -> str:
    """Rows (doc_id, ord, label, confidence, replacement, start, end, hit) of all matches.

    `patterns` holds (ord, label, confidence, replacement, regex).
    """
    selects = []
    for order, label, confidence, replacement, regex in patterns:
        selects.append(f"""SELECT doc_id, {order} AS ord, {q(label)} AS label, {confidence}::DOUBLE AS confidence,
            {q(replacement)} AS replacement, i,
            (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0))::INT AS start,
            m[i] AS hit
            FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
                  FROM (SELECT doc_id, regexp_extract_all(text, {q(regex)}) AS m, string_split_regex(text, {q(regex)}) AS g
                        FROM {source} WHERE regexp_matches(text, {q(regex)})))""")
    return "SELECT *, start + length(hit) AS \"end\" FROM (" + " UNION ALL ".join(selects) + ")"


def word_bounded(rows: str, source: str) -> str:
    """Keeps the matches whose neighbours are no letters of other alphabets (the engine's \\b is ASCII)."""
    return f"""SELECT r.* FROM ({rows}) r JOIN {source} t USING (doc_id)
        WHERE (NOT regexp_matches(substring(t.text, r.start, 1), '[\\pL\\pN]') OR r.start = 0 OR r.label = 'PHONE' AND r.confidence = 1)
          AND (NOT regexp_matches(substring(t.text, r.end + 1, 1), '[\\pL\\pN]') OR r.label = 'PHONE' AND r.confidence = 1)"""


CONFIGURED = [(i, name.upper(), 1.0, token, "(?i)" + regex) for i, (name, regex, token) in enumerate(P.CONFIGURED_PATTERNS)]
BASIC = [(i, label, conf, f"[{label}]", regex) for i, (label, regex, conf) in enumerate(P.BASIC_PATTERNS)]

def span_stages(prefix: str, source: str) -> dict:
    """Stages <prefix>configured, merged, merged_rows, redacted, scores over a (doc_id, text) source."""
    return {
        f"{prefix}configured": ([source], word_bounded(pattern_rows(source, CONFIGURED), source)),
        # one row per document: spans folded by start; overlaps keep the more certain, longer, earlier span
        f"{prefix}merged": ([f"{prefix}configured"], f"""SELECT doc_id, list_reduce(spans, lambda a, x:
                CASE WHEN x[1].start >= a[len(a)].end THEN list_concat(a, x)
                     WHEN x[1].confidence > a[len(a)].confidence
                       OR (x[1].confidence = a[len(a)].confidence AND x[1].end - x[1].start > a[len(a)].end - a[len(a)].start)
                     THEN list_concat(a[1:len(a) - 1], x) ELSE a END) AS spans
            FROM (SELECT doc_id, list([{{'hit': hit, 'label': label, 'start': start, 'end': "end", 'confidence': confidence,
                                        'replacement': replacement}}] ORDER BY start, ord, i) AS spans
                  FROM {prefix}configured GROUP BY doc_id)"""),
        f"{prefix}merged_rows": ([f"{prefix}merged"], f"""SELECT doc_id, i AS span_no, s.hit AS hit, s.label AS label, s.start AS start, s.end AS "end",
                s.confidence AS confidence, s.replacement AS replacement
            FROM (SELECT doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS i FROM {prefix}merged)"""),
        f"{prefix}redacted": ([source, f"{prefix}merged_rows"], f"""SELECT t.doc_id, CASE WHEN p.body IS NULL THEN t.text
                  ELSE p.body || substring(t.text, p.last_end + 1) END AS text
            FROM {source} t LEFT JOIN (
                SELECT doc_id, string_agg(piece, '' ORDER BY span_no) AS body, max("end") AS last_end FROM (
                    SELECT m.doc_id, m.span_no, m."end",
                           substring(t.text, 1 + coalesce(lag(m."end") OVER w, 0), m.start - coalesce(lag(m."end") OVER w, 0)) || m.replacement AS piece
                    FROM {prefix}merged_rows m JOIN {source} t USING (doc_id) WINDOW w AS (PARTITION BY m.doc_id ORDER BY m.span_no))
                GROUP BY doc_id) p USING (doc_id)"""),
        f"{prefix}scores": ([source, f"{prefix}merged_rows"], f"""SELECT t.doc_id, count(m.doc_id) AS n,
                CASE WHEN count(m.doc_id) = 0 THEN 1.0 ELSE floor(greatest(0.0, 1.0 -
                    (coalesce(sum(m."end" - m.start), 0)::DOUBLE / any_value(length(t.text)) * 2
                     + sum({mapped('m.label', {k: round(w * 10) for k, w in P.SENSITIVITY.items()}, '5')})::DOUBLE / (count(m.doc_id) * 10) * 0.5)) * 1000 + 0.5) / 1000.0 END AS privacy_score,
                list(m.label ORDER BY m.span_no) FILTER (m.label IS NOT NULL) AS labels,
                coalesce(sum(m."end" - m.start), 0) AS chars, any_value(length(t.text)) AS text_length
            FROM {source} t LEFT JOIN {prefix}merged_rows m USING (doc_id) GROUP BY t.doc_id"""),
    }


STAGES = {"basic": (["contracts_pii"], word_bounded(pattern_rows("contracts_pii", BASIC), "contracts_pii"))}
STAGES |= span_stages("", "contracts_pii")

# ---- layout filtering, as stages over (doc_id, text) tables

LINE_PATTERNS = [(N.LINE_NOISE_FAST.get(s, s), f) for group in N.LINE_NOISE.values() for s, f in group]
INDICATOR = "(?i)" + "|".join(N.LAYOUT_INDICATORS)


def hits(text: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({text}, {q(re2(s, f))})::INT" for s, f in patterns) + ")"


def body_noise(text: str) -> str:
    t = replaced(text, LINE_PATTERNS, "")
    for s, f in N.LAYOUT_REGIONS["metadataRegion"]:
        t = f"regexp_replace({t}, {q(re2(s, f))}, '')"
    return f"""array_to_string(list_filter(string_split({t}, chr(10)), lambda l: length({strip('l')}) >= 10
        AND (length({strip('l')}) >= 30 OR {strip('l')} <> upper({strip('l')}) OR regexp_matches({strip('l')}, {q(INDICATOR)}))), chr(10))"""


def layout_stages(prefix: str, source: str) -> dict:
    """Stages <prefix>structure, <prefix>conservative, <prefix>layout over a (doc_id, text) source."""
    lines = f"""SELECT doc_id, no, line, regexp_matches(line, {q(INDICATOR)}) AS contract,
            regexp_matches(line, {q(any_re2(N.BODY_STOP_PATTERNS))}) AS noisy
        FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no
              FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source}))"""
    structure = f"""SELECT doc_id, l, n, header, footer, tabular, first, start_line, end_line,
            CASE WHEN first > start_line THEN greatest(start_line, first - 2) ELSE start_line END AS body_start
        FROM (SELECT *, coalesce((SELECT min(no) FROM {prefix}lines x WHERE x.doc_id = s.doc_id AND x.contract
                                    AND x.no >= s.start_line AND x.no < s.end_line), -1) AS first
              FROM (SELECT *, CASE WHEN header THEN head_end ELSE 0 END AS start_line,
                           CASE WHEN footer THEN foot_start ELSE n END AS end_line,
                           header AND {hits('head', N.TABULAR_PATTERNS)} > 0 AS tabular
                    FROM (SELECT *, {hits('head', N.LAYOUT_REGIONS['headerRegion'])} >= 2 AS header,
                                 {hits('foot', N.LAYOUT_REGIONS['footerRegion'])} >= 1 AS footer
                          FROM (SELECT doc_id, l, len(l) AS n, floor(len(l) * 0.25)::INT AS head_end, floor(len(l) * 0.95)::INT AS foot_start,
                                       lower(array_to_string(l[1:floor(len(l) * 0.25)::INT], ' ')) AS head,
                                       lower(array_to_string(l[floor(len(l) * 0.95)::INT + 1:len(l)], ' ')) AS foot
                                FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})))) s)"""
    conservative = f"""SELECT t.doc_id, coalesce(k.text, '') AS text FROM {source} t LEFT JOIN (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM (
                SELECT *, min(no) FILTER (noisy AND seen > 5) OVER (PARTITION BY doc_id) AS stop FROM (
                    SELECT *, sum(contract::INT) OVER (PARTITION BY doc_id ORDER BY no) AS seen FROM {prefix}lines))
            WHERE seen >= 1 AND NOT noisy AND length({strip('line')}) > 10 AND (stop IS NULL OR no < stop) GROUP BY doc_id) k USING (doc_id)"""
    region = replaced("body", LINE_PATTERNS, " ")
    filtered = f"""SELECT doc_id, original, {squeeze(region)} AS f, conservative FROM (
            SELECT s.doc_id, t.text AS original, c.text AS conservative,
                   CASE WHEN length({strip('s.b')}) > 100 THEN s.b ELSE c.text END AS body
            FROM (SELECT doc_id, {body_noise("array_to_string(l[body_start + 1:end_line], chr(10))")} AS b FROM {prefix}structure) s
            JOIN {source} t USING (doc_id) JOIN {prefix}conservative c USING (doc_id))"""
    layout = f"""SELECT doc_id, CASE WHEN original = '' THEN ''
              WHEN (length(original) - length(f))::DOUBLE / length(original) > 0.8
                OR ({count_words('lower(f)', N.LAYOUT_INDICATORS)} < 3 AND length(f) < 500) THEN conservative
              ELSE {strip(replaced('f', [(r'\s{3,}', '')]))} END AS text FROM {prefix}filtered"""
    return {
        f"{prefix}lines": ([source], lines),
        f"{prefix}structure": ([f"{prefix}lines"], structure),
        f"{prefix}conservative": ([f"{prefix}lines"], conservative),
        f"{prefix}filtered": ([f"{prefix}structure", f"{prefix}conservative"], filtered),
        f"{prefix}layout": ([f"{prefix}filtered"], layout),
    }


STAGES |= layout_stages("c_", "contracts")
STAGES |= layout_stages("r_", "redacted")


# ---- clause extraction over a (doc_id, text) source

KEYWORDS = [(t, k) for t, (_, words, _) in C.CLAUSE_TYPES.items() for k in words]
TYPE_ORDER = list(C.CLAUSE_TYPES)


def keyword_hits(label: str, kind: str) -> str:
    words = C.CONFIDENCE_KEYWORDS
    whens = " ".join(f"WHEN {q(t)} THEN {count_words(kind, ws)}" for t, ws in words.items())
    return f"CASE lower({label}) {whens} ELSE 0 END"


def rule_confidence(text: str, label: str) -> str:
    raw = f"""greatest(0.1, least(0.95, 0.5::DOUBLE + least(0.4::DOUBLE, ({keyword_hits(label, f'lower({text})')}) * 0.1::DOUBLE)
        + CASE WHEN length({text}) > 100 THEN 0.1::DOUBLE WHEN length({text}) < 20 THEN -0.1::DOUBLE ELSE 0::DOUBLE END))"""
    return rnd(raw, 3)


def clause_stages(prefix: str, source: str, limit: int | None = C.MAX_CLAUSES) -> dict:
    selects = []
    for order, (kind, keyword) in enumerate(KEYWORDS):
        regex = rf"(?i)\b{keyword}\b[^.]{{0,200}}[.]"
        selects.append((order, f"{TYPE_ORDER.index(kind)}|{kind}|{keyword}", 1.0, "", regex))
    candidates = f"""SELECT doc_id, ord, split_part(label, '|', 1)::INT AS type_no, split_part(label, '|', 2) AS type, split_part(label, '|', 3) AS keyword,
            pos, hit, start, "end", {strip('substring(text, start + 1, "end" - start)')} AS content
        FROM (SELECT h.doc_id, h.ord, h.label, h.start AS pos, h.hit, t.text, greatest(0, h.start - 100) AS start,
                     least(length(t.text), h."end" + 100) AS "end"
              FROM ({pattern_rows(source, selects)}) h JOIN {source} t USING (doc_id))"""
    kept = f"""SELECT doc_id, c.ord AS ord, c.pos AS pos, c.type AS type, c.keyword AS keyword, c.start AS start, c.stop AS "end", c.content AS content
        FROM (SELECT doc_id, unnest(list_reduce(cs, lambda a, x:
                CASE WHEN len(list_filter(a, lambda k: abs(k.start - x[1].start) < 50 OR contains(k.lowered, x[1].prefix))) > 0 THEN a
                     ELSE list_concat(a, x) END)) AS c
              FROM (SELECT doc_id, type_no, list([{{'ord': ord, 'pos': pos, 'type': type, 'keyword': keyword, 'start': start, 'stop': "end",
                            'content': content, 'lowered': lower(content), 'prefix': lower(hit)[1:50]}}] ORDER BY ord, pos) AS cs
                    FROM {prefix}candidates WHERE length(content) > 30 GROUP BY doc_id, type_no))"""
    clauses = f"""SELECT doc_id, clause_no, type, content, start, "end", confidence,
            CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS confidence_level,
            confidence < 0.7 AS requires_review
        FROM (SELECT *, {rule_confidence('content', 'type')} AS confidence FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS clause_no FROM (
                SELECT *, row_number() OVER (PARTITION BY doc_id, start ORDER BY ord, pos) AS rn FROM {prefix}kept)
            WHERE rn = 1){'' if limit is None else f' WHERE clause_no <= {limit}'})"""
    # the additions run left to right, as doubles
    multiplier = "CASE type " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in R.TYPE_MULTIPLIERS.items()) + " ELSE 1::DOUBLE END"
    base = f"3::DOUBLE * {multiplier}"
    for i in range(3):
        step = "CASE type " + " ".join(
            f"WHEN {q(t)} THEN CASE WHEN contains(lc, {q(fs[i].lower())}) THEN 1.5::DOUBLE ELSE 0::DOUBLE END"
            for t, (_, _, fs) in C.CLAUSE_TYPES.items()
        ) + " ELSE 0::DOUBLE END"
        base = f"({base} + {step})"
    for phrase, w in (R.RISK_PHRASES | R.MITIGATING_PHRASES).items():
        base = f"({base} + CASE WHEN contains(lc, {q(phrase)}) THEN {w}::DOUBLE ELSE 0::DOUBLE END)"
    base = f"greatest(1::DOUBLE, least(10::DOUBLE, {rnd(f'{base} * (0.3::DOUBLE + confidence * 0.7::DOUBLE)', 1)}))"
    based = f"SELECT *, {base} AS base_risk FROM (SELECT *, lower(content) AS lc FROM {prefix}clauses)"
    table = [(w, wt, reason, cat, "risk") for w, wt, reason, cat in R.RISK_TRIGGERS]
    table += [(w, wt, reason, cat, "mitigator") for w, wt, reason, cat in R.MITIGATORS]
    trig = []
    for order, (w, wt, reason, cat, kind) in enumerate(table):
        p = q(rf"(?i)\b{w}\b")
        trig.append(f"""SELECT doc_id, clause_no, {order} AS ord, {q(w)} AS word, {wt}::DOUBLE AS weight, {q(reason)} AS reason, {q(cat)} AS category,
            {q(kind)} AS kind, (list_sum(list_transform(g[1:i], lambda s: length(s))) + (i - 1) * {len(w)})::INT AS start
            FROM (SELECT doc_id, clause_no, g, unnest(range(1, len(g))) AS i
                  FROM (SELECT doc_id, clause_no, string_split_regex(content, {p}) AS g FROM {prefix}based WHERE contains(lc, {q(w)})))""")
    triggers = "SELECT *, start + length(word) AS \"end\", row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY start, ord) AS trigger_no FROM (" + " UNION ALL ".join(trig) + ")"
    scored = f"""SELECT *, {rnd('xai', 1)} AS risk_score, upper({_risk_level('xai')}) AS risk_level, {_priority('xai', 'type')} AS priority FROM (
            SELECT b.*, greatest(1::DOUBLE, least(10::DOUBLE, b.base_risk + coalesce(t.shift, 0::DOUBLE))) AS xai,
                   coalesce(t.risks, []::VARCHAR[]) AS risks, coalesce(t.helps, []::VARCHAR[]) AS helps
            FROM {prefix}based b LEFT JOIN (
                SELECT doc_id, clause_no, list_reduce(list_concat([0::DOUBLE], list(weight * 0.3::DOUBLE ORDER BY trigger_no)), lambda a, x: a + x) AS shift,
                       list(word ORDER BY trigger_no) FILTER (kind = 'risk') AS risks, list(word ORDER BY trigger_no) FILTER (kind = 'mitigator') AS helps
                FROM {prefix}triggers GROUP BY doc_id, clause_no) t USING (doc_id, clause_no))"""
    std, crit = lst(C.STANDARD_TYPES), lst(C.CRITICAL_TYPES)
    per_doc = f"""SELECT doc_id, text_length, n, types, review, critical, high, high7, rental, conf_high, conf_low, mean_risk, mean_conf,
            list_filter({std}, lambda t: NOT list_contains(types, t)) AS missing,
            CASE WHEN n = 0 THEN 6::DOUBLE ELSE greatest(1::DOUBLE, least(10::DOUBLE,
                (CASE WHEN w > 0 THEN s / w ELSE 5::DOUBLE END) + len(list_filter({crit}, lambda t: NOT list_contains(types, t))) * 0.7::DOUBLE
                + CASE WHEN text_length < 1000 THEN 1::DOUBLE ELSE 0::DOUBLE END
                + CASE WHEN high7 > n * 0.3 THEN 0.8::DOUBLE ELSE 0::DOUBLE END)) END AS risk, is_batch
        FROM (SELECT d.doc_id, length(d.text) AS text_length, contains(d.text, '--- Content from') AS is_batch, coalesce(c.n, 0) AS n, coalesce(c.types, []::VARCHAR[]) AS types,
                     coalesce(c.review, 0) AS review, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high, coalesce(c.high7, 0) AS high7,
                     coalesce(c.rental, 0) AS rental, coalesce(c.conf_high, 0) AS conf_high, coalesce(c.conf_low, 0) AS conf_low,
                     c.total_risk / c.n AS mean_risk, c.w / c.n AS mean_conf, c.w, c.s
              FROM {source} d LEFT JOIN (
                SELECT doc_id, count(*) AS n, list(DISTINCT type) AS types, count(*) FILTER (requires_review) AS review,
                       count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (risk_score > 7) AS high,
                       count(*) FILTER (risk_score >= 7) AS high7, count(*) FILTER (list_contains({lst(C.RENTAL_TYPES)}, type)) AS rental,
                       count(*) FILTER (confidence_level = 'high') AS conf_high, count(*) FILTER (confidence < 0.7) AS conf_low,
                       list_reduce(list_concat([0::DOUBLE], list(risk_score ORDER BY clause_no)), lambda a, x: a + x) AS total_risk,
                       list_reduce(list_concat([0::DOUBLE], list(confidence ORDER BY clause_no)), lambda a, x: a + x) AS w,
                       list_reduce(list_concat([0::DOUBLE], list(risk_score * confidence ORDER BY clause_no)), lambda a, x: a + x) AS s
                FROM {prefix}scored GROUP BY doc_id) c USING (doc_id))"""
    return {
        f"{prefix}candidates": ([source], candidates),
        f"{prefix}kept": ([f"{prefix}candidates"], kept),
        f"{prefix}clauses": ([f"{prefix}kept"], clauses),
        f"{prefix}based": ([f"{prefix}clauses"], based),
        f"{prefix}triggers": ([f"{prefix}based"], triggers),
        f"{prefix}scored": ([f"{prefix}triggers"], scored),
        f"{prefix}docs": ([f"{prefix}scored"], per_doc),
    }


def _risk_level(score: str) -> str:
    return f"CASE WHEN {score} <= 3.5 THEN 'low' WHEN {score} <= 6.5 THEN 'medium' ELSE 'high' END"


def _priority(score: str, kind: str) -> str:
    return f"""CASE WHEN {score} >= 8 THEN 'critical'
        WHEN {score} >= 6 AND list_contains({lst(C.CRITICAL_TYPES)}, {kind}) THEN 'high'
        WHEN {score} >= 5 AND list_contains({lst(C.IMPORTANT_TYPES)}, {kind}) THEN 'high'
        WHEN {score} >= 4 THEN 'medium' ELSE 'low' END"""


risk_level, priority = _risk_level, _priority
STAGES |= clause_stages("c_", "contracts")
STAGES |= clause_stages("a_", "r_gated", None)
STAGES["c_marks"] = (["c_triggers"], """SELECT t.doc_id, t.clause_no, t.trigger_no, b.content, t.start, t."end" AS stop, t.kind,
        coalesce(lag(t."end") OVER (PARTITION BY t.doc_id, t.clause_no ORDER BY t.trigger_no), 0) AS last
    FROM c_triggers t JOIN c_based b USING (doc_id, clause_no)""")
STAGES["r_gated"] = (["r_layout"], "SELECT * FROM r_layout")


def explanation() -> str:
    quote = "array_to_string(list_transform({}, lambda w: '\"' || w || '\"'), ', ')"
    risks = f"({msg(R.MSG_RISKS, 'len(risks)')} || {msg(R.MSG_KEY_CONCERNS, quote.format('risks[1:3]'))})"
    helps = msg(R.MSG_MITIGATORS, "len(helps)", quote.format("helps[1:2]"))
    return f"""CASE WHEN len(risks) = 0 AND len(helps) = 0 THEN {msg(R.MSG_NO_TRIGGER, 'type')}
        ELSE (CASE WHEN len(risks) > 0 THEN {risks} ELSE '' END) || (CASE WHEN len(helps) > 0 THEN {helps} ELSE '' END) END"""


def factor_list(kind: str = "type", lc: str = "lc") -> str:
    by_type = "CASE " + kind + " " + " ".join(
        f"WHEN {q(t)} THEN list_transform(list_filter({lst(fs)}, lambda f: contains({lc}, lower(f))), lambda f: 'Contains ' || f)"
        for t, (_, _, fs) in C.CLAUSE_TYPES.items()
    ) + " ELSE []::VARCHAR[] END"
    context = ", ".join(
        f"CASE WHEN contains({lc}, {q(p)}) AND {any_word(lc, ctx)} THEN {q(f)} END" for p, ctx, f in R.CONTEXT_FACTORS
    )
    return f"list_concat({by_type}, list_filter([{context}], lambda f: f IS NOT NULL))"


def recommendations() -> str:
    names = {t: C.CLAUSE_TYPES[t][0].lower() for t in C.STANDARD_TYPES}
    per = {t: R.REC_MISSING.get(t, R.REC_MISSING_OTHER % names[t]) for t in C.STANDARD_TYPES}
    head = f"""[CASE WHEN is_batch THEN {q(R.REC_BATCH)} END, CASE WHEN review > 0 THEN {msg(R.REC_REVIEW, 'review')} END,
        CASE WHEN critical > 0 THEN {msg(R.REC_CRITICAL, 'critical')} END, CASE WHEN high > 0 THEN {msg(R.REC_HIGH_RISK, 'high')} END]"""
    tail = f"""[CASE WHEN text_length < 1000 THEN {q(R.REC_SHORT)} END, CASE WHEN mean_risk > 6 THEN {q(R.REC_HIGH_MEAN)} END,
        {q(R.REC_PRIVACY)}, CASE WHEN n > 10 THEN {q(R.REC_FAIRNESS)} END]"""
    middle = f"list_transform(missing, lambda t: {mapped('t', per, 'NULL')})"
    return f"(list_filter(list_concat(list_concat({head}, {middle}), {tail}), lambda r: r IS NOT NULL))[1:15]"


def summary() -> str:
    def part(n: str, template: str) -> str:
        return f"CASE WHEN {n} > 0 THEN {msg(template, n)} ELSE '' END"

    lost = f"len(list_filter(missing, lambda t: list_contains({lst(C.RENTAL_TYPES)}, t)))"
    return f"""(CASE WHEN is_batch THEN {q(R.SUM_BATCH)} ELSE {q(R.SUM_SINGLE)} END || {risk_level('risk')} || {msg(R.SUM_LEVEL, plain('risk'), 'n')}
        || {part('rental', R.SUM_RENTAL)} || {part('review', R.SUM_REVIEW)} || {part('high', R.SUM_HIGH)} || {part('critical', R.SUM_CRITICAL)}
        || {part(lost, R.SUM_MISSING_RENTAL)} || {part('len(missing)', R.SUM_MISSING)} || {q(R.SUM_PRIVACY)}
        || {mapped(risk_level('risk'), R.SUM_END, 'NULL')})"""


def statement(body: str, *needs: str) -> str:
    """WITH the derived tables and stages a statement needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in NEEDS.get(name, []) if name in TABLES else STAGES[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({TABLES[n] if n in TABLES else STAGES[n][1]})" for n in order]
    return f"WITH {', '.join(parts)} {body}" if parts else body
