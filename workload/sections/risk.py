"""Risk, explanation, advice and report queries (F1-F16, G17-G19, A8) and their SQL."""

from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.fixed import privacy as P
from pactlens.fixed import risk as R
from pactlens.functions import risk as RF
from pactlens.functions.clauses import extract_clauses
from pactlens.functions.text import round_half_up
from pactlens.operators import clauses as OC
from pactlens.operators.rows import item_rows
from pactlens.plans.analyze import analyze_documents
from pactlens.session import scratch_path
from pactlens.sources.writers import write_analysis_export as write_export
from workload import derived as W
from workload.sql import (
    explanation, factor_list, lst, mapped, msg, plain, priority, q, recommendations, risk_level, rnd, scale, statement, summary,
)

QUERIES, ORACLE = {}, {}

KEY = ["doc_id", "clause_no"]


def clauses(spark, sf_dir):
    return OC.clause_rows(W.contracts(spark, sf_dir))


def scored(spark, sf_dir):
    return OC.scored_rows(clauses(spark, sf_dir))


def _clause_query(name, columns, sql, *needs, source=clauses):
    def run(spark, sf_dir):
        return source(spark, sf_dir).select(*KEY, *columns())

    QUERIES[name] = run
    ORACLE[name] = statement(sql, *needs)


_clause_query("base_clause_risk", lambda: ["type", RF.base_clause_risk(F.col("content"), F.col("type"), F.col("confidence")).alias("base_risk")],
              "SELECT doc_id, clause_no, type, base_risk FROM c_based", "c_based")
_clause_query("risk_factors", lambda: ["type", F.array_join(RF.risk_factors(F.col("content"), F.col("type")), " | ").alias("factors")],
              f"SELECT doc_id, clause_no, type, array_to_string({factor_list()}, ' | ') AS factors FROM c_based", "c_based")


def risk_triggers(spark, sf_dir):
    found = clauses(spark, sf_dir).select(*KEY, RF.risk_triggers(F.col("content")).alias("t"))
    return item_rows(found, "t", *KEY, position="no").select(*KEY, (F.col("no") + 1).alias("trigger_no"), "item.*")


QUERIES["risk_triggers"] = risk_triggers
ORACLE["risk_triggers"] = statement(
    'SELECT doc_id, clause_no, trigger_no::INT AS trigger_no, word, start, "end", reason, weight, category, kind FROM c_triggers', "c_triggers")
_clause_query("xai_risk", lambda: ["type", "risk_score"], "SELECT doc_id, clause_no, type, risk_score FROM c_scored", "c_scored", source=scored)
_clause_query("xai_explanation", lambda: ["explanation"], f"SELECT doc_id, clause_no, {explanation()} AS explanation FROM c_scored", "c_scored", source=scored)
_clause_query("risk_level", lambda: ["risk_score", "risk_level"], "SELECT doc_id, clause_no, risk_score, risk_level FROM c_scored", "c_scored", source=scored)
_clause_query("clause_priority", lambda: ["type", "risk_score", "priority"], "SELECT doc_id, clause_no, type, risk_score, priority FROM c_scored",
              "c_scored", source=scored)


def with_clauses(spark, sf_dir):
    """doc_id, text length and the scored clause array of each contract."""
    docs = W.contracts(spark, sf_dir).select("doc_id", "text", extract_clauses(F.col("text")).alias("clauses"))
    return docs.select("doc_id", F.length("text").alias("text_length"), F.transform("clauses", OC.scored_clause).alias("clauses"),
                       F.lit(False).alias("is_batch"))


def missing_clauses(spark, sf_dir):
    docs = with_clauses(spark, sf_dir)
    return item_rows(docs, RF.missing_clauses(F.col("clauses")), "doc_id", position="no", item="type").select(
        "doc_id", (F.col("no") + 1).alias("position"), "type")


QUERIES["missing_clauses"] = missing_clauses
ORACLE["missing_clauses"] = statement(
    "SELECT doc_id, generate_subscripts(missing, 1)::INT AS position, unnest(missing) AS type FROM c_docs", "c_docs")


def reported(spark, sf_dir):
    docs = with_clauses(spark, sf_dir)
    cs = F.col("clauses")
    return docs.select("*", RF.missing_clauses(cs).alias("missing"), RF.overall_risk(cs, F.col("text_length")).alias("risk"))


def overall_risk(spark, sf_dir):
    return reported(spark, sf_dir).select(
        "doc_id", F.size("clauses").alias("clauses"), round_half_up(F.col("risk"), 1).alias("overall_risk_score"),
        RF.risk_level(F.col("risk")).alias("risk_level"))


QUERIES["overall_risk"] = overall_risk
ORACLE["overall_risk"] = statement(
    f"SELECT doc_id, n AS clauses, {rnd('risk', 1)} AS overall_risk_score, {risk_level('risk')} AS risk_level FROM c_docs", "c_docs")


def recommendations_query(spark, sf_dir):
    r = reported(spark, sf_dir)
    recs = RF.recommendations(F.col("clauses"), F.col("missing"), F.col("text_length"), F.col("is_batch"))
    return item_rows(r, recs, "doc_id", position="no", item="recommendation").select(
        "doc_id", (F.col("no") + 1).alias("position"), "recommendation")


QUERIES["recommendations"] = recommendations_query
ORACLE["recommendations"] = statement(
    f"""SELECT doc_id, generate_subscripts(r, 1)::INT AS position, unnest(r) AS recommendation
        FROM (SELECT doc_id, {recommendations()} AS r FROM c_docs)""", "c_docs")


def analysis_summary(spark, sf_dir):
    r = reported(spark, sf_dir)
    return r.select("doc_id", RF.analysis_summary(F.col("clauses"), F.col("risk"), F.col("missing"), F.col("is_batch")).alias("summary"))


QUERIES["analysis_summary"] = analysis_summary
ORACLE["analysis_summary"] = statement(f"SELECT doc_id, {summary()} AS summary FROM c_docs", "c_docs")

BOOK = RF.default_handbook()


def _guide(name):
    table = {t: g[name] for t, g in BOOK.guidance.items() if t != "default"}
    return mapped("type", table, q(BOOK.guidance["default"][name]))


def _prefix(i):
    return mapped("lower(risk_level)", {k: v[i] for k, v in R.LEVEL_MODIFIERS.items()}, q(R.LEVEL_MODIFIERS["medium"][i]))


FIRST_BLANK = "regexp_replace(type, '^([^_]*)_', '\\1 ')"
_SUFFIX = f"CASE WHEN requires_review THEN {q(R.ADVICE_REVIEW_SUFFIX)} ELSE '' END"


def handbook_suggestions(spark, sf_dir):
    s = scored(spark, sf_dir)
    advice = RF.handbook_suggestions(F.col("content"), F.col("type"), F.col("risk_level"), F.col("confidence_level"), F.col("requires_review"))
    return s.select(*KEY, advice.alias("a")).select(
        *KEY, "a.suggestion", "a.justification", "a.specific_language", "a.expected_outcome", F.array_join("a.action_items", " | ").alias("action_items"))


QUERIES["handbook_suggestions"] = handbook_suggestions
ORACLE["handbook_suggestions"] = statement(
    f"""SELECT doc_id, clause_no, {_prefix(0)} || CASE WHEN contains(lc, 'sole discretion') THEN {q(R.HANDBOOK_SOLE_DISCRETION[0])}
          WHEN contains(lc, 'unlimited') THEN {q(R.HANDBOOK_UNLIMITED[0])} ELSE {_guide('guidance')} END || {_SUFFIX} AS suggestion,
        {msg(R.HANDBOOK_JUSTIFICATION, FIRST_BLANK, 'confidence_level')} AS justification,
        CASE WHEN contains(lc, 'sole discretion') THEN {q(R.HANDBOOK_SOLE_DISCRETION[1])} WHEN contains(lc, 'unlimited') THEN {q(R.HANDBOOK_UNLIMITED[1])}
          ELSE {_guide('language')} END AS specific_language, {msg(R.HANDBOOK_OUTCOME, FIRST_BLANK)} AS expected_outcome,
        {q(' | '.join(R.HANDBOOK_ACTIONS))} AS action_items FROM c_scored""", "c_scored")


def tiered_suggestions(spark, sf_dir):
    s = scored(spark, sf_dir)
    advice = RF.tiered_suggestions(F.col("content"), F.col("type"), F.col("risk_score"), F.col("confidence_level"), F.col("requires_review"))
    return s.select(*KEY, advice.alias("a")).select(*KEY, "a.suggestion", "a.justification")


def _tiered(i):
    whens = " ".join(f"WHEN type = {q(t)} AND tier = {q(k)} THEN {q(v[i])}" for (t, k), v in R.TIERED_ADVICE.items())
    generic = " ".join(f"WHEN tier = {q(k)} THEN {q(v[i])}" for k, v in R.GENERIC_ADVICE.items())
    return f"""CASE WHEN contains(lc, 'sole discretion') THEN {q(R.ADVICE_SOLE_DISCRETION[i])}
        WHEN contains(lc, 'unlimited') THEN {q(R.ADVICE_UNLIMITED[i])} {whens} {generic} END"""


QUERIES["tiered_suggestions"] = tiered_suggestions
ORACLE["tiered_suggestions"] = statement(
    f"""SELECT doc_id, clause_no, {_tiered(0)} || {_SUFFIX} AS suggestion,
        {_tiered(1)} || CASE WHEN requires_review THEN {msg(R.ADVICE_REVIEW_REASON, 'confidence_level')} ELSE '' END AS justification
        FROM (SELECT *, CASE WHEN risk_score > 7 THEN 'high' WHEN risk_score > 4 THEN 'medium' ELSE 'low' END AS tier FROM c_scored)""", "c_scored")


def prompt_rows(spark, sf_dir):
    s = scored(spark, sf_dir)
    clause = {c: F.col(c) for c in s.columns}
    return s.select(
        *KEY,
        RF.prompt_text(clause, RF.SYSTEMATIC_PROMPT).alias("systematic"),
        RF.prompt_text(clause, RF.EXPERT_PROMPT).alias("expert"),
        RF.prompt_text(clause, RF.FALLBACK_PROMPT).alias("fallback"))


def _prompt(template):
    factors = f"array_to_string({factor_list()}, ', ')"
    slots = {
        "prefix": _prefix(0), "intensifier": _prefix(1), "question": _guide("question"), "guidance": _guide("guidance"),
        "focus": _guide("focus"), "outcome": _guide("outcome"),
        "name": mapped("type", {t: v[0] for t, v in C.CLAUSE_TYPES.items()}, "type"),
        "plain_type": FIRST_BLANK, "upper_type": f"upper({FIRST_BLANK})", "score": plain("risk_score"), "level": "risk_level",
        "upper_level": "upper(risk_level)", "confidence_level": "confidence_level", "confidence": "printf('%.3f', confidence)",
        "review": "requires_review::VARCHAR", "factors": f"CASE WHEN {factors} = '' THEN 'None identified' ELSE {factors} END",
        "factors_specified": f"CASE WHEN {factors} = '' THEN 'None specified' ELSE {factors} END", "priority": "priority", "content": "content",
    }
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [q(head), f"({slots[name]})"]
    return " || ".join(out + [q(rest)])


QUERIES["prompt_rows"] = prompt_rows
ORACLE["prompt_rows"] = statement(
    f"""SELECT doc_id, clause_no, {_prompt(RF.SYSTEMATIC_PROMPT)} AS systematic, {_prompt(RF.EXPERT_PROMPT)} AS expert,
        {_prompt(RF.FALLBACK_PROMPT)} AS fallback FROM c_scored""", "c_scored")


def trust_report(spark, sf_dir):
    docs = with_clauses(spark, sf_dir)
    return docs.select("doc_id", RF.trust_report(F.col("clauses")).alias("t")).select("doc_id", "t.*")


QUERIES["trust_report"] = trust_report
ORACLE["trust_report"] = statement(
    """SELECT doc_id, conf_high AS high_confidence, review AS requires_review, n > 10 AS audit_recommended, mean_conf AS average_confidence,
        conf_low AS low_confidence FROM c_docs""", "c_docs")


def analyze(spark, sf_dir):
    a = analyze_documents(W.contracts_pii(spark, sf_dir))
    return a.select(
        "doc_id", "status", "overall_risk_score", "risk_level", F.size("clauses").alias("clauses"),
        F.array_join(F.transform("clauses", lambda c: c["type"]), ",").alias("clause_types"),
        F.array_join(F.transform("clauses", lambda c: F.concat(c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))), ",").alias("clause_spans"),
        F.aggregate("clauses", F.lit(0.0), lambda x, c: x + c["risk_score"]).alias("risk_total"),
        F.array_join("missing_clauses", ",").alias("missing_clauses"), F.array_join("recommendations", " | ").alias("recommendations"),
        "summary", "is_batch", "entities_redacted", "privacy_score", "compliance_level", "text_length",
        F.col("trust_report.requires_review").alias("requires_review"))


QUERIES["analyze_documents"] = analyze
ORACLE["analyze_documents"] = statement(
    f"""SELECT d.doc_id, 'completed' AS status, {rnd('risk', 1)} AS overall_risk_score, {risk_level('risk')} AS risk_level, d.n AS clauses,
        coalesce(c.clause_types, '') AS clause_types, coalesce(c.clause_spans, '') AS clause_spans, coalesce(c.risk_total, 0::DOUBLE) AS risk_total,
        array_to_string(missing, ',') AS missing_clauses, array_to_string({recommendations()}, ' | ') AS recommendations, {summary()} AS summary, is_batch,
        s.entities AS entities_redacted, s.privacy_score, {scale('s.privacy_score', P.COMPLIANCE_SCALE, 'CRITICAL')} AS compliance_level,
        text_length, review AS requires_review
        FROM a_docs d JOIN (SELECT doc_id, n AS entities, privacy_score FROM scores) s USING (doc_id) LEFT JOIN (
          SELECT doc_id, string_agg(type, ',' ORDER BY clause_no) AS clause_types, string_agg(start::VARCHAR || '-' || "end"::VARCHAR, ',' ORDER BY clause_no) AS clause_spans,
                 list_reduce(list_concat([0::DOUBLE], list(risk_score ORDER BY clause_no)), lambda a, x: a + x) AS risk_total
          FROM a_scored GROUP BY doc_id) c USING (doc_id)""", "a_docs", "scores")


def write_analysis_export(spark, sf_dir):
    """The whole analysis records written and read back; parts of the JSON are compared."""
    path = scratch_path(spark, "export")
    write_export(analyze_documents(W.contracts_pii(spark, sf_dir)), path, exported_at="2024-02-01T00:00:00Z")

    def part(place):
        return F.get_json_object("value", f"$.{place}")

    clauses = F.from_json(part("analysis.clauses"), "array<struct<type: string>>")
    return spark.read.text(path).select(
        part("document.doc_id").cast("long").alias("doc_id"), part("analysis.overall_risk_score").cast("double").alias("overall_risk_score"),
        part("analysis.risk_level").alias("risk_level"), F.size(clauses).cast("long").alias("clause_count"),
        F.array_join(F.from_json(part("analysis.missing_clauses"), "array<string>"), ",").alias("missing_clauses"), F.array_join(F.transform(clauses, lambda c: c["type"]), ",").alias("clause_types"), part("analysis.summary").alias("summary"),
        part("analysis.version").alias("version"), part("exportedAt").alias("exported_at"))


QUERIES["write_analysis_export"] = write_analysis_export
ORACLE["write_analysis_export"] = statement(
    f"""SELECT doc_id, {rnd('risk', 1)} AS overall_risk_score, {risk_level('risk')} AS risk_level, n::BIGINT AS clause_count, array_to_string(missing, ',') AS missing_clauses,
        coalesce(clause_types, '') AS clause_types, {summary()} AS summary, '{D.ANALYSIS_VERSION}' AS version, '2024-02-01T00:00:00Z' AS exported_at
        FROM a_docs LEFT JOIN (SELECT doc_id, string_agg(type, ',' ORDER BY clause_no) AS clause_types FROM a_scored GROUP BY doc_id) USING (doc_id)""", "a_docs", "a_scored")


def clause_type_rollup(spark, sf_dir):
    docs = with_clauses(spark, sf_dir)
    rows = item_rows(docs, RF.clause_type_rollup(F.col("clauses")), "doc_id").select("doc_id", "item.*")
    return rows.select("doc_id", "type", "n", round_half_up(F.col("running"), 6).alias("running"), round_half_up(F.col("mean"), 6).alias("mean"))


QUERIES["clause_type_rollup"] = clause_type_rollup
ORACLE["clause_type_rollup"] = statement(
    f"""SELECT doc_id, type, len(v)::INT AS n, {rnd('list_reduce(v, lambda a, x: (a + x) / 2)', 6)} AS running,
        {rnd('list_reduce(list_concat([0::DOUBLE], v), lambda a, x: a + x) / len(v)', 6)} AS mean
        FROM (SELECT doc_id, type, list(risk_score ORDER BY clause_no) AS v FROM c_scored GROUP BY 1, 2)""", "c_scored")


def risk_histogram(spark, sf_dir):
    return OC.risk_histogram(scored(spark, sf_dir))


QUERIES["risk_histogram"] = risk_histogram
ORACLE["risk_histogram"] = statement(
    "SELECT CASE WHEN risk_score <= 3 THEN 'Low Risk' WHEN risk_score <= 7 THEN 'Medium Risk' ELSE 'High Risk' END AS bucket, count(*) AS n FROM c_scored GROUP BY 1",
    "c_scored")


def highlight_segments(spark, sf_dir):
    found = clauses(spark, sf_dir).select(*KEY, "content", RF.risk_triggers(F.col("content")).alias("t"))
    cut = found.select(*KEY, RF.highlight_segments(F.col("content"), F.col("t")).alias("segments"))
    return item_rows(cut, "segments", *KEY, position="no").select(*KEY, (F.col("no") + 1).alias("seq"), "item.text", "item.kind")


QUERIES["highlight_segments"] = highlight_segments
ORACLE["highlight_segments"] = statement(
    """SELECT doc_id, clause_no, (row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY trigger_no, part))::INT AS seq, text, kind FROM (
         SELECT doc_id, clause_no, trigger_no, 1 AS part, content[last + 1:start] AS text, 'plain' AS kind FROM c_marks WHERE start > last
         UNION ALL SELECT doc_id, clause_no, trigger_no, 2, content[start + 1:stop], kind FROM c_marks
         UNION ALL SELECT doc_id, clause_no, 1000000, 1, content[tail + 1:length(content)], 'plain' FROM (
           SELECT b.doc_id, b.clause_no, b.content, coalesce(max_by(t."end", t.trigger_no), 0) AS tail
           FROM c_based b LEFT JOIN c_triggers t USING (doc_id, clause_no) GROUP BY 1, 2, 3) WHERE tail < length(content))""", "c_marks")
