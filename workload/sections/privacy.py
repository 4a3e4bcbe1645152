"""Privacy queries (D1-D13) and their SQL."""

from pyspark.sql import functions as F

from pactlens.fixed import privacy as P
from pactlens.functions import privacy as PF
from pactlens.functions import spans as SF
from pactlens.operators import long_texts as OL
from pactlens.operators import privacy as OP
from pactlens.operators.rows import item_rows
from pactlens.session import materialize
from workload import derived as W
from workload.sql import lst, mapped, msg, q, scale, statement

QUERIES, ORACLE = {}, {}

SPAN_COLUMNS = ["hit", "label", "start", "end", "confidence", "replacement"]


def span_rows(df, column="spans"):
    return item_rows(df, column, "doc_id", item="s").select(
        "doc_id", F.col("s.text").alias("hit"), F.col("s.label").alias("label"), F.col("s.start").alias("start"),
        F.col("s.end").alias("end"), F.col("s.confidence").alias("confidence"), F.col("s.replacement").alias("replacement"),
    )


def _detect(find):
    def run(spark, sf_dir):
        docs = W.contracts_pii(spark, sf_dir)
        return span_rows(docs.select("doc_id", find(F.col("text")).alias("spans")))
    return run


SPAN_SQL = 'SELECT doc_id, hit, label, start, "end", confidence, replacement FROM '
QUERIES["detect_pii_configured"] = _detect(PF.detect_pii_configured)
ORACLE["detect_pii_configured"] = statement(SPAN_SQL + "configured", "configured")
QUERIES["detect_pii_basic"] = _detect(PF.detect_pii_basic)
ORACLE["detect_pii_basic"] = statement(SPAN_SQL + "basic", "basic")
QUERIES["merge_overlapping_spans"] = _detect(PF.find_and_merge)
ORACLE["merge_overlapping_spans"] = statement(SPAN_SQL + "merged_rows", "merged_rows")


def redact_spans(spark, sf_dir):
    return OP.redact_documents(W.contracts_pii(spark, sf_dir)).select("doc_id", "redacted_text", "entities_redacted")


QUERIES["redact_spans"] = redact_spans
ORACLE["redact_spans"] = statement(
    "SELECT doc_id, r.text AS redacted_text, s.n AS entities_redacted FROM redacted r JOIN scores s USING (doc_id)", "redacted", "scores")


def redact_long_documents(spark, sf_dir):
    """The same from chunks of 1,000 characters, put together again."""
    size = 1000
    chunks = OL.chunk_documents(W.contracts_pii(spark, sf_dir), size, 300)
    merged = materialize(OL.merge_span_rows(materialize(OL.spans_of_chunks(chunks, PF.detect_pii_configured, size), "spans")), "merged-spans")
    pieces = OL.redact_chunks(chunks, merged, size).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "redacted"))).alias("p"))
    counts = merged.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    whole = F.array_join(F.transform("p", lambda x: x["redacted"]), "").alias("redacted_text")
    return pieces.join(counts, "doc_id", "left").select("doc_id", whole, F.coalesce("n", F.lit(0)).alias("entities_redacted"))


QUERIES["redact_long_documents"] = redact_long_documents
ORACLE["redact_long_documents"] = ORACLE["redact_spans"]


def redact_literal(spark, sf_dir):
    found = W.contracts_pii(spark, sf_dir).select("doc_id", "text", PF.detect_pii_basic(F.col("text")).alias("spans"))
    return found.select(
        "doc_id", SF.redact_literal(F.col("text"), F.col("spans")).alias("redacted_text"), F.size("spans").alias("entities_redacted"))


QUERIES["redact_literal"] = redact_literal
ORACLE["redact_literal"] = statement(
    """SELECT t.doc_id, coalesce(f.r.t, t.text) AS redacted_text, coalesce(f.n, 0) AS entities_redacted
       FROM contracts_pii t LEFT JOIN (
         SELECT doc_id, n, list_reduce(steps, lambda a, x: {'t': replace(a.t, x.s, '[' || x.l || ']'), 's': '', 'l': ''}) AS r
         FROM (SELECT b.doc_id, count(*) AS n, list_concat([{'t': any_value(t.text), 's': '', 'l': ''}],
                 list({'t': '', 's': hit, 'l': label} ORDER BY ord, i)) AS steps
               FROM basic b JOIN contracts_pii t USING (doc_id) GROUP BY b.doc_id)) f USING (doc_id)""", "basic")


def privacy_score(spark, sf_dir):
    return OP.redact_documents(W.contracts_pii(spark, sf_dir)).select("doc_id", "privacy_score")


QUERIES["privacy_score"] = privacy_score
ORACLE["privacy_score"] = statement("SELECT doc_id, privacy_score FROM scores", "scores")


def compliance_level(spark, sf_dir):
    scored = OP.redact_documents(W.contracts_pii(spark, sf_dir))
    return scored.groupBy("compliance_level").agg(F.count("*").alias("documents"), F.min("privacy_score").alias("lowest"))


LEVEL_SQL = scale("privacy_score", P.COMPLIANCE_SCALE, "CRITICAL")
QUERIES["compliance_level"] = compliance_level
ORACLE["compliance_level"] = statement(
    f"SELECT {LEVEL_SQL} AS compliance_level, count(*) AS documents, min(privacy_score) AS lowest FROM scores GROUP BY 1", "scores")

ADVICE_SQL = f"""array_to_string(list_filter([
    CASE WHEN n = 0 THEN {q(P.MSG_NONE)} ELSE {msg(P.MSG_FOUND, 'n')} END,
    CASE WHEN privacy_score < 0.5 THEN {q(P.MSG_CRITICAL)} WHEN privacy_score < 0.7 THEN {q(P.MSG_WARNING)}
         WHEN privacy_score < 0.9 THEN {q(P.MSG_CAUTION)} END,
    CASE WHEN list_has_any(labels, {lst(P.URGENT_LABELS)}) THEN {q(P.MSG_URGENT)} END], lambda m: m IS NOT NULL), ' | ')"""


def privacy_recommendations(spark, sf_dir):
    audit = OP.audit_privacy(W.contracts_pii(spark, sf_dir))
    return audit.select("doc_id", F.array_join("recommendations", " | ").alias("recommendations"))


QUERIES["privacy_recommendations"] = privacy_recommendations
ORACLE["privacy_recommendations"] = statement(f"SELECT doc_id, {ADVICE_SQL} AS recommendations FROM scores", "scores")


def audit_privacy(spark, sf_dir):
    audit = OP.audit_privacy(W.contracts_pii(spark, sf_dir))
    return audit.select(
        "doc_id", "privacy_score", "entities_found", "compliance_level", F.size("recommendations").alias("advice_count"),
        F.array_join("recommendations", " | ").alias("recommendations"))


QUERIES["audit_privacy"] = audit_privacy
ORACLE["audit_privacy"] = statement(
    f"""SELECT doc_id, privacy_score, n AS entities_found, {LEVEL_SQL} AS compliance_level,
        1 + (privacy_score < 0.9)::INT + (list_has_any(coalesce(labels, []), {lst(P.URGENT_LABELS)}))::INT AS advice_count, {ADVICE_SQL} AS recommendations FROM scores""",
    "scores")


def basic_privacy_audit(spark, sf_dir):
    found = W.contracts_pii(spark, sf_dir).select("doc_id", PF.detect_pii_basic(F.col("text")).alias("spans"))
    return found.select("doc_id", PF.basic_privacy_audit(F.col("spans")).alias("a")).select(
        "doc_id", "a.privacy_score", "a.entities_found", "a.compliance_level",
        F.array_join("a.recommendations", " | ").alias("recommendations"))


QUERIES["basic_privacy_audit"] = basic_privacy_audit
ORACLE["basic_privacy_audit"] = statement(
    f"""SELECT doc_id, least(n / 10.0::DOUBLE, 1.0::DOUBLE) AS privacy_score, n AS entities_found,
        CASE WHEN n > 2 THEN 'CRITICAL' WHEN n > 0 THEN 'MODERATE' ELSE 'SAFE' END AS compliance_level,
        {msg(P.MSG_FOUND, 'n')} || ' | ' || CASE WHEN n > 2 THEN {q(P.MSG_CRITICAL)} ELSE {q(P.MSG_REVIEW)} END AS recommendations
        FROM (SELECT t.doc_id, count(b.doc_id) AS n FROM contracts_pii t LEFT JOIN basic b USING (doc_id) GROUP BY t.doc_id)""", "basic")


def weighted_privacy_score(spark, sf_dir):
    found = W.contracts_pii(spark, sf_dir).select("doc_id", PF.find_and_merge(F.col("text")).alias("spans"))
    return found.select("doc_id", PF.weighted_privacy_score(F.col("spans")).alias("w")).select(
        "doc_id", F.col("w.score").alias("score"), F.col("w.total_deduction").alias("total_deduction"), F.col("w.level").alias("level"))


DEDUCTION_SQL = mapped("label", P.DEDUCTIONS, "-1")
QUERIES["weighted_privacy_score"] = weighted_privacy_score
ORACLE["weighted_privacy_score"] = statement(
    f"""SELECT doc_id, score, total_deduction, {scale('score', P.DEDUCTION_SCALE, 'CRITICAL')} AS level
        FROM (SELECT doc_id, total_deduction, greatest(0, 100 - total_deduction) AS score
              FROM (SELECT t.doc_id, coalesce(sum(d.points), 0)::INT AS total_deduction FROM contracts_pii t
                    LEFT JOIN (SELECT doc_id, abs({DEDUCTION_SQL}) AS points FROM merged_rows) d USING (doc_id) GROUP BY t.doc_id))""",
    "merged_rows")


def privacy_deductions(spark, sf_dir):
    found = W.contracts_pii(spark, sf_dir).select("doc_id", PF.find_and_merge(F.col("text")).alias("spans"))
    return OP.privacy_deductions(found).select("doc_id", F.col("span_no") + 1, "label", "deduction", "text").toDF(
        "doc_id", "span_no", "label", "deduction", "text")


QUERIES["privacy_deductions"] = privacy_deductions
ORACLE["privacy_deductions"] = statement(
    f"SELECT doc_id, span_no, label, {DEDUCTION_SQL} AS deduction, hit AS text FROM merged_rows", "merged_rows")


def privacy_stats(spark, sf_dir):
    stats = OP.privacy_stats(OP.audit_privacy(W.contracts_pii(spark, sf_dir)))
    return stats.select(
        "total_documents_processed", "total_entities_redacted",
        (F.floor(F.col("avg_redaction_percentage") * 1e6 + 0.5) / 1e6).alias("avg_redaction_percentage"))


QUERIES["privacy_stats"] = privacy_stats
ORACLE["privacy_stats"] = statement(
    """SELECT count(*) AS total_documents_processed, sum(n)::BIGINT AS total_entities_redacted,
        floor(avg(chars * 100.0::DOUBLE / text_length) * 1e6 + 0.5) / 1e6 AS avg_redaction_percentage FROM scores""", "scores")


def entity_distribution(spark, sf_dir):
    return OP.entity_distribution(OP.audit_privacy(W.contracts_pii(spark, sf_dir)))


QUERIES["privacy_entity_distribution"] = entity_distribution
ORACLE["privacy_entity_distribution"] = statement("SELECT label, count(*) AS n FROM merged_rows GROUP BY label", "merged_rows")
