"""The flagship plan: contract texts to one nested analysis record per document (F16).

Every stage works on one row: gate, redaction, layout filter, clause extraction, scoring and
the document report.  The plan is a scan and projections, without any shuffle, so it scales
with the number of input splits alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.fixed.risk import MAX_RECOMMENDATIONS
from pactlens.functions import risk as R
from pactlens.functions.cleaning import clean_text, detect_batch_content
from pactlens.functions.clauses import extract_clauses
from pactlens.functions.layout import filter_layout_noise
from pactlens.functions.privacy import compliance_level, find_and_merge, privacy_score
from pactlens.functions.spans import redact_spans
from pactlens.functions.text import round_half_up
from pactlens.functions.validation import analysis_gate
from pactlens.operators.clauses import scored_clause


def prepare_documents(documents: DataFrame, redact: bool = True) -> DataFrame:
    """doc_id, error, privacy columns and the text that analysis reads.

    Layout rules need lines, so C16 runs on the redacted text with its newlines.
    """
    gated = documents.select("doc_id", "text", analysis_gate(F.col("text")).alias("error"))
    usable = F.when(F.col("error").isNull(), F.col("text"))
    spans = find_and_merge(usable) if redact else F.array().cast("array<string>")
    found = gated.select("doc_id", "error", usable.alias("original"), F.when(F.col("error").isNull(), spans).alias("spans"))
    if redact:
        score = F.when(F.col("error").isNull(), privacy_score(F.col("original"), F.col("spans")))
        text = redact_spans(F.col("original"), F.col("spans"))
    else:
        score, text = F.lit(None).cast("double"), F.col("original")
    redacted = found.select(
        "doc_id", "error", F.size("spans").alias("entities_redacted"), score.alias("privacy_score"), text.alias("redacted"),
    )
    return redacted.select(
        "doc_id", "error", "entities_redacted", "privacy_score", filter_layout_noise(F.col("redacted")).alias("text"),
    )


def analyze_documents(
    documents: DataFrame, redact: bool = True, handbook: R.Handbook | None = None, max_clauses: int | None = None,
    max_recommendations: int | None = MAX_RECOMMENDATIONS,
) -> DataFrame:
    """One analysis record per document (F16).  Input: doc_id, text.

    All clauses of a text enter the results.  With `max_clauses` the first so many do, and
    `clauses_left_out` tells how many more there were; so do `max_recommendations` and `recommendations_left_out`.
    """
    prepared = prepare_documents(documents, redact)
    found = prepared.select("*", extract_clauses(F.col("text"), limit=None).alias("found"))
    first = F.col("found") if max_clauses is None else F.slice("found", 1, max_clauses)
    extracted = found.select(
        "doc_id", "error", "entities_redacted", "privacy_score", "text", F.transform(first, scored_clause).alias("clauses"),
        (F.size("found") - F.size(first)).alias("clauses_left_out"),
    )

    def with_advice(c):
        advice = R.handbook_suggestions(
            c["content"], c["type"], c["risk_level"], c["confidence_level"], c["requires_review"], handbook
        )
        return c.withField("advice", advice)

    ok = F.col("error").isNull()
    reported = extracted.select(
        "doc_id",
        "error",
        "entities_redacted",
        "privacy_score",
        F.length("text").alias("text_length"),
        F.when(ok, detect_batch_content(F.col("text"))).alias("is_batch"),
        "clauses",
        "clauses_left_out",
        F.when(ok, R.missing_clauses(F.col("clauses"))).alias("missing"),
        F.when(ok, R.overall_risk(F.col("clauses"), F.length("text"))).alias("risk"),
    )
    reported = reported.select("*", R.all_recommendations(F.col("clauses"), F.col("missing"), F.col("text_length"), F.col("is_batch")).alias("messages"))
    first_messages = F.col("messages") if max_recommendations is None else F.slice("messages", 1, max_recommendations)
    return reported.select(
        "doc_id",
        F.when(ok, "completed").otherwise("error").alias("status"),
        "error",
        round_half_up(F.col("risk"), 1).alias("overall_risk_score"),
        F.when(ok, R.risk_level(F.col("risk"))).alias("risk_level"),
        F.transform("clauses", with_advice).alias("clauses"),
        F.col("missing").alias("missing_clauses"),
        F.when(ok, first_messages).alias("recommendations"),
        F.when(ok, F.size("messages") - F.size(first_messages)).alias("recommendations_left_out"),
        F.when(
            ok, R.analysis_summary(F.col("clauses"), F.col("risk"), F.col("missing"), F.col("is_batch"))
        ).alias("summary"),
        "is_batch",
        F.when(ok, R.trust_report(F.col("clauses"))).alias("trust_report"),
        "entities_redacted",
        "privacy_score",
        compliance_level(F.col("privacy_score")).alias("compliance_level"),
        "text_length",
        "clauses_left_out",
        F.lit(D.ANALYSIS_VERSION).alias("version"),
    )


def extract_file_text(documents: DataFrame) -> DataFrame:
    """The single-file path: C16, C1, cap at 100,000 characters, empty results as errors."""
    from pactlens.functions.cleaning import truncate_text

    cleaned = documents.select("doc_id", clean_text(filter_layout_noise(F.col("text"))).alias("text"))
    capped = truncate_text(F.col("text"), D.FILE_TEXT_CHARS)
    return cleaned.select(
        "doc_id", capped.alias("text"), F.when(F.col("text") == "", F.lit("No text could be extracted from the document")).alias("error")
    )
