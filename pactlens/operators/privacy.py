"""Privacy audits over document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.privacy import (
    compliance_level, deduction, find_and_merge, privacy_recommendations, privacy_score,
)
from pactlens.functions.spans import redact_spans
from pactlens.operators.rows import item_rows


def redact_documents(documents: DataFrame, patterns=None) -> DataFrame:
    """doc_id, redacted text, span count, score, level and spans: one narrow pass."""
    args = [] if patterns is None else [patterns]
    found = documents.select("doc_id", "text", find_and_merge(F.col("text"), *args).alias("spans"))
    scored = found.select("*", privacy_score(F.col("text"), F.col("spans")).alias("privacy_score"))
    return scored.select(
        "doc_id",
        redact_spans(F.col("text"), F.col("spans")).alias("redacted_text"),
        F.size("spans").alias("entities_redacted"),
        "privacy_score",
        compliance_level(F.col("privacy_score")).alias("compliance_level"),
        "spans",
        F.length("text").alias("text_length"),
    )


def audit_privacy(documents: DataFrame) -> DataFrame:
    """Score, span count, level and advice per document."""
    found = documents.select("doc_id", "text", find_and_merge(F.col("text")).alias("spans"))
    scored = found.select(
        "doc_id", "spans", F.length("text").alias("text_length"),
        privacy_score(F.col("text"), F.col("spans")).alias("privacy_score"),
    )
    labels = F.transform("spans", lambda s: s["label"])
    return scored.select(
        "doc_id",
        "privacy_score",
        F.size("spans").alias("entities_found"),
        compliance_level(F.col("privacy_score")).alias("compliance_level"),
        privacy_recommendations(F.size("spans"), F.col("privacy_score"), labels).alias("recommendations"),
        "spans",
        "text_length",
    )


def privacy_deductions(spans: DataFrame) -> DataFrame:
    """One row per span: label, deduction, text."""
    return item_rows(spans, "spans", "doc_id", position="span_no", item="s").select(
        "doc_id", "span_no", F.col("s.label").alias("label"),
        deduction(F.col("s.label")).alias("deduction"), F.col("s.text").alias("text"),
    )


def privacy_stats(audit: DataFrame) -> DataFrame:
    """Corpus roll-up in one pass of partial sums.

    Needs spans and text_length; processing times are reported when the column
    `processing_time` exists, else NULL.
    """
    hidden = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    share = F.when(F.col("text_length") > 0, hidden * 100.0 / F.col("text_length")).otherwise(0.0)
    time = F.col("processing_time") if "processing_time" in audit.columns else F.lit(None).cast("double")
    per_doc = audit.select(F.size("spans").alias("n"), share.alias("share"), time.alias("time"))
    return per_doc.agg(
        F.count("*").alias("total_documents_processed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities_redacted"),
        F.coalesce(F.avg(F.col("share").cast("decimal(20,10)")).cast("double"), F.lit(0.0)).alias("avg_redaction_percentage"),
        F.avg("time").alias("average_processing_time"),
        F.min("time").alias("min_processing_time"),
        F.max("time").alias("max_processing_time"),
    )


def entity_distribution(audit: DataFrame) -> DataFrame:
    """Number of spans per label."""
    return item_rows(audit, "spans", item="s").groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n"))
