"""Reviewer feedback and dashboard counters (G10, G11, G22, A11 defaults)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_defaults(events: DataFrame) -> DataFrame:
    """Feedback rows with the defaults of missing values (A11).  The id is added on write."""
    have = set(events.columns)

    def value(name: str, kind: str, default=None):
        column = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (column if default is None else F.coalesce(column, F.lit(default).cast(kind))).alias(name)

    metadata = F.col("additional_metadata") if "additional_metadata" in have else F.lit(None).cast("map<string,string>")
    return events.select(
        value("clause_id", "string"),
        value("original_text", "string", ""),
        value("model_prediction", "string", ""),
        value("model_confidence", "double", 0.0),
        value("user_correction", "string", ""),
        value("feedback_type", "string", "correction"),
        value("user_id", "string"),
        value("session_id", "string"),
        value("timestamp", "timestamp"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("additional_metadata"),
        F.lit(False).alias("is_processed"),
    )


def in_range(feedback: DataFrame, start, end) -> DataFrame:
    """Events from start to end, both included; pushed down to the scan."""
    ts = F.col("timestamp")
    return feedback.filter((ts >= F.lit(start).cast("timestamp")) & (ts <= F.lit(end).cast("timestamp")))


def feedback_summary(feedback: DataFrame, start, end) -> DataFrame:
    """Totals, corrections, mean confidence, users and agreement in a time range.

    Events without a user count as one further user; an empty range gives zeros.  Labels agree
    when they are equal or both missing.
    """
    agrees = F.col("model_prediction").eqNullSafe(F.col("user_correction")).cast("int")
    # events without a user share one reserved key, so one distinct count is enough
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("\x00none"))
    return in_range(feedback, start, end).agg(
        F.count("*").alias("total_feedback"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
        F.coalesce(F.avg(F.col("model_confidence").cast("decimal(18,6)")).cast("double"), F.lit(0.0)).alias("avg_confidence"),
        F.count_distinct(user).alias("unique_users_count"),
        F.coalesce(F.avg(agrees), F.lit(0.0)).alias("prediction_accuracy"),
    ).select("*", F.lit(start).cast("timestamp").alias("range_start"), F.lit(end).cast("timestamp").alias("range_end"))


def feedback_by_clause(feedback: DataFrame, label: str, limit: int = 100) -> DataFrame:
    """Newest feedback for one predicted label (G11); the id breaks ties."""
    wanted = feedback.filter(F.col("model_prediction") == label)
    return wanted.orderBy(F.col("timestamp").desc(), F.col("feedback_id").desc()).limit(limit)


def dashboard_rollup(audit: DataFrame, metrics: DataFrame, feedback: DataFrame, scores: DataFrame) -> DataFrame:
    """Privacy, fairness, feedback and confidence counters in one record.

    Each input is aggregated to one row on its own; the rows are stacked and folded, so no
    join is needed.
    """
    agrees = F.col("model_prediction").eqNullSafe(F.col("user_correction")).cast("int")

    def mean(column, scale="decimal(20,10)"):
        return F.coalesce(F.avg(column.cast(scale)).cast("double"), F.lit(0.0))

    parts = [
        audit.agg(
            F.coalesce(F.sum("entities_found"), F.lit(0)).alias("entities_redacted"),
            F.count("*").alias("documents_processed"),
            mean(F.col("privacy_score")).alias("average_privacy_score"),
        ),
        metrics.filter(F.col("is_overall") == 0).agg(
            F.count("*").alias("groups_audited"), mean(F.col("accuracy")).alias("average_accuracy")
        ),
        feedback.agg(
            F.count("*").alias("feedback_entries"),
            mean(F.col("model_confidence")).alias("average_feedback_confidence"),
            mean(1 - agrees).alias("improvement_rate"),
        ),
        scores.agg(
            F.count("*").alias("documents_scored"),
            mean(F.col("confidence_score")).alias("average_confidence"),
            F.count_if(F.col("requires_review")).alias("low_confidence_count"),
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
