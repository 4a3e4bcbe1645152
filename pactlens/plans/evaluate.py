"""Labelled rows for training and evaluation (A6, A7) and the evaluation report (L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.functions.text import strip
from pactlens.functions.validation import label_from_filename
from pactlens.operators import evaluation as E
from pactlens.operators import fairness as A
from pactlens.operators.rows import item_rows
from pactlens.session import materialize

MIN_LABELLED_CHARS = 20
MIN_PARENT_CHARS = 50


def _input_of(text: str, limit: int | None) -> Column:
    return F.col(text) if limit is None else F.substring(text, 1, limit).alias(text)


def labeled_rows_from_files(rows: DataFrame, labels=C.TRAINING_LABELS, limit: int | None = D.MODEL_INPUT_CHARS) -> DataFrame:
    """(text, label) from annotation rows: texts longer than 20, cut to `limit`, known labels only."""
    text = strip(F.col("text"))
    label = label_from_filename(F.col("file_name"))
    return rows.select(text.alias("text"), label.alias("label")).filter(
        (F.length("text") > MIN_LABELLED_CHARS) & F.col("label").isin(list(labels))
    ).select(_input_of("text", limit), "label")


def _labelled(values: Column, label: str) -> Column:
    return F.transform(values, lambda v: F.struct(strip(v).alias("text"), F.lit(label).alias("label")))


def labeled_rows_from_wide(wide: DataFrame, mapping=C.WIDE_COLUMN_LABELS, limit: int | None = D.MODEL_INPUT_CHARS) -> DataFrame:
    """(text, label) from one column per annotation, each a string or an array of strings."""
    parts = []
    for column, label in mapping:
        if column not in wide.columns:
            continue
        values = F.col(f"`{column}`")
        if wide.schema[column].dataType.typeName() != "array":
            values = F.array(values)
        parts.append(_labelled(values, label))
    entries = F.flatten(F.array_compact(F.array(*parts)))
    long = item_rows(wide.filter(F.length("text") > MIN_PARENT_CHARS), entries).select("item.*")
    return long.filter(F.length("text") > MIN_LABELLED_CHARS).select(_input_of("text", limit), "label")


def predicted_rows(labelled: DataFrame, classify) -> DataFrame:
    """true_label and predicted_label of (text, label) rows under a classifier of one column, such as `classify_rules_13`."""
    return labelled.select(F.col("label").alias("true_label"), classify(F.col("text")).alias("predicted_label"))


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """One record from tables of one row and different columns, without a join."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def evaluation_report(predictions: DataFrame, labels=C.LABELS, model: str = "rules", evaluated_at=None) -> DataFrame:
    """One record of an evaluation: overall, per_class, confusion and metadata (L4).

    The predictions are counted once by label pair; all parts are made of those counts, whose
    number depends on the number of labels only.
    """
    pairs = materialize(E.pair_counts(predictions), "label-pairs")
    rows = pairs.select("true_label", "predicted_label", F.col("n").alias("weight"))
    scores = E.with_scores(E.label_counts(pairs))
    overall = E.overall_of(scores)
    per_class = E.with_scores(E.label_counts(pairs.unionByName(E.label_grid(pairs.sparkSession, labels)))).filter(F.col("label").isin(list(labels)))
    per_class = per_class.select("label", "precision", "recall", "f1_score", "support")
    known = rows.filter(F.col("true_label").isin(list(labels)) & F.col("predicted_label").isin(list(labels)))
    stamp = F.current_timestamp() if evaluated_at is None else F.lit(evaluated_at)
    metadata = F.struct(F.lit(model).alias("model"), stamp.cast("string").alias("evaluated_at"), F.lit(len(labels)).alias("classes"))
    return _one_row([
        overall.select(F.struct(*overall.columns).alias("overall")),
        per_class.agg(F.sort_array(F.collect_list(F.struct(*per_class.columns))).alias("per_class")),
        known.agg(F.sort_array(F.collect_list(F.struct("true_label", "predicted_label", F.col("weight").alias("n")))).alias("confusion")),
        pairs.sparkSession.range(1).select(metadata.alias("metadata")),
    ])


def fairness_audit(predictions: DataFrame, group: str = "contract_type") -> DataFrame:
    """One record of a fairness audit: overall, groups, issues, recommendations and summary."""
    metrics = materialize(A.group_metrics(predictions, group), "group-metrics")
    issues = materialize(A.bias_issues(metrics, group), "issues")
    recommendations = A.fairness_recommendations(issues)
    summary = A.audit_summary(metrics, issues, recommendations)
    scores = ["accuracy", "precision", "recall", "f1_score", "sample_size"]

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))

    return _one_row([
        metrics.filter("is_overall = 1").select(F.struct(*scores).alias("overall")),
        listed(metrics.filter("is_overall = 0").select(F.col(group).alias("name"), *scores), "groups"),
        listed(issues.select("metric", *[c for c in issues.columns if c != "metric"]), "issues"),
        listed(recommendations, "recommendations"),
        summary.select(F.struct(*summary.columns).alias("summary")),
    ])
