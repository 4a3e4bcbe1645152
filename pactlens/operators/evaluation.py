"""Model evaluation from label pairs.

Everything starts from pair counts, which are aggregated once with map-side combine; what
follows works on a table whose size depends on the number of labels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.fixed.clauses import LABELS
from pactlens.functions.text import message, round_half_up


def pair_counts(predictions: DataFrame, *groups: str) -> DataFrame:
    """Rows per (group, true, predicted)."""
    return predictions.groupBy(*groups, "true_label", "predicted_label").agg(F.count("*").alias("n"))


def label_grid(spark: SparkSession, labels=LABELS) -> DataFrame:
    """Every (true, predicted) pair of a taxonomy with a zero count, from two literal arrays."""
    names = F.array(*[F.lit(x) for x in labels])
    one = spark.range(1).select(F.explode(names).alias("true_label"))
    return one.select("true_label", F.explode(names).alias("predicted_label"), F.lit(0).cast("bigint").alias("n"))


def confusion_matrix(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Counts for every pair of the taxonomy, zeros included (G1)."""
    known = pair_counts(predictions).filter(F.col("true_label").isin(list(labels)) & F.col("predicted_label").isin(list(labels)))
    grid = label_grid(predictions.sparkSession, labels)
    return known.unionByName(grid).groupBy("true_label", "predicted_label").agg(F.sum("n").alias("n"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def label_counts(counts: DataFrame, *groups: str) -> DataFrame:
    """tp, support and predicted per label from pair counts: each pair feeds both of its labels."""
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("predicted_label").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        counts.select(*groups, F.inline(sides))
        .groupBy(*groups, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )


def with_scores(per_label: DataFrame) -> DataFrame:
    """Adds precision, recall and f1_score; zero division gives 0."""
    tp, support, predicted = (F.col(c) for c in ("tp", "support", "predicted"))
    return (
        per_label.withColumn("precision", ratio(tp, predicted))
        .withColumn("recall", ratio(tp, support))
        .withColumn("f1_score", ratio(tp * 2, support + predicted))
    )


def per_class_metrics(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Precision, recall, F1 and support per label of the taxonomy."""
    known = pair_counts(predictions).unionByName(label_grid(predictions.sparkSession, labels))
    return with_scores(label_counts(known)).filter(F.col("label").isin(list(labels))).select(
        "label", "precision", "recall", "f1_score", "support"
    )


def overall_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, macro means over the labels seen, support-weighted means."""
    return overall_of(with_scores(label_counts(pair_counts(predictions))))


def overall_of(scores: DataFrame) -> DataFrame:
    """The same from the scores of each label."""
    means = [F.avg(c).alias(f"macro_{m}") for c, m in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))]
    weighted = [
        (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}")
        for c, m in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))
    ]
    return scores.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), *means, *weighted, F.sum("support").alias("total_samples")
    )


def low_f1_classes(per_class: DataFrame, threshold: float = D.LOW_F1) -> DataFrame:
    """A warning per class below the threshold, one success row when there is none."""
    f1 = F.format_string("%.3f", round_half_up(F.col("f1_score"), 3))
    warnings = per_class.filter(F.col("f1_score") < threshold).select(
        F.lit("warning").alias("type"), F.col("label").alias("class_name"), message(D.MSG_LOW_F1, F.col("label"), f1).alias("message")
    )
    success = (
        per_class.agg(F.count_if(F.col("f1_score") < threshold).alias("low"))
        .filter(F.col("low") == 0)
        .select(F.lit("success").alias("type"), F.lit(None).cast("string").alias("class_name"), F.lit(D.MSG_F1_OK).alias("message"))
    )
    return warnings.unionByName(success)


def matrix_intensity(matrix: DataFrame) -> DataFrame:
    """Each cell relative to the largest one, in six bands (G20).  The matrix is labels x labels."""
    share = F.col("n") / F.max("n").over(Window.partitionBy())
    with_share = matrix.withColumn("intensity", share)
    i = F.col("intensity")
    band = F.when(i == 0, 0).when(i < 0.2, 1).when(i < 0.4, 2).when(i < 0.6, 3).when(i < 0.8, 4).otherwise(5)
    return with_share.withColumn("band", band)
