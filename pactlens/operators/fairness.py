"""Fairness audit across groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.functions.text import message
from pactlens.operators.evaluation import label_counts, pair_counts, with_scores


def group_metrics(predictions: DataFrame, group: str = "contract_type") -> DataFrame:
    """Accuracy and weighted precision, recall, F1 per group and overall (group NULL).

    One aggregation of the predictions gives the pair counts; grouping sets on those counts
    add the overall rows without a second pass over the data.  Rows without a group count in
    the overall row only.
    """
    pairs = pair_counts(predictions, group)
    columns = [group, "true_label", "predicted_label"]
    both = pairs.groupingSets([columns, columns[1:]], *columns).agg(
        F.sum("n").alias("n"), F.grouping(group).alias("is_overall")
    ).filter((F.col("is_overall") == 1) | F.col(group).isNotNull())
    scores = with_scores(label_counts(both, group, "is_overall"))
    weighted = [
        (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1_score")
    ]
    return scores.groupBy(group, "is_overall").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), *weighted, F.sum("support").alias("sample_size")
    )


def bias_issues(
    metrics: DataFrame, group: str = "contract_type", threshold: float = D.DISPARITY_THRESHOLD,
    high: float = D.HIGH_DISPARITY, names: list[str] | None = None,
) -> DataFrame:
    """Metrics whose best and worst group differ by more than the threshold.

    Ties are settled by group name; fewer than two groups give no rows.
    """
    checked = [m for m in D.FAIRNESS_METRICS if names is None or m in names]
    pairs = ", ".join(f"'{m}', {m}" for m in checked)
    long = metrics.filter(F.col("is_overall") == 0).selectExpr(
        f"{group} as grp", "sample_size", f"stack({len(checked)}, {pairs}) as (metric, score)"
    )
    spread = long.groupBy("metric").agg(
        F.min_by("grp", F.struct(-F.col("score"), F.col("grp"))).alias("best_performing"),
        F.min_by("grp", F.struct(F.col("score"), F.col("grp"))).alias("worst_performing"),
        F.max("score").alias("best_score"),
        F.min("score").alias("worst_score"),
        F.min_by("sample_size", F.struct(F.col("score"), F.col("grp"))).alias("worst_sample_size"),
        F.count("*").alias("groups"),
    )
    gap = spread.withColumn("disparity", F.col("best_score") - F.col("worst_score"))
    found = gap.filter((F.col("groups") >= 2) & (F.col("disparity") > threshold))
    title = F.array_join(F.transform(F.split("metric", "_"), lambda w: F.initcap(w)), "_")
    return found.select(
        F.lit("performance_disparity").alias("type"),
        "metric",
        F.when(F.col("disparity") > high, "high").otherwise("medium").alias("severity"),
        "disparity",
        "best_performing",
        "worst_performing",
        "best_score",
        "worst_score",
        "worst_sample_size",
        message(
            "%s disparity of %s between %s and %s contracts",
            title, F.format_string("%.3f", F.bround("disparity", 3)), F.col("best_performing"), F.col("worst_performing"),
        ).alias("description"),
    )


def fairness_recommendations(issues: DataFrame) -> DataFrame:
    """Positive row without issues; else rows by severity and per small worst group."""
    totals = issues.agg(
        F.count("*").alias("all"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
    )

    def fixed(row, number: str | None = None):
        kind, priority, title, description, action = row
        text = F.lit(description) if number is None else message(description, F.col(number))
        return F.struct(
            F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(title).alias("title"),
            text.alias("description"), F.lit(action).alias("action"),
        )

    rows = F.array_compact(
        F.array(
            F.when(F.col("all") == 0, fixed(D.REC_POSITIVE)),
            F.when(F.col("high") > 0, fixed(D.REC_CRITICAL, "high")),
            F.when(F.col("medium") > 0, fixed(D.REC_WARNING, "medium")),
        )
    )
    by_severity = totals.select(F.inline(rows))
    kind, priority, title, description, action = D.REC_DATA
    worst, size = F.col("worst_performing"), F.col("worst_sample_size")
    small = (
        issues.filter(size < D.MIN_GROUP_SAMPLES)
        .select("worst_performing", "worst_sample_size")
        .distinct()
        .select(
            F.lit(kind).alias("type"), F.lit(priority).alias("priority"), message(title, worst).alias("title"),
            message(description, size, worst).alias("description"), message(action, worst).alias("action"),
        )
    )
    return by_severity.unionByName(small)


def audit_summary(metrics: DataFrame, issues: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Counts of issues by severity, groups and recommendations in one row."""
    parts = [
        issues.select(
            F.lit("total_bias_issues").alias("name"), F.lit(1).alias("n")
        ),
        issues.select(F.concat(F.col("severity"), F.lit("_severity_issues")).alias("name"), F.lit(1).alias("n")),
        metrics.filter(F.col("is_overall") == 0).select(F.lit("contract_types_analyzed").alias("name"), F.lit(1).alias("n")),
        recommendations.select(F.lit("total_recommendations").alias("name"), F.lit(1).alias("n")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    names = [
        "total_bias_issues", "high_severity_issues", "medium_severity_issues",
        "contract_types_analyzed", "total_recommendations",
    ]
    return union.agg(*[F.count_if(F.col("name") == n).alias(n) for n in names])


def issue_distribution(issues: DataFrame) -> DataFrame:
    """Issue counts by severity and by metric."""
    sides = F.array(
        F.struct(F.lit("severity").alias("dim"), F.col("severity").alias("value")),
        F.struct(F.lit("metric").alias("dim"), F.col("metric").alias("value")),
    )
    return issues.select(F.inline(sides)).groupBy("dim", "value").agg(F.count("*").alias("n"))
