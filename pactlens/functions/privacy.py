"""Personal data: detection, scores, levels and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import privacy as P
from pactlens.functions.spans import find_spans, merge_overlapping_spans
from pactlens.functions.text import drop_nulls, level_of, lookup, message


def detect_pii_configured(text: Column, patterns=P.CONFIGURED_PATTERNS) -> Column:
    """All matches of the configured patterns, ignoring case.

    `(?U)` makes word boundaries, digits and blanks Unicode-aware.
    """
    table = [
        {"regex": f"(?iU){regex}", "label": name.upper(), "confidence": 1.0, "replacement": token}
        for name, regex, token in patterns
    ]
    return find_spans(text, table)


def detect_pii_basic(text: Column, patterns=P.BASIC_PATTERNS) -> Column:
    """All matches of the basic patterns, case-sensitive, overlaps kept."""
    table = [
        {"regex": f"(?U){regex}", "label": label, "confidence": confidence, "replacement": f"[{label}]"}
        for label, regex, confidence in patterns
    ]
    return find_spans(text, table)


def find_and_merge(text: Column, patterns=P.CONFIGURED_PATTERNS) -> Column:
    """D1 followed by D3."""
    return merge_overlapping_spans(detect_pii_configured(text, patterns))


def privacy_score(text: Column, merged: Column) -> Column:
    """1 minus density and sensitivity of the spans, three decimals."""
    chars = F.aggregate(merged, F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    # summed in tenths, as integers, so that the order of the spans doesn't matter
    weights = {label: round(weight * 10) for label, weight in P.SENSITIVITY.items()}
    tenths = F.aggregate(merged, F.lit(0), lambda acc, s: acc + lookup(weights, s["label"], round(P.DEFAULT_SENSITIVITY * 10)))
    density = chars / F.length(text)
    sensitivity = tenths / (F.size(merged) * 10)
    raw = F.greatest(F.lit(0.0), 1.0 - (density * 2 + sensitivity * 0.5))
    score = F.floor(raw * 1000 + 0.5) / 1000.0
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(1.0)).when(F.size(merged) == 0, F.lit(1.0)).otherwise(score)


def compliance_level(score: Column, scale=P.COMPLIANCE_SCALE) -> Column:
    """HIGH, MEDIUM, LOW or CRITICAL."""
    return level_of(score, scale, "CRITICAL")


def privacy_recommendations(count: Column, score: Column, labels: Column) -> Column:
    """Count message, tier message and the urgent message."""
    return drop_nulls(
        F.when(count == 0, F.lit(P.MSG_NONE)).otherwise(message(P.MSG_FOUND, count)),
        F.when(score < 0.5, F.lit(P.MSG_CRITICAL))
        .when(score < 0.7, F.lit(P.MSG_WARNING))
        .when(score < 0.9, F.lit(P.MSG_CAUTION)),
        F.when(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in P.URGENT_LABELS])), F.lit(P.MSG_URGENT)),
    )


def basic_privacy_audit(spans: Column) -> Column:
    """Count-based score, level and two advice lines."""
    n = F.size(spans)
    return F.struct(
        F.least(n / 10.0, F.lit(1.0)).alias("privacy_score"),
        n.alias("entities_found"),
        F.when(n > 2, "CRITICAL").when(n > 0, "MODERATE").otherwise("SAFE").alias("compliance_level"),
        F.array(
            message(P.MSG_FOUND, n), F.when(n > 2, F.lit(P.MSG_CRITICAL)).otherwise(F.lit(P.MSG_REVIEW))
        ).alias("recommendations"),
    )


def deduction(label: Column) -> Column:
    """Points deducted for one span."""
    return lookup(P.DEDUCTIONS, label, P.DEFAULT_DEDUCTION)


def weighted_privacy_score(spans: Column) -> Column:
    """100 minus the deductions, and its level."""
    total = F.aggregate(spans, F.lit(0), lambda acc, s: acc + F.abs(deduction(s["label"])))
    score = F.greatest(F.lit(0), F.lit(100) - total)
    return F.struct(
        score.alias("score"), total.alias("total_deduction"), level_of(score, P.DEDUCTION_SCALE, "CRITICAL").alias("level")
    )
