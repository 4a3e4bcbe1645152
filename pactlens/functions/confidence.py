"""Rule classifiers, confidence scores and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.functions.text import clamp, count_contained, first_rule, let, level_of, round_half_up


def classify_first_match(text: Column, rules=C.FIRST_MATCH_RULES) -> Column:
    """Ordered substring rules over 8 labels, else `other` (E5)."""
    return first_rule(text, rules, "other")


def classify_rules_13(text: Column, rules=C.EVALUATION_RULES) -> Column:
    """Ordered substring rules over 12 labels, else `other`."""
    return first_rule(text, rules, "other")


def classify_dominant(text: Column, keywords=C.DOMINANT_KEYWORDS) -> Column:
    """Label with the most keyword hits, the first one on ties, `general` without hits."""

    def best(low: Column) -> Column:
        scores = [
            F.struct(count_contained(low, words).alias("hits"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
            for i, (label, words) in enumerate(keywords.items())
        ]
        return let(
            F.array_max(F.array(*scores)), lambda top: F.when(top["hits"] > 0, top["label"]).otherwise(F.lit("general"))
        )

    return let(F.lower(text), best)


def legal_term_density(text: Column, terms=C.LEGAL_TERMS) -> Column:
    """struct<score,level,review>: share of the legal terms present."""
    share = let(F.lower(text), lambda low: count_contained(low, terms)) / float(len(terms))
    return let(
        F.least(share, F.lit(1.0)),
        lambda s: F.struct(
            s.alias("score"), level_of(s, C.DENSITY_SCALE, "VERY_LOW").alias("level"), (s < 0.6).alias("review")
        ),
    )


def rule_confidence(text: Column, label: Column, keywords=C.CONFIDENCE_KEYWORDS) -> Column:
    """Confidence from keyword hits of the label and text length, in [0.1, 0.95], three decimals."""

    def score(low: Column) -> Column:
        hits = None
        for name, words in keywords.items():
            hits = (F.when if hits is None else hits.when)(F.lower(label) == name, count_contained(low, words))
        bonus = F.least(F.lit(0.4), hits.otherwise(F.lit(0)) * 0.1)
        size = F.when(F.length(text) > 100, 0.1).when(F.length(text) < 20, -0.1).otherwise(0.0)
        return clamp(F.lit(0.5) + bonus + size, 0.1, 0.95)

    return round_half_up(let(F.lower(text), score), 3)


def softmax_confidence(logits: Column) -> Column:
    """Largest softmax probability of an array of logits, three decimals."""
    top = F.array_max(logits)
    total = let(
        top, lambda t: F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - t))
    )
    return round_half_up(1.0 / total, 3)


def confidence_level(score: Column, thresholds=C.CONFIDENCE_THRESHOLDS) -> Column:
    """HIGH, MEDIUM, LOW or VERY_LOW."""
    return level_of(score, thresholds, "VERY_LOW")


def clause_confidence_level(score: Column) -> Column:
    """high above 0.8, medium above 0.6, else low (E11, clause scale)."""
    return F.when(score > 0.8, "high").when(score > 0.6, "medium").otherwise("low")


def confidence_level_5(score: Column) -> Column:
    """struct<level,review> on the five-step scale."""
    return F.struct(
        level_of(score, C.CONFIDENCE_SCALE_5, "VERY_LOW").alias("level"), (score < 0.7).alias("review")
    )


def score_prediction(text: Column, prediction: Column | None = None) -> Column:
    """struct<prediction,confidence_score,confidence_level,requires_review>.

    Without a prediction (or where it is blank) the text is classified first.
    """
    given = F.lit(None).cast("string") if prediction is None else F.when(prediction != "", prediction)
    return let(
        F.coalesce(given, classify_first_match(text)),
        lambda label: let(
            rule_confidence(text, label),
            lambda s: F.struct(
                label.alias("prediction"),
                s.alias("confidence_score"),
                confidence_level(s).alias("confidence_level"),
                confidence_level(s).isin("LOW", "VERY_LOW").alias("requires_review"),
            ),
        ),
    )
