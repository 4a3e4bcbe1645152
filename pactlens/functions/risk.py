"""Clause and document risk, explanations, advice and prompts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import risk as R
from pactlens.functions.text import (
    WORD_END, WORD_START, clamp, contains_any, drop_nulls, let, literal_array, literal_table, lookup, message,
    round_half_up,
)


def plain_number(value: Column) -> Column:
    """Number as text without a trailing .0"""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def factors_of(clause_type: Column, taxonomy=C.CLAUSE_TYPES) -> Column:
    """The risk factors of a clause type, as written."""
    table = literal_table(
        {"type": t, "factor": factor} for t, (_, _, factors) in taxonomy.items() for factor in factors
    )
    return F.transform(F.filter(table, lambda r: r["type"] == clause_type), lambda r: r["factor"])


def base_clause_risk(content: Column, clause_type: Column, confidence: Column) -> Column:
    """Type multiplier, risk factors and phrases, scaled by confidence, one decimal in 1..10 (F1)."""

    def score(low: Column) -> Column:
        start = F.lit(float(R.BASE_RISK)) * lookup(R.TYPE_MULTIPLIERS, clause_type, 1.0)
        total = F.aggregate(
            factors_of(clause_type),
            start,
            lambda acc, f: acc + F.when(F.contains(low, F.lower(f)), F.lit(R.RISK_FACTOR_POINTS)).otherwise(F.lit(0.0)),
        )
        phrases = literal_table(
            {"phrase": p, "points": float(v)} for p, v in (R.RISK_PHRASES | R.MITIGATING_PHRASES).items()
        )
        present = F.filter(phrases, lambda p: F.contains(low, p["phrase"]))
        return F.aggregate(present, total, lambda acc, p: acc + p["points"])

    raw = let(F.lower(content), score) * (F.lit(0.3) + confidence * 0.7)
    return clamp(round_half_up(raw, 1), 1, 10)


def risk_factors(content: Column, clause_type: Column) -> Column:
    """`Contains X` for type factors, then the phrase-with-context factors (F2)."""

    def found(low: Column) -> Column:
        by_type = F.transform(
            F.filter(factors_of(clause_type), lambda f: F.contains(low, F.lower(f))),
            lambda f: F.concat(F.lit("Contains "), f),
        )
        in_context = drop_nulls(*[
            F.when(F.contains(low, F.lit(phrase)) & contains_any(low, context), F.lit(text))
            for phrase, context, text in R.CONTEXT_FACTORS
        ])
        return F.concat(by_type, in_context)

    return let(F.lower(content), found)


def risk_triggers(content: Column, clause_type: Column | None = None, type_triggers: dict[str, list[str]] | None = None) -> Column:
    """All whole-word hits of risk and mitigating phrases, by offset.

    array<struct<word,start,end,reason,weight,category,kind>>; `type_triggers` adds words for
    single clause types (weight 2.0), skipping words that are already in the fixed tables.
    """
    rows = [(w, wt, reason, cat, "risk", "") for w, wt, reason, cat in R.RISK_TRIGGERS]
    rows += [(w, wt, reason, cat, "mitigator", "") for w, wt, reason, cat in R.MITIGATORS]
    known = {w for w, *_ in rows}
    for t, words in (type_triggers or {}).items():
        for w in dict.fromkeys(words):
            if w.lower() not in known:
                rows.append((w, R.TYPE_TRIGGER_WEIGHT, R.MSG_TYPE_TRIGGER % (t, w), t, "clause_specific", t))
    table = literal_table(
        {
            "ord": i, "word": w, "lowered": w.lower(), "regex": f"(?i){WORD_START}{w.lower()}{WORD_END}",
            "reason": reason, "weight": float(wt), "category": cat, "kind": kind, "only": only,
        }
        for i, (w, wt, reason, cat, kind, only) in enumerate(rows)
    )

    def hits_of(t: Column) -> Column:
        def from_gaps(gaps: Column) -> Column:
            def entry(i: Column) -> Column:
                before = F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda acc, g: acc + F.length(g))
                return let(
                    before + (i - 1) * F.length(t["word"]),
                    lambda start: F.struct(
                        start.alias("start"), t["ord"], t["word"], (start + F.length(t["word"])).alias("end"),
                        t["reason"], t["weight"], t["category"], t["kind"],
                    ),
                )

            # `sequence` would count down for a text without a whole-word hit
            numbers = F.when(F.size(gaps) > 1, F.sequence(F.lit(1), F.size(gaps) - 1)).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(numbers, entry)

        return let(F.split(content, t["regex"], -1), from_gaps)

    def present(low: Column) -> Column:
        here = F.filter(table, lambda t: F.contains(low, t["lowered"]))
        return F.filter(here, lambda t: (t["only"] == "") | (t["only"] == clause_type)) if type_triggers else here

    ordered = F.sort_array(F.flatten(F.transform(let(F.lower(content), present), hits_of)))
    return F.transform(
        ordered,
        lambda t: F.struct(t["word"], t["start"], t["end"], t["reason"], t["weight"], t["category"], t["kind"]),
    )


def xai_risk(base: Column, triggers: Column) -> Column:
    """Base score plus 0.3 of each trigger weight, in 1..10, unrounded."""
    shift = F.aggregate(triggers, F.lit(0.0), lambda acc, t: acc + t["weight"] * R.TRIGGER_SCALE)
    return clamp(base + shift, 1, 10)


def xai_explanation(triggers: Column, clause_type: Column) -> Column:
    """Sentence naming the first three risk words and the first two mitigators."""

    def text(parts: Column) -> Column:
        def named(words: Column, n: int) -> Column:
            return F.array_join(
                F.transform(F.slice(words, 1, n), lambda t: F.concat(F.lit('"'), t["word"], F.lit('"'))), ", "
            )

        risks, helps = parts["risks"], parts["helps"]
        risk_text = F.concat(message(R.MSG_RISKS, F.size(risks)), message(R.MSG_KEY_CONCERNS, named(risks, 3)))
        help_text = message(R.MSG_MITIGATORS, F.size(helps), named(helps, 2))
        return F.when(
            (F.size(risks) == 0) & (F.size(helps) == 0), message(R.MSG_NO_TRIGGER, clause_type)
        ).otherwise(
            F.concat(
                F.when(F.size(risks) > 0, risk_text).otherwise(F.lit("")),
                F.when(F.size(helps) > 0, help_text).otherwise(F.lit("")),
            )
        )

    split = F.struct(
        F.filter(triggers, lambda t: t["kind"] != "mitigator").alias("risks"),
        F.filter(triggers, lambda t: t["kind"] == "mitigator").alias("helps"),
    )
    return let(split, text)


def risk_level(score: Column) -> Column:
    """low up to 3.5, medium up to 6.5, else high."""
    return F.when(score <= 3.5, "low").when(score <= 6.5, "medium").otherwise("high")


def clause_priority(score: Column, clause_type: Column) -> Column:
    """critical, high, medium or low by score and type."""
    return (
        F.when(score >= 8, "critical")
        .when((score >= 6) & clause_type.isin(C.CRITICAL_TYPES), "high")
        .when((score >= 5) & clause_type.isin(C.IMPORTANT_TYPES), "high")
        .when(score >= 4, "medium")
        .otherwise("low")
    )


@dataclass(frozen=True)
class Handbook:
    """Advice texts by clause type and modifiers by risk level.

    `guidance` maps a clause type (or `default`) to a dict with the keys question, guidance,
    language, focus and outcome; `modifiers` maps a level to (urgency prefix, intensifier).
    The texts are configuration: `pactlens.sources.readers.read_handbook` loads a company's own.
    """

    guidance: dict[str, dict[str, str]]
    modifiers: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(R.LEVEL_MODIFIERS))

    MAX_ENTRIES = 1000

    def __post_init__(self):
        if "default" not in self.guidance or "medium" not in self.modifiers:
            raise ValueError("a handbook needs the guidance entry 'default' and the level 'medium'")
        if len(self.guidance) > self.MAX_ENTRIES:
            raise ValueError(f"a handbook holds at most {self.MAX_ENTRIES} clause types")

    def guidance_for(self, clause_type: Column, name: str) -> Column:
        table = {t: texts.get(name, "") for t, texts in self.guidance.items()}
        return lookup(table, clause_type, table["default"])

    def modifier_for(self, level: Column, i: int) -> Column:
        table = {name: parts[i] for name, parts in self.modifiers.items()}
        return lookup(table, level, table["medium"])


def default_handbook() -> Handbook:
    """Short neutral guidance for every clause type, derived from the taxonomy."""
    guidance = {}
    for t, (name, _, factors) in C.CLAUSE_TYPES.items():
        listed = ", ".join(factors)
        guidance[t] = {
            "question": f"Which terms of this {name.lower()} clause are one-sided, open-ended or unusual?",
            "guidance": f"Check the {name.lower()} clause for: {listed}. Propose balanced wording for each one found.",
            "language": f"[Balanced {name.lower()} wording agreed by both parties]",
            "focus": listed,
            "outcome": f"A {name.lower()} clause that binds both parties alike",
        }
    guidance["default"] = {
        "question": "Which terms of this clause are one-sided, open-ended or unusual?",
        "guidance": "Check that duties are mutual, limited and clearly worded.",
        "language": R.HANDBOOK_LANGUAGE_DEFAULT,
        "focus": "one-sided duties, open-ended terms",
        "outcome": "A clause that binds both parties alike",
    }
    return Handbook(guidance)


def first_blank(clause_type: Column) -> Column:
    """The type name with its first underscore as a blank."""
    return F.regexp_replace(clause_type, "^([^_]*)_", "$1 ")


def handbook_suggestions(
    content: Column, clause_type: Column, level: Column, confidence_level: Column, review: Column,
    handbook: Handbook | None = None,
) -> Column:
    """struct<suggestion,justification,specific_language,action_items,expected_outcome>."""
    book = handbook or default_handbook()

    def build(x: Column) -> Column:
        prefix = book.modifier_for(F.lower(level), 0)
        sole = F.contains(x, F.lit("sole discretion"))
        unlimited = F.contains(x, F.lit("unlimited"))
        advice = (
            F.when(sole, F.lit(R.HANDBOOK_SOLE_DISCRETION[0]))
            .when(unlimited, F.lit(R.HANDBOOK_UNLIMITED[0]))
            .otherwise(book.guidance_for(clause_type, "guidance"))
        )
        template = book.guidance_for(clause_type, "language")
        language = (
            F.when(sole, F.lit(R.HANDBOOK_SOLE_DISCRETION[1]))
            .when(unlimited, F.lit(R.HANDBOOK_UNLIMITED[1]))
            .when(template == "", F.lit(R.HANDBOOK_LANGUAGE_DEFAULT))
            .otherwise(template)
        )
        suffix = F.when(review, F.lit(R.ADVICE_REVIEW_SUFFIX)).otherwise(F.lit(""))
        return F.struct(
            F.concat(prefix, advice, suffix).alias("suggestion"),
            message(R.HANDBOOK_JUSTIFICATION, first_blank(clause_type), confidence_level).alias("justification"),
            language.alias("specific_language"),
            literal_array(R.HANDBOOK_ACTIONS).alias("action_items"),
            message(R.HANDBOOK_OUTCOME, first_blank(clause_type)).alias("expected_outcome"),
        )

    return let(F.lower(content), build)


def advice_tier(score: Column) -> Column:
    return F.when(score > 7, "high").when(score > 4, "medium").otherwise("low")


def tiered_suggestions(
    content: Column, clause_type: Column, score: Column, confidence_level: Column, review: Column
) -> Column:
    """struct<suggestion,justification> by type and tier, without a handbook."""

    def build(x: Column) -> Column:
        tier = advice_tier(score)
        cells = []
        for i in (0, 1):
            by_type = lookup({f"{t}|{k}": v[i] for (t, k), v in R.TIERED_ADVICE.items()},
                             F.concat(clause_type, F.lit("|"), tier), None)
            cells.append(
                F.when(F.contains(x, F.lit("sole discretion")), F.lit(R.ADVICE_SOLE_DISCRETION[i]))
                .when(F.contains(x, F.lit("unlimited")), F.lit(R.ADVICE_UNLIMITED[i]))
                .otherwise(F.coalesce(by_type, lookup({k: v[i] for k, v in R.GENERIC_ADVICE.items()}, tier, None)))
            )
        suffix = F.when(review, F.lit(R.ADVICE_REVIEW_SUFFIX)).otherwise(F.lit(""))
        reason = F.when(review, message(R.ADVICE_REVIEW_REASON, confidence_level)).otherwise(F.lit(""))
        return F.struct(
            F.concat(cells[0], suffix).alias("suggestion"), F.concat(cells[1], reason).alias("justification")
        )

    return let(F.lower(content), build)


SYSTEMATIC_PROMPT = """{prefix}
Review the following contract clause.

Question: {question}

Type: {name}
Risk score: {score}/10 ({level})
Confidence: {confidence_level} ({confidence})
Human review required: {review}
Risk factors: {factors}
Priority: {priority}
Text: "{content}"

Guidance: {guidance}
{intensifier}
Answer as JSON with the keys suggestion, justification, specific_language, action_items, expected_outcome, alternatives.
Start the suggestion with: {prefix}"""

EXPERT_PROMPT = """Give expert advice on this {plain_type} clause.

Type: {upper_type}
Risk level: {upper_level} ({score}/10)
Risk factors: {factors_specified}
Text: "{content}"

Question: {question}
Focus: {focus}
Guidance: {guidance}
Urgency: {prefix}{intensifier}
Expected outcome: {outcome}
Answer as JSON with the keys suggestion, justification, riskReduction, specificLanguage, urgency, actionItems."""

FALLBACK_PROMPT = """Review this {plain_type} clause.

Type: {name}
Risk score: {score}/10 ({level})
Confidence: {confidence_level} ({confidence})
Risk factors: {factors}
Text: "{content}"

Answer as JSON with the keys suggestion, justification, specific_language, action_items, expected_outcome."""


def prompt_text(clause: dict[str, Column], template: str, handbook: Handbook | None = None) -> Column:
    """Fill a prompt template for one clause.

    `clause` names the columns type, content, risk_score, risk_level, confidence,
    confidence_level, requires_review, risk_factors and priority.  Any template over the slot
    names used by the three built-in ones works.
    """
    book = handbook or default_handbook()
    kind, level = clause["type"], clause["risk_level"]
    joined = F.array_join(clause["risk_factors"], ", ")

    def factors(none: str) -> Column:
        return F.when(joined == "", F.lit(none)).otherwise(joined)

    slots = {
        "prefix": book.modifier_for(F.lower(level), 0),
        "intensifier": book.modifier_for(F.lower(level), 1),
        "question": book.guidance_for(kind, "question"),
        "guidance": book.guidance_for(kind, "guidance"),
        "focus": book.guidance_for(kind, "focus"),
        "outcome": book.guidance_for(kind, "outcome"),
        "name": F.coalesce(lookup({t: v[0] for t, v in C.CLAUSE_TYPES.items()}, kind, None), kind),
        "plain_type": first_blank(kind),
        "upper_type": F.upper(first_blank(kind)),
        "score": plain_number(clause["risk_score"]),
        "level": level,
        "upper_level": F.upper(level),
        "confidence_level": clause["confidence_level"],
        "confidence": F.format_string("%.3f", clause["confidence"]),
        "review": clause["requires_review"].cast("string"),
        "factors": factors("None identified"),
        "factors_specified": factors("None specified"),
        "priority": clause["priority"],
        "content": clause["content"],
    }
    pieces, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(head), slots[name]]
    return F.concat(*pieces, F.lit(rest))


# ---- document level: all of these work on the clause array of one row

def missing_clauses(clauses: Column) -> Column:
    """The standard types without a clause, in standard order (F8)."""
    return F.array_except(literal_array(C.STANDARD_TYPES), F.transform(clauses, lambda c: c["type"]))


def _count(clauses: Column, test) -> Column:
    return F.size(F.filter(clauses, test))


def overall_risk(clauses: Column, text_length: Column) -> Column:
    """Confidence-weighted mean risk with document-level additions, 1..10, unrounded."""

    def score(cs: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))
        mean = F.aggregate(
            cs,
            zero,
            lambda a, c: F.struct(
                (a["w"] + c["confidence"]).alias("w"), (a["s"] + c["risk_score"] * c["confidence"]).alias("s")
            ),
            lambda a: F.when(a["w"] > 0, a["s"] / a["w"]).otherwise(F.lit(5.0)),
        )
        absent = F.size(F.array_except(literal_array(C.CRITICAL_TYPES), F.transform(cs, lambda c: c["type"])))
        high = _count(cs, lambda c: c["risk_score"] >= 7)
        total = (
            mean
            + absent * R.MISSING_CRITICAL_POINTS
            + F.when(text_length < R.SHORT_TEXT_CHARS, 1.0).otherwise(0.0)
            + F.when(high > F.size(cs) * R.HIGH_RISK_SHARE, R.HIGH_RISK_POINTS).otherwise(0.0)
        )
        return F.when(F.size(cs) == 0, F.lit(R.NO_CLAUSE_RISK)).otherwise(clamp(total, 1, 10))

    return let(clauses, score)


def recommendations(
    clauses: Column, missing: Column, text_length: Column, is_batch: Column, limit: int | None = R.MAX_RECOMMENDATIONS
) -> Column:
    """The first `limit` of the ordered document messages (F10); None gives all."""
    everything = all_recommendations(clauses, missing, text_length, is_batch)
    return everything if limit is None else F.slice(everything, 1, limit)


def all_recommendations(clauses: Column, missing: Column, text_length: Column, is_batch: Column) -> Column:
    """All document messages in order."""

    def build(cs: Column) -> Column:
        review = _count(cs, lambda c: c["requires_review"])
        critical = _count(cs, lambda c: c["priority"] == "critical")
        high = _count(cs, lambda c: c["risk_score"] > 7)
        total = F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + c["risk_score"])
        mean = F.when(F.size(cs) > 0, total / F.size(cs))
        names = {t: (C.CLAUSE_TYPES[t][0] if t in C.CLAUSE_TYPES else t).lower() for t in C.STANDARD_TYPES}
        per_missing = {t: R.REC_MISSING.get(t, R.REC_MISSING_OTHER % names[t]) for t in C.STANDARD_TYPES}
        head = drop_nulls(
            F.when(is_batch, F.lit(R.REC_BATCH)),
            F.when(review > 0, message(R.REC_REVIEW, review)),
            F.when(critical > 0, message(R.REC_CRITICAL, critical)),
            F.when(high > 0, message(R.REC_HIGH_RISK, high)),
        )
        tail = drop_nulls(
            F.when(text_length < R.SHORT_TEXT_CHARS, F.lit(R.REC_SHORT)),
            F.when(mean > 6, F.lit(R.REC_HIGH_MEAN)),
            F.lit(R.REC_PRIVACY),
            F.when(F.size(cs) > 10, F.lit(R.REC_FAIRNESS)),
        )
        middle = F.transform(missing, lambda t: lookup(per_missing, t, ""))
        return F.concat(head, middle, tail)

    return let(clauses, build)


def analysis_summary(clauses: Column, score: Column, missing: Column, is_batch: Column) -> Column:
    """The summary sentences of a document."""

    def build(cs: Column) -> Column:
        level = risk_level(score)

        def part(n: Column, template: str) -> Column:
            return F.when(n > 0, message(template, n)).otherwise(F.lit(""))

        missing_rental = F.size(F.array_intersect(missing, literal_array(C.RENTAL_TYPES)))
        return F.concat(
            F.when(is_batch, F.lit(R.SUM_BATCH)).otherwise(F.lit(R.SUM_SINGLE)),
            level,
            message(R.SUM_LEVEL, plain_number(score), F.size(cs)),
            part(_count(cs, lambda c: c["type"].isin(C.RENTAL_TYPES)), R.SUM_RENTAL),
            part(_count(cs, lambda c: c["requires_review"]), R.SUM_REVIEW),
            part(_count(cs, lambda c: c["risk_score"] > 7), R.SUM_HIGH),
            part(_count(cs, lambda c: c["priority"] == "critical"), R.SUM_CRITICAL),
            part(missing_rental, R.SUM_MISSING_RENTAL),
            part(F.size(missing), R.SUM_MISSING),
            F.lit(R.SUM_PRIVACY),
            lookup(R.SUM_END, level, None),
        )

    return let(clauses, build)


def trust_report(clauses: Column) -> Column:
    """struct of confidence and review counters; the mean is NULL without clauses."""

    def build(cs: Column) -> Column:
        total = F.aggregate(cs, F.lit(0.0), lambda acc, c: acc + c["confidence"])
        return F.struct(
            _count(cs, lambda c: c["confidence_level"] == "high").alias("high_confidence"),
            _count(cs, lambda c: c["requires_review"]).alias("requires_review"),
            (F.size(cs) > 10).alias("audit_recommended"),
            F.when(F.size(cs) > 0, total / F.size(cs)).alias("average_confidence"),
            _count(cs, lambda c: c["confidence"] < 0.7).alias("low_confidence"),
        )

    return let(clauses, build)


# ---- presentation of stored clauses

def clause_type_rollup(clauses: Column) -> Column:
    """array<struct<type,n,running,mean>> per clause type of one document.

    `running` is the value (v + risk) / 2 folded in clause order, not a mean; `mean` is the mean.
    """

    def build(cs: Column) -> Column:
        def entry(t: Column) -> Column:
            return let(
                F.transform(F.filter(cs, lambda c: c["type"] == t), lambda c: c["risk_score"]),
                lambda v: F.struct(
                    t.alias("type"),
                    F.size(v).alias("n"),
                    F.aggregate(v, F.lit(None).cast("double"), lambda a, x: F.coalesce((a + x) / 2, x)).alias("running"),
                    (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean"),
                ),
            )

        return F.transform(F.array_distinct(F.transform(cs, lambda c: c["type"])), entry)

    return let(clauses, build)


def risk_bucket(score: Column) -> Column:
    """Histogram bucket: up to 3, up to 7, above."""
    return F.when(score <= 3, "Low Risk").when(score <= 7, "Medium Risk").otherwise("High Risk")


def highlight_segments(content: Column, triggers: Column) -> Column:
    """array<struct<text,kind>>: plain, risk and mitigator pieces in reading order.

    Overlapping spans repeat their common text.
    """
    kind = "array<struct<text:string,kind:string>>"

    def build(spans: Column) -> Column:
        def pieces(span: Column, i: Column) -> Column:
            last = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"])
            before = F.when(
                span["start"] > last,
                F.struct(F.substring(content, last + 1, span["start"] - last).alias("text"), F.lit("plain").alias("kind")),
            )
            marked = F.struct(
                F.substring(content, span["start"] + 1, span["end"] - span["start"]).alias("text"),
                F.when(span["kind"] == "mitigator", F.lit("mitigator")).otherwise(F.lit("risk")).alias("kind"),
            )
            return drop_nulls(before, marked).cast(kind)

        last_end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
        tail = F.when(
            last_end < F.length(content),
            F.array(F.struct(F.substring(content, last_end + 1, F.length(content)).alias("text"), F.lit("plain").alias("kind"))),
        ).otherwise(F.array().cast(kind))
        return F.concat(F.flatten(F.transform(spans, pieces)), tail.cast(kind))

    return let(triggers, build)
