"""Clause tables: extraction and scoring as flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions import clauses as C
from pactlens.functions import risk as R
from pactlens.functions.text import let, round_half_up
from pactlens.operators.rows import item_rows

FLAT = ["clause_no", "type", "content", "start", "end", "confidence", "confidence_level", "requires_review"]


def candidate_rows(documents: DataFrame) -> DataFrame:
    """One row per keyword match."""
    found = C.clause_candidates(F.col("text"))
    return item_rows(documents, found, "doc_id").select("doc_id", "item.*")


def deduped_rows(documents: DataFrame) -> DataFrame:
    """One row per candidate kept by the greedy rule."""
    kept = C.dedupe_clauses(C.clause_candidates(F.col("text")))
    return item_rows(documents, kept, "doc_id").select("doc_id", "item.*")


def clause_rows(documents: DataFrame) -> DataFrame:
    """The clause table: at most 25 rows per document (E4).  No shuffle."""
    return item_rows(documents, C.extract_clauses(F.col("text")), "doc_id").select("doc_id", "item.*")


def scored_clause(clause: Column) -> Column:
    """Adds score, level, factors, triggers, explanation and priority to one clause struct."""
    content, kind, conf = clause["content"], clause["type"], clause["confidence"]

    def with_triggers(triggers: Column) -> Column:
        def with_score(xai: Column) -> Column:
            return F.struct(
                *[clause[c] for c in FLAT],
                round_half_up(xai, 1).alias("risk_score"),
                F.upper(R.risk_level(xai)).alias("risk_level"),
                R.risk_factors(content, kind).alias("risk_factors"),
                R.clause_priority(xai, kind).alias("priority"),
                triggers.alias("triggers"),
                R.xai_explanation(triggers, kind).alias("explanation"),
            )

        return let(R.xai_risk(R.base_clause_risk(content, kind, conf), triggers), with_score)

    return let(R.risk_triggers(content), with_triggers)


def scored_rows(clauses: DataFrame) -> DataFrame:
    """Scores a flat clause table row by row."""
    whole = F.struct(*[F.col(c) for c in FLAT])
    return clauses.select("doc_id", scored_clause(whole).alias("c")).select("doc_id", "c.*")


def review_queue(clauses: DataFrame) -> DataFrame:
    """Adds `queue`: human_review or automatic."""
    return clauses.withColumn("queue", F.when(F.col("requires_review"), "human_review").otherwise("automatic"))


def risk_histogram(clauses: DataFrame) -> DataFrame:
    """Number of clauses per risk bucket."""
    return clauses.groupBy(R.risk_bucket(F.col("risk_score")).alias("bucket")).agg(F.count("*").alias("n"))
