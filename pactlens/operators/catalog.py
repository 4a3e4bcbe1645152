"""Document registry: listing, statistics, status (G12-G16, H4 batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import round_half_up
from pactlens.operators.blocks import bracket

#: Rows before a page up to which the first rows are simply sorted; types of sort values that a quantile sketch takes.
DEEP = 100_000
RANKED_TYPES = ("byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")


def matching(documents: DataFrame, status: str | None = None, risk_level: str | None = None) -> DataFrame:
    if status is not None:
        documents = documents.filter(F.col("status") == status)
    if risk_level is not None:
        documents = documents.filter(F.col("risk_level") == risk_level)
    return documents


def list_documents(
    documents: DataFrame, page: int = 1, limit: int = 10, status: str | None = None, risk_level: str | None = None,
    sort_by: str = "uploaded_at", ascending: bool = False, deep: int = DEEP,
) -> DataFrame:
    """One page of documents without their text (G12); the id breaks ties.

    A page that starts within `deep` rows is cut from the first rows in order.  For a later one the stretch of sort values that holds its
    first row is looked up by counts, so that what is sorted is that stretch and the page, never all rows before it.
    """
    rows, skip = matching(documents, status, risk_level).drop("text"), (page - 1) * limit
    if skip > deep and rows.schema[sort_by].dataType.typeName() in RANKED_TYPES:
        rows, skip = _from_rank(rows, sort_by, ascending, skip, deep)
    key = F.col(sort_by)
    return rows.orderBy(key.asc() if ascending else key.desc(), "id").offset(skip).limit(limit)


def _from_rank(rows: DataFrame, sort_by: str, ascending: bool, skip: int, deep: int) -> tuple[DataFrame, int]:
    """The rows that don't come before a stretch of sort values around the row after `skip`, and how many of them still do."""
    key, missing = F.col(sort_by), rows.filter(F.col(sort_by).isNull()).count()
    if ascending and skip < missing:  # missing values come first, and a page may reach beyond them
        return rows, skip
    known = rows.count() - missing
    first = skip - missing if ascending else skip
    if first >= known:
        return (rows.filter(F.lit(False)), 0) if ascending else (rows.filter(key.isNull()), first - known)
    found = bracket(rows.select(key.alias("v")), first + 1 if ascending else known - first, deep)
    if ascending:
        return (rows.filter(key.isNotNull()) if found.low is None else rows.filter(key > F.lit(found.low))), first - found.before
    kept = rows if found.high is None else rows.filter(key.isNull() | (key <= F.lit(found.high)))
    return kept, first - (known - found.before - found.inside)


def list_documents_after(
    documents: DataFrame, last, last_id, limit: int = 10, status: str | None = None, risk_level: str | None = None,
    sort_by: str = "uploaded_at", ascending: bool = False,
) -> DataFrame:
    """The page behind the row with sort value `last` and id `last_id` (G12): a range of the scan, however deep.  Rows without a sort
    value are not reached this way."""
    key, at = F.col(sort_by), F.lit(last)
    further = key > at if ascending else key < at
    rows = matching(documents, status, risk_level).drop("text").filter(further | ((key == at) & (F.col("id") > F.lit(last_id))))
    return rows.orderBy(key.asc() if ascending else key.desc(), "id").limit(limit)


def pagination(
    documents: DataFrame, page: int = 1, limit: int = 10, status: str | None = None, risk_level: str | None = None
) -> DataFrame:
    """Totals that go with a page."""
    pages = F.ceil(F.col("total_documents") / limit)
    return matching(documents, status, risk_level).agg(F.count("*").alias("total_documents")).select(
        F.lit(page).cast("bigint").alias("current_page"),
        pages.alias("total_pages"),
        "total_documents",
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def stats_overview(documents: DataFrame) -> DataFrame:
    """Totals and analysis rate in one aggregate."""
    counts = documents.agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("status") == "completed").alias("completed_analyses"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_documents"),
    )
    total, done = F.col("total_documents"), F.col("completed_analyses")
    return counts.withColumn("analysis_rate", F.when(total > 0, round_half_up(done / total * 100, 1)).otherwise(0.0))


def status_risk_distribution(documents: DataFrame) -> DataFrame:
    """Counts by status and, where present, by risk level, in one pass."""
    pairs = documents.groupBy("status", "risk_level").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.lit("status").alias("dim"), F.col("status").alias("value")),
        F.struct(F.lit("risk").alias("dim"), F.col("risk_level").alias("value")),
    )
    return (
        pairs.select("n", F.inline(sides))
        .filter((F.col("dim") == "status") | F.col("value").isNotNull())
        .groupBy("dim", "value")
        .agg(F.sum("n").alias("n"))
    )


def recent_documents(documents: DataFrame, n: int = 10) -> DataFrame:
    """The newest documents without their text."""
    return documents.drop("text").orderBy(F.col("uploaded_at").desc(), "id").limit(n)


def documents_by_risk(documents: DataFrame, level: str) -> DataFrame:
    """All documents of one risk level."""
    return documents.filter(F.col("risk_level") == level)


def latest_status(events: DataFrame) -> DataFrame:
    """Current status per document, last event wins, the event id breaks ties (H4)."""
    key = F.struct("ts", "event_id")
    return events.groupBy("doc_id").agg(
        F.max_by("status", key).alias("status"), F.max("ts").alias("ts"), F.max_by("event_id", key).alias("event_id")
    )
