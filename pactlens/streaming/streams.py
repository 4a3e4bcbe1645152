"""Streaming forms (H1-H4): the batch operators on arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlens.functions.cleaning import clean_text, filter_document_noise
from pactlens.functions.privacy import find_and_merge
from pactlens.functions.spans import redact_spans
from pactlens.operators.catalog import latest_status
from pactlens.sources.commits import Snapshot, Snapshots


def clean_and_redact(documents: DataFrame) -> DataFrame:
    """doc_id, cleaned and redacted text, span count; batch or stream, no state (H1)."""
    cleaned = documents.select("doc_id", clean_text(filter_document_noise(F.col("text"))).alias("cleaned"))
    found = cleaned.select("doc_id", "cleaned", find_and_merge(F.col("cleaned")).alias("spans"))
    return found.select(
        "doc_id", redact_spans(F.col("cleaned"), F.col("spans")).alias("redacted_text"), F.size("spans").alias("entities_redacted")
    )


def feedback_windows(
    feedback: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", two_step: bool = True
) -> DataFrame:
    """Feedback summary per window (H2), the same in batch and as a stream.

    Labels agree when they are equal or both missing; events without a user count as one further
    user.  Events are folded to one row per user and step, so the rows of a window are its distinct users and their number is exact.
    Sliding windows are folded in two steps: events to one partial row per slide and user, partial rows
    to windows.  An event is then not copied once per window (30 times for 30 days by 1 day).

    A stream is read in append mode: a window comes out once, when the watermark has passed its end, and nothing is written again.
    The last windows need an event that moves the watermark on (`closing_event`).
    """
    stream = feedback.withWatermark("timestamp", late) if feedback.isStreaming else feedback
    agrees = F.col("model_prediction").eqNullSafe(F.col("user_correction"))
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("\x00none"))
    confidence = F.col("model_confidence").cast("decimal(18,6)")
    step = slide if slide and two_step else width
    frame = F.window("timestamp", step, slide) if slide and not two_step else F.window("timestamp", step)
    sums = ["total_feedback", "corrections", "confidence_sum", "confidence_count", "agreements"]
    by_user = stream.groupBy(frame.alias("window"), user.alias("user")).agg(
        F.count("*").alias("total_feedback"),
        F.count_if(F.col("feedback_type") == "correction").alias("corrections"),
        F.sum(confidence).alias("confidence_sum"),
        F.count(confidence).alias("confidence_count"),
        F.count_if(agrees).alias("agreements"),
    )
    if slide and two_step:
        by_user = by_user.groupBy(F.window("window", width, slide).alias("window"), "user").agg(*[F.sum(c).alias(c) for c in sums])
    whole = by_user.groupBy("window").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("unique_users"))
    return whole.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "total_feedback",
        "corrections",
        F.try_divide(F.col("confidence_sum").cast("double"), F.col("confidence_count")).alias("avg_confidence"),
        "unique_users",
        F.try_divide("agreements", "total_feedback").alias("prediction_accuracy"),
    )


def closing_event(events: DataFrame, after: str, column: str = "timestamp") -> DataFrame:
    """One row with the schema of `events` and only a time, `after` (an interval) behind the last of them.

    Delivered to a stream, it moves the watermark past every window of the events; its own windows stay open and never come out.
    """
    last = events.agg((F.max(column) + F.expr(f"INTERVAL {after}")).alias(column)).filter(F.col(column).isNotNull())
    return last.select(*(F.col(f.name) if f.name == column else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))


def review_stream(clauses: DataFrame, late: str = "1 hour") -> DataFrame:
    """Clauses that need human review, each clause id once (H3)."""
    wanted = clauses.filter(F.col("requires_review"))
    if clauses.isStreaming:
        return wanted.withWatermark("ts", late).dropDuplicatesWithinWatermark(["clause_id"])
    return wanted.dropDuplicates(["clause_id"])


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; Parquet sink with exactly-once files."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


class StatusTable:
    """The current status per document: a base, and what has changed since, behind an atomic pointer (H4).

    A batch is folded into the changes; when these exceed a share of the base, both become a new base.  So a batch costs in proportion to
    the changes, and the base is rewritten once in about 1 / `share` of its rows.  At rest the table is two folders at most.
    """

    def __init__(self, spark: SparkSession, path: str, share: float = 0.25):
        self.spark, self.share, self.snapshots = spark, share, Snapshots(spark, path)

    def apply(self, events: DataFrame, batch: int) -> None:
        """Fold in a batch of events; one that the table holds already changes nothing."""
        now = self.snapshots.current()
        if now and batch <= now.batch:
            return
        base = {n: r for n, r in (now.parts if now else {}).items() if n.startswith("base")}
        changes = {n: r for n, r in (now.parts if now else {}).items() if n.startswith("changes")}
        rows = latest_status(self._with(events.select("doc_id", "status", "ts", "event_id"), changes, batch))
        name, n = self.snapshots.write(rows, "changes")
        if n > self.share * sum(base.values()):
            whole = latest_status(self._with(self.spark.read.parquet(f"{self.snapshots.path}/{name}"), base, batch))
            name, n = self.snapshots.write(whole, "base")
            base = {}
        self.snapshots.point_to(Snapshot(batch, base | {name: n}))

    def _with(self, rows: DataFrame, parts: dict[str, int], batch: int) -> DataFrame:
        before = self.snapshots.read(Snapshot(batch, parts)) if parts else None
        return rows.unionByName(before.select(*rows.columns)) if before is not None else rows

    def read(self) -> DataFrame:
        """One row per document."""
        return latest_status(self.snapshots.read())


def maintain_status(events: DataFrame, path: str, checkpoint: str, share: float = 0.25) -> StreamingQuery:
    """Keep the current status per document from a stream of status events (H4).

    The table itself is the state: a batch that is delivered again after a failure is recognised by its number, so a restart gives
    equal rows, and the stream holds no state store that grows with the documents.
    """
    table = StatusTable(events.sparkSession, path, share)
    query = (
        events.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    table.snapshots.clean()
    return query


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a table kept by `maintain_status`."""
    return StatusTable(spark, path).read()
