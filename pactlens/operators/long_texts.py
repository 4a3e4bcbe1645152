"""Spans over very long documents, in chunks of bounded size.

A document is cut into chunks, each with a margin of its neighbours, so that no task holds more than a chunk for patterns.  A span belongs
to the chunk in which it starts.  Overlaps are resolved by islands: spans that overlap one another directly or through others.  An island
starts where a span starts at or behind the furthest end so far; that running maximum is taken per chunk first, over the few rows of
chunks next, and inside each chunk last, so a document's spans are never ordered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions.spans import SPAN, SPANS, merge_overlapping_spans, redact_spans
from pactlens.functions.text import chunks_of, let
from pactlens.operators.rows import item_rows

#: Characters of a chunk, and of its neighbours on each side: longer matches may be missed where chunks meet.
CHUNK, MARGIN = 1 << 20, 4096


def chunk_documents(documents: DataFrame, chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """doc_id, chunk (from 0), text (of the chunk alone), around (with up to `margin` characters of its neighbours), lead (those before).

    A missing or empty text is one empty chunk.
    """

    def with_margins(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            before = F.coalesce(F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(margin))), F.lit(""))
            after = F.coalesce(F.left(F.get(pieces, i + 1), F.lit(margin)), F.lit(""))
            return F.struct(i.alias("chunk"), piece.alias("text"), F.concat(before, piece, after).alias("around"), F.length(before).alias("lead"))

        return F.transform(pieces, one)

    if margin > chunk:
        raise ValueError("a margin is at most a chunk")
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = let(chunks_of(text, chunk), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(""))))
    return item_rows(documents.select("doc_id", "text"), let(pieces, with_margins), "doc_id").select("doc_id", "item.*")


def spans_of_chunks(chunks: DataFrame, find: Callable[[Column], Column], chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, ord, span with offsets in the whole document, of the spans that start in each chunk."""
    found = item_rows(chunks.select("doc_id", "chunk", "lead", find(F.col("around")).alias("spans")), "spans", "doc_id", "chunk", "lead", position="ord", item="s")
    shift = F.col("chunk").cast("long") * chunk - F.col("lead")
    start, end = (F.col("s.start") + shift).cast("int"), (F.col("s.end") + shift).cast("int")
    span = F.struct(F.col("s.text"), F.col("s.label"), start.alias("start"), end.alias("end"), F.col("s.confidence"), F.col("s.replacement")).cast(SPAN)
    own = (F.col("s.start") >= F.col("lead")) & (F.floor(start / chunk) == F.col("chunk"))
    return found.filter(own).select("doc_id", "chunk", "ord", span.alias("span"))


def merge_span_rows(spans: DataFrame) -> DataFrame:
    """doc_id, span: `merge_overlapping_spans` over the rows (doc_id, chunk, ord, span) of each document, whatever their number."""
    end, start = F.col("span.end"), F.col("span.start")
    reach = spans.groupBy("doc_id", "chunk").agg(F.max(end).alias("far"))
    before = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.select("doc_id", "chunk", F.max("far").over(before).alias("far_before"))
    inside = Window.partitionBy("doc_id", "chunk").orderBy(start, "ord")
    so_far = F.greatest(F.col("far_before"), F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marked = spans.join(reach, ["doc_id", "chunk"]).withColumn("opens", F.coalesce(start >= so_far, F.lit(True)).cast("long"))
    counts = marked.groupBy("doc_id", "chunk").agg(F.sum("opens").alias("opened"))
    counts = counts.select("doc_id", "chunk", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("opened_before"))
    upto = F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = marked.join(counts, ["doc_id", "chunk"]).withColumn("island", F.col("opened_before") + upto)
    entry = F.struct(start.alias("at"), "chunk", "ord", "span")
    islands = numbered.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    merged = merge_overlapping_spans(F.transform("entries", lambda e: e["span"]))
    return item_rows(islands, merged, "doc_id", item="span")


def redact_chunks(chunks: DataFrame, merged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, chunk, redacted: the pieces of each document whose concatenation is the redacted document.

    A span that crosses chunks puts its token into the first and takes its text out of the others.
    """
    start, end = F.col("span.start"), F.col("span.end")
    over = F.explode(F.sequence(F.floor(start / chunk), F.floor((end - 1) / chunk))).alias("chunk")
    parts = merged.select("doc_id", "span", over).withColumn("from", (F.col("chunk") * chunk).cast("int"))
    local = F.struct(
        F.col("span.text"), F.col("span.label"), F.greatest(start - F.col("from"), F.lit(0)).alias("start"),
        F.least(end - F.col("from"), F.lit(chunk)).alias("end"), F.col("span.confidence"),
        F.when(start >= F.col("from"), F.col("span.replacement")).otherwise("").alias("replacement"),
    ).cast(SPAN)
    by_start = F.struct(local["start"].alias("at"), local.alias("span"))
    grouped = parts.groupBy("doc_id", F.col("chunk").cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(by_start)).alias("entries"))
    spans = F.coalesce(F.transform("entries", lambda e: e["span"]), F.array().cast(SPANS))
    joined = chunks.select("doc_id", "chunk", "text").join(grouped, ["doc_id", "chunk"], "left")
    return joined.select("doc_id", "chunk", let(spans, lambda s: redact_spans(F.col("text"), s)).alias("redacted"))
