"""Uploads to stored batch documents: checks, cleaning, merging, statistics (L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.functions.cleaning import character_count, truncate_text, word_count
from pactlens.operators.documents import clean_batch_files, merge_batch
from pactlens.session import materialize


def ingest_batches(files: DataFrame) -> DataFrame:
    """batch_id, merged text, character and word counts from extracted files.

    Merging reads its input twice (block sums, then rows), so the cleaned texts are written to the
    shared folder first: every text is cleaned once.
    """
    merged = merge_batch(materialize(clean_batch_files(files), "cleaned-files"))
    return merged.select(
        "batch_id", "text", character_count(F.col("text")).alias("characters"), word_count(F.col("text")).alias("words")
    )


def batch_file_results(files: DataFrame, preview: int | None = D.PREVIEW_CHARS) -> DataFrame:
    """One row per file of a batch: the start of its cleaned text (None: all of it), its whole length, and its error.

    A file that failed has its error, an empty preview and length 0; the others of its batch don't suffer.
    """
    cleaned = clean_batch_files(files).select("batch_id", "ord", "original_name", "text", "error")
    shown = F.col("text") if preview is None else truncate_text(F.col("text"), preview)
    return cleaned.select(
        "batch_id", "ord", "original_name", shown.alias("preview"), F.length("text").cast("bigint").alias("characters"), "error"
    )


def batch_outcomes(files: DataFrame) -> DataFrame:
    """One row per batch: files, how many gave text, how many failed, status and error.

    A batch none of whose files holds readable text after cleaning is an error as a whole; its files keep errors of their own.
    """
    cleaned = clean_batch_files(files).select("batch_id", "text", "error")
    counts = cleaned.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("error").isNull() & (F.col("text") != "")).alias("readable"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    nothing = F.col("readable") == 0
    return counts.select(
        "*", F.when(nothing, "error").otherwise("uploaded").alias("status"), F.when(nothing, F.lit(D.ERR_NO_TEXT_IN_BATCH)).alias("error")
    )
