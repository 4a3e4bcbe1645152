"""Uploads and batches: validity, admission, headers, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.functions.cleaning import clean_text, filter_document_noise, noise_findings, truncate_text
from pactlens.functions.text import message, strip
from pactlens.functions.validation import batch_size_error, document_violations, file_error
from pactlens.operators.blocks import running_total
from pactlens.operators.rows import item_rows

MAX_FILES = 50


def with_file_errors(files: DataFrame) -> DataFrame:
    """Adds `error`: the first failed check of each uploaded file."""
    return files.withColumn("error", file_error(F.col("original_name"), F.col("mime"), F.col("size")))


def valid_files(files: DataFrame) -> DataFrame:
    return with_file_errors(files).filter(F.col("error").isNull()).drop("error")


def file_errors(files: DataFrame) -> DataFrame:
    return with_file_errors(files).filter(F.col("error").isNotNull()).select("batch_id", "ord", "error")


def batch_sizes(files: DataFrame) -> DataFrame:
    """Total of the valid file sizes per batch and whether the batch is admitted.

    Batches of 200 MiB and less pass.  Sums are combined before the shuffle.
    """
    ok = file_error(F.col("original_name"), F.col("mime"), F.col("size")).isNull()
    totals = files.groupBy("batch_id").agg(F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("total_size"))
    error = batch_size_error(F.col("total_size"))
    return totals.select("batch_id", "total_size", error.isNull().alias("is_valid"), error.alias("error"))


def admitted_files(files: DataFrame) -> DataFrame:
    """Valid files of admitted batches; an oversized batch is rejected as a whole."""
    admitted = batch_sizes(files).filter("is_valid").select("batch_id")
    return valid_files(files).join(admitted, "batch_id", "left_semi")


def batch_header(files: DataFrame, limit: int | None = MAX_FILES) -> DataFrame:
    """One record per upload: joined names, total size, file count, per-file array.

    An upload of more than `limit` files is refused: its record has the count, an error and no
    files.  Its files are left out before anything is collected, so a batch of any size is one row.
    """
    entry = F.struct("ord", "filename", "original_name", "size", "mime")
    counts = files.groupBy("batch_id").agg(F.count("*").alias("file_count"))
    refused = F.lit(False) if limit is None else F.col("file_count") > limit
    allowed = files.join(counts.filter(~refused).select("batch_id"), "batch_id", "left_semi")
    grouped = allowed.groupBy("batch_id").agg(F.sum("size").alias("file_size"), F.sort_array(F.collect_list(entry)).alias("files"))
    headers = grouped.select(
        "batch_id",
        F.array_join(F.transform("files", lambda f: f["filename"]), ", ").alias("filename"),
        F.array_join(F.transform("files", lambda f: f["original_name"]), ", ").alias("original_name"),
        "file_size",
        F.lit(D.BATCH_MIME).alias("mime"),
        F.lit("uploaded").alias("status"),
        F.size("files").cast("bigint").alias("file_count"),
        "files",
        F.lit(None).cast("string").alias("error"),
    )
    errors = counts.filter(refused).select(
        "batch_id", F.lit(D.BATCH_MIME).alias("mime"), F.lit("error").alias("status"), "file_count",
        message("Too many files: %s, at most %s are accepted", F.col("file_count").cast("string"), F.lit(str(limit))).alias("error"),
    )
    return headers.unionByName(errors, allowMissingColumns=True)


def clean_batch_files(files: DataFrame) -> DataFrame:
    """C8 and C1 on every extracted file; failed files keep their error and no text."""
    cleaned = clean_text(filter_document_noise(F.col("text")))
    return files.withColumn("text", F.when(F.col("error").isNull(), cleaned).otherwise(F.lit("")))


def merge_batch(files: DataFrame, cap: int | None = D.BATCH_TEXT_CHARS, block: int = 1000) -> DataFrame:
    """Concatenate a batch's texts in file order with separators, capped with a marker (C20); `cap` None keeps all.

    `ord` numbers the files of a batch.  Files that start beyond the cap cannot reach the
    result, so they are dropped by their start offset before anything is collected: a batch
    of any size contributes at most the capped number of characters to one group.
    """
    name, error = F.col("original_name"), F.col("error")
    body = F.when(strip(F.coalesce(F.col("text"), F.lit(""))) == "", message(D.PLACEHOLDER_EMPTY, name)).otherwise(F.col("text"))
    piece = F.when(
        error.isNotNull(), F.concat(message(D.SEPARATOR_FAILED, name), message(D.PLACEHOLDER_FAILED, error))
    ).otherwise(F.concat(message(D.SEPARATOR, name), body))
    # no piece can show more than the capped text, so longer ones are cut before the shuffle
    shown = F.col("piece") if cap is None else F.substring("piece", 1, cap + 1)
    pieces = files.select("batch_id", "ord", piece.alias("piece")).select(
        "batch_id", "ord", (F.length("piece") + 2).alias("step"), shown.alias("piece")
    )
    placed = running_total(pieces, ["batch_id"], "ord", "step", "at", block, ties=["piece"])
    within = F.lit(True) if cap is None else F.col("at") <= cap + 2
    reachable = placed.filter(within).select("batch_id", F.struct("at", "piece").alias("entry"))
    merged = reachable.groupBy("batch_id").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    text = F.array_join(F.transform("entries", lambda e: e["piece"]), "\n\n")
    merged = merged.select("batch_id", text.alias("text"))
    return merged if cap is None else merged.select(
        "batch_id", truncate_text(F.col("text"), cap, D.BATCH_MARKER).alias("text")
    )


def constraint_violations(documents: DataFrame) -> DataFrame:
    """Number of rows per broken rule of the stored document."""
    rules = document_violations({c: F.col(c) for c in documents.columns})
    return item_rows(documents, rules, item="rule").groupBy("rule").agg(F.count("*").alias("n"))


def analyze_noise(documents: DataFrame) -> DataFrame:
    """doc_id, noise_chars, noise_percentage, category, pattern, matches, examples.

    One row for each pattern that a document matches, with the totals of the document; a document without noise has one row with 0 and no
    pattern.  An empty text has no percentage.
    """
    found = documents.select("doc_id", F.length("text").alias("n"), noise_findings(F.col("text")).alias("found"))
    total = F.aggregate("found", F.lit(0), lambda a, x: a + x["chars"])
    share = F.when(F.col("n") > 0, F.floor(total * 100.0 / F.col("n") * 100 + 0.5) / 100.0)
    totals = found.select("doc_id", total.alias("noise_chars"), share.alias("noise_percentage"), "found")
    rows = totals.select("doc_id", "noise_chars", "noise_percentage", F.explode_outer("found").alias("f"))
    return rows.select("doc_id", "noise_chars", "noise_percentage", "f.category", "f.pattern", "f.matches", F.array_join("f.examples", " | ").alias("examples"))
