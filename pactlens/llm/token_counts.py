"""Token counts as delta-maintained rollups.

A change feed holds signed rows: an insert adds a document's tokens, a delete takes them back, a revision takes the old count back and adds
the new one.  Every batch of changes becomes additive deltas by source, language and tokenizer version, summed before the shuffle; totals
are sums of deltas, so no document is ever counted again.

Commits are idempotent.  A batch that was committed before is left out, and should two writers commit one batch at the same time, their
deltas are equal and `totals` reads one of them.  Deltas lie in a folder on shared storage, one sub-folder for each commit, written whole
by Spark's committer.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.common import text_of, word_count

KEYS = ("source", "lang", "tokenizer")
DELTAS = "batch_id string, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_changes long"
CHANGES = "batch_id string, change_id string, op string, source string, lang string, tokenizer string, tokens long, old_tokens long"

#: Tokenizer versions that need no vocabulary: runs between white space; runs of letters, runs of digits and single other characters.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^\x20\x09-\x0D]"}


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a tokenizer version; 0 for a missing text."""
    if tokenizer == "words-1":
        return word_count(text_of(text))
    return F.regexp_count(text_of(text), F.lit(TOKENIZERS[tokenizer])).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """One row per batch and key of additive changes.

    A change that is delivered twice in a batch (same change_id) counts once.  Missing counts are 0, a missing source or language is a key
    of its own, an unknown op changes nothing but is counted in n_changes.
    """
    op, new, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    signed = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old).otherwise(0)
    once = changes.groupBy("batch_id", "change_id", *KEYS, "op", "tokens", "old_tokens").agg(F.lit(1).alias("one")) if "change_id" in changes.columns else changes
    return once.groupBy("batch_id", *KEYS).agg(
        F.sum(sign).cast("long").alias("n_docs"), F.sum(signed).cast("long").alias("n_tokens"), F.count("*").alias("n_changes")
    )


class TokenRollup:
    """Totals in a folder of shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), []
        self._find()

    def _find(self) -> None:
        """Complete commits: those that Spark's committer has marked."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.listStatus(top) if fs.exists(top) else []
        made = [x.getPath() for x in found]
        self.parts = sorted(p.toString() for p in made if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def stored(self) -> DataFrame:
        """All deltas; a batch that two writers committed at once is there once."""
        empty = self.spark.createDataFrame([], DELTAS)
        if not self.parts:
            return empty
        return self.spark.read.schema(DELTAS).parquet(*self.parts).dropDuplicates(["batch_id", *KEYS])

    def commit(self, changes: DataFrame) -> None:
        """Commit the batches of the feed that are new; any number of batches at once."""
        known = self.stored().select("batch_id").distinct()
        new = deltas(changes.join(known, "batch_id", "left_anti") if self.parts else changes)
        new.write.parquet(f"{self.path}/commit-{uuid.uuid4().hex}")
        self._find()

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        sums = self.stored().groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.select(*KEYS, "n_docs", "n_tokens")


def document_changes(docs: DataFrame, least_words: int = 10) -> DataFrame:
    """The change feed of a corpus build, one scan: load every document under both tokenizers, take out those of fewer than `least_words`
    words, and revise the pieces of those with table lines, whose bars no longer count."""
    text = text_of(docs["text"])
    slim = docs.select(
        docs["doc_id"], docs["source"].alias("source"), docs["lang"].alias("lang"), token_count(text, "words-1").alias("words"),
        token_count(text, "pieces-2").alias("pieces"), F.regexp_count(text, F.lit(r"\|")).cast("long").alias("bars"),
    )

    def change(batch: str, op: str, tokenizer: str, new: Column, old: Column, when: Column = F.lit(True)) -> Column:
        fields = {"batch_id": F.lit(batch), "op": F.lit(op), "tokenizer": F.lit(tokenizer), "tokens": new.cast("long"), "old_tokens": old.cast("long")}
        return F.when(when, F.struct(*(v.alias(k) for k, v in fields.items())))

    none, w, p, bars = F.lit(None), F.col("words"), F.col("pieces"), F.col("bars")
    feed = F.array_compact(F.array(
        change("1-load", "insert", "words-1", w, none), change("1-load", "insert", "pieces-2", p, none),
        change("2-short", "delete", "words-1", none, w, w < least_words), change("2-short", "delete", "pieces-2", none, p, w < least_words),
        change("3-bars", "revise", "pieces-2", p - bars, p, (bars > 0) & (w >= least_words)),
    ))
    return slim.select("source", "lang", F.explode(feed).alias("c")).select("source", "lang", "c.*")


def rollup_of(batches: list[DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """Totals after committing the feeds in order."""
    rollup = TokenRollup(spark, path)
    reduce(lambda _, feed: rollup.commit(feed), batches, None)
    return rollup.totals()
