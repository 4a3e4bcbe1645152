"""What both classifiers share: which labelled rows they may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that a classifier is fitted on; scores cover all rows.
TRAIN_ROWS = 12_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; such rows, and those without an id, are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of labelled rows that aren't held out, at most `rows` of them in the order of a hash of their id.

    An id that stands in several documents gives one row, with the text of the smallest hash; labelled ids without a document count
    towards the bound.
    """
    known = labels.filter(labels[label].isNotNull() & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(known["doc_id"].cast("long").alias("k")).agg(F.max(known[label].cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(rows)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).drop("k")
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r")).select("doc_id", "r.text", "r.y")
