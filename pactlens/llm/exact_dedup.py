"""Exact dedup by content sort, in DataFrame operations alone.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, which places equal texts next to each other,
and a window compares every text with its neighbour in full and folds the run of equals.  Spark does all three: `repartitionByRange`
samples splitters and looks each row up among them by binary search, `Sort` spills, and a window over (splitter columns, text) needs no
further exchange, because the range partitioning already keeps equal keys together.  Splitters hold the first characters and the digest
of a text, not the text, so that what the driver samples stays small.

A group of copies that holds more than a share of all rows would fill one task.  So the copies of each text are counted first (by digest,
combined before the shuffle), and the few texts above that share get a salt: the sort spreads them over several partitions, and their
size and the identifier that stays come from the counts.  At most 2 x partitions texts can hold that share, which bounds the broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import ascii_lower, at_least, fresh, text_of

#: Pieces into which a text that holds more than 1 / (2 x partitions) of all rows is dealt.
PIECES = 32
#: Characters of a text that its splitter holds; the rest of the order comes from the digest and the whole text.
HEAD = 32


def exact_groups(docs: DataFrame, keep: str = "largest", carry: bool = False, pieces: int = PIECES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; with `carry` a struct `row` of the whole input row.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest (or `smallest`) doc_id stays.
    A missing text counts as empty, so missing and empty texts are one group.  A missing doc_id loses against any other; a group of
    missing ids only keeps one of its rows, with keep_id NULL.  Rows that repeat a doc_id and a text count each in group_size, and one
    of them stays.  An empty table gives an empty result.  Further columns, whatever their names, don't matter.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    spark = docs.sparkSession
    n = at_least(spark, 2)
    text = ascii_lower(text_of(docs["text"]))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.alias("norm"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []),
    ).withColumn("sha", F.sha2("norm", 256))
    counts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.sha2(text, 256).alias("hot_sha")).groupBy("hot_sha").agg(
        F.count("*").alias("all_size"), (F.max if keep == "largest" else F.min)("doc_id").alias("all_id")
    )
    # more than 1 / 2n of all rows each, so at most 2n rows
    hot = counts.filter((F.col("all_size") > 1) & (F.col("all_size") * (2 * n) > docs.agg(F.count("*")).scalar()))
    salted = base.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").withColumn(
        "salt", F.when(F.col("hot_sha").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(pieces))).otherwise(F.lit(-1)).cast("int")
    )
    best = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    inside = Window.partitionBy("head", "key", "salt", "norm").orderBy(best)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # splitters are short: the first characters order the texts, the digest spreads those that begin alike
    salted = salted.withColumns({"head": F.substring("norm", 1, HEAD), "key": F.unhex("sha")})
    piece = salted.repartitionByRange(n, "head", "key", "salt").select(
        "doc_id", "sha", "salt", "all_id", "all_size", *(["row"] if carry else []),
        F.row_number().over(inside).alias("place"), F.first("doc_id").over(whole).alias("piece_id"), F.count("*").over(whole).alias("piece_size"),
    )
    whole_here = F.col("salt") < 0
    return piece.select(
        "doc_id",
        F.when(whole_here, F.col("piece_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.when(whole_here, F.col("piece_size")).otherwise(F.col("all_size")).cast("long").alias("group_size"),
        # equal identifiers share a salt, so one piece alone holds the row that stays
        ((F.col("place") == 1) & (whole_here | F.col("doc_id").eqNullSafe(F.col("all_id")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The input rows that stay, with all their columns."""
    return exact_groups(docs, keep, carry=True).filter("kept").select("row.*")
