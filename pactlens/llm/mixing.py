"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target of words.  Complete epochs come first: all documents, as often as they fit.  What is left is filled by a weighted
sample without replacement: each document gets the key -ln(u) / weight, u a uniform number made of its id, and documents enter in the
order of their keys until the prefix sum of their sizes reaches the budget.

A source may hold a third of all rows, so no source is sorted as a whole.  Keys are cut into bins; sizes are summed by source and bin
before any shuffle of rows matters, the small table of bins is cumulated, and only the one bin of each source in which the budget ends is
ordered row by row.  Bins get narrower as the table grows, so that this last step stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.common import fresh, materialize, text_of, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Documents that one bin holds on average.
BIN_ROWS = 200
#: Tasks over which the rows of one source are dealt.
SALTS = 64
SYMBOLS = r"[#*$%&|<>]"


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) made of the key: 52 bits of its MD5."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(2**52)


def quality_weight(text: Column, size: Column) -> Column:
    """1 for texts without symbols, down to 0.1 where there is one for every second word or more."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.regexp_count(text, F.lit(SYMBOLS)) * 2.0 / F.greatest(size, F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target of a table of one row per source.

    Sources by code point, the missing one last, take the weights in turn and share `share` times the sum of sizes; targets stop at `most`
    times their source's size and the excess is shared again by weight until none is above.  That is one level for all: a source gets
    level x weight, or its limit where that is less.  Sorted by limit / weight, the sources at their limit come first, and the level
    follows from sums.  A source of size 0 has target 0; where all sources stop at their limits, each has its limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    rows = sizes.select("source", "source_size", turn.alias("w")).withColumns({
        "limit": F.col("source_size") * float(most), "budget": F.sum("source_size").over(all_rows) * float(share),
    })
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "limits_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "w_from": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    }).withColumn("level", (F.col("budget") - F.col("limits_before")) / F.col("w_from"))
    level = F.min(F.when(F.col("level") * F.col("w") < F.col("limit"), F.struct(F.col("limit") / F.col("w"), F.col("level").alias("level")))).over(all_rows)
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), level["level"] * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def key_share(sized: DataFrame) -> Column:
    """About the share of all rows with a smaller `key`: it rises with the key and is spread evenly over (0, 1).

    Keys of weight w follow 1 - exp(-w x), so the share is the mean of that over the weights, which are counted to one decimal.
    """
    classes = sized.groupBy(F.greatest(F.lit(1), F.least(F.lit(100), F.round(F.col("weight") * 10).cast("int"))).alias("w")).count().orderBy("w").collect()
    total = sum(r["count"] for r in classes)  # at most 100 classes
    parts = [F.lit(r["count"] / total) * (1.0 - F.exp(F.col("key") * (-r["w"] / 10))) for r in classes]
    return F.least(F.lit(1.0 - 2.0**-40), sum(parts, F.lit(0.0)))


def mix(sized: DataFrame, seed: int = 0, *, carry: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """doc_id, source, size, weight -> doc_id, size, source_size, target, epochs (times the document is taken), taken (words), and `carry`.

    The document at which the prefix sum crosses the budget is taken if that brings the source nearer to its target.  Rows that repeat a
    doc_id have the same key and are ordered by size; a missing doc_id has a key of its own kind like any other.  A document without
    words takes part with size 0.  Missing sources are one source.  An empty table gives an empty result.  The same rows and seed give
    the same mix, however they are partitioned.
    """
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)) / F.col("weight")
    keyed = sized.select("doc_id", "source", "size", key.alias("key"), *carry)
    count = keyed.agg(F.greatest(F.lit(1.0), F.ceil(F.count("*") / F.lit(float(bin_rows))))).scalar()
    keyed = keyed.withColumn("bin", F.floor(key_share(sized) * count).cast("long"))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").cast("long").alias("bin_size"))
    sources = targets(bins.groupBy("source").agg(F.sum("bin_size").cast("long").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("full", F.least(full, F.lit(int(most))).cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = bins.select("source", "bin", "bin_size", F.sum("bin_size").over(upto).alias("upto"))
    ends = ends.select(F.col("source").alias("s"), "bin", "bin_size", "upto").join(
        sources.withColumnRenamed("source", "z"), F.col("s").eqNullSafe(F.col("z"))
    ).filter((F.col("upto") - F.col("bin_size") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
    # one row per source: the bin in which the budget ends and what the bins before it hold
    ends = ends.select("s", F.col("bin").alias("end_bin"), (F.col("upto") - F.col("bin_size")).alias("before"))
    plan = sources.withColumnRenamed("source", "z").join(ends, F.col("s").eqNullSafe(F.col("z")), "left").drop("s")
    # the rows of a source are dealt over SALTS tasks, each of which gets the one row of its plan
    plan = plan.withColumn("plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("key", "size"), F.lit(SALTS)).cast("int"))
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("z")) & (F.col("salt") == F.col("plan_salt")), "left").drop("salt", "plan_salt")
    at_end = F.coalesce(F.col("bin") == F.col("end_bin"), F.lit(False))
    inside = rows.filter(at_end)
    order = Window.partitionBy("source").orderBy("key", "size", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(order)).withColumn(
        "extra", (F.col("sum") <= F.col("rest")) | ((F.col("sum") - F.col("rest")) < (F.col("rest") - (F.col("sum") - F.col("size"))))
    )
    others = rows.filter(~at_end).withColumns({"sum": F.lit(None).cast("long"), "extra": F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin"))})
    extra = F.when(F.col("extra") & (F.col("rest") > 0), 1).otherwise(0)
    taken = inside.unionByName(others).withColumn("epochs", F.col("full") + extra)
    return taken.select("doc_id", "size", F.col("source_size").cast("long"), "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"), *carry)


def sized_documents(docs: DataFrame, digest: str | None = None) -> DataFrame:
    """doc_id, source, size (words), weight of a table of documents, and the digest column named; a missing text has size 0."""
    text = text_of(docs["text"])
    size = word_count(text)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size.alias("size"), quality_weight(text, size).alias("weight"), *([docs[digest].alias("digest")] if digest else []))


def mixed_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes its document; rows without a doc_id are taken by their size like the others.

    The mix is decided on narrow rows; texts move once, to meet the decision by doc_id, source and a digest of the text.  Rows that are
    equal in these share what the mix takes of them as evenly as it goes.
    """
    told = F.concat(*(F.coalesce(F.concat(F.char_length(docs[c].cast("string")).cast("string"), F.lit(":"), docs[c].cast("string")), F.lit("-")) for c in ("source", "text")))
    digest = F.sha2(told, 256)
    name = fresh(docs, "text_digest")
    sized = materialize(sized_documents(docs.withColumn(name, digest), name), "sized")
    taken = mix(sized, seed, carry=("digest",)).groupBy(F.col("doc_id").alias("mixed_id"), F.col("digest").alias("mixed_digest")).agg(
        F.sum("epochs").alias("mixed_epochs"), F.count("*").alias("mixed_rows")
    )
    taken = materialize(taken.filter(F.col("mixed_epochs") > 0), "mix")
    joined = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(F.col("mixed_id")) & (digest == F.col("mixed_digest")))
    joined = joined.select(*(docs[c] for c in docs.columns), *taken.columns)
    once = joined.filter("mixed_rows = 1").withColumn("mixed_times", F.col("mixed_epochs"))
    order = Window.partitionBy("mixed_id", "mixed_digest").orderBy("mixed_id")
    several = joined.filter("mixed_rows > 1")
    evenly = F.floor(F.col("mixed_epochs") / F.col("mixed_rows")) + (F.row_number().over(order) <= F.col("mixed_epochs") % F.col("mixed_rows")).cast("int")
    rows = once.unionByName(several.withColumn("mixed_times", evenly)) if taken.filter("mixed_rows > 1").head(1) else once
    copies = F.explode(F.array_repeat(F.lit(1), F.col("mixed_times").cast("int"))).alias("mixed_copy")
    return rows.select(*docs.columns, copies).drop("mixed_copy")
