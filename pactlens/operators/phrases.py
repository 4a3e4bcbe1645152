"""Phrases of a large taxonomy in documents, by an index of their first words (E1, F2, F3 for tables of any size).

The column functions test each text against each phrase, which suits some hundred phrases.  Here a text gives its words with their
places and what follows them, as far as the longest phrase reaches; words are joined with the phrases that they begin, and what follows
decides.  So a text is gone through once, however many phrases there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.text import chunks_of, fold, let, substring_of
from pactlens.operators.rows import item_rows

WORD = r"\w+"
#: Characters of the pieces from which the runs are cut.
PIECE = 128
#: Most phrases that are sent to every task; larger tables are shuffled.
BROADCAST_PHRASES = 50_000


def phrase_table(phrases: DataFrame) -> DataFrame:
    """phrase, first (word), run (lower case), n (characters): distinct phrases that begin and end with a word; others can't be found."""
    kept = phrases.select("phrase").filter(F.col("phrase").rlike(r"^\w(.*\w)?$")).distinct()
    first = F.lower(F.regexp_extract("phrase", WORD, 0))
    return kept.select("phrase", first.alias("first"), F.lower("phrase").alias("run"), F.length("phrase").alias("n"))


def _words(text: Column, longest: int) -> Column:
    """array<struct<start,word,ahead>>: each word in lower case, and the text from there on, one character longer than a phrase."""

    def step(pos: Column, pair: Column) -> tuple[Column, Column]:
        return pos + pair["gap"] + pair["word"], F.array(pos + pair["gap"])

    def starts(words: Column, gaps: Column) -> Column:
        pairs = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda w, g: F.struct(F.length(g).alias("gap"), F.length(w).alias("word")))
        return let(pairs, lambda p: fold(p, F.lit(0), step, "int"))

    def with_starts(t: Column) -> Column:
        return F.zip_with(
            t["words"], starts(t["words"], t["gaps"]),
            lambda w, at: F.struct(at.alias("start"), F.lower(w).alias("word"), substring_of(t["chunks"], at, F.lit(longest + 1), PIECE).alias("ahead")),
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, WORD, -1).alias("gaps"), chunks_of(text, PIECE).alias("chunks")
    )
    return let(parts, with_starts)


def phrase_hits(documents: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, phrase, start, end: every place where a phrase stands as whole words, in any case.

    Words are runs of ASCII letters, digits and underscores, and what stands between the words of a phrase must stand between
    those of the text.  Phrases may overlap, with themselves too.  Phrases that differ in case only are found at the same places.
    """
    table = phrase_table(phrases)
    size = table.agg(F.count("*").alias("n"), F.max("n").alias("longest")).first()
    words = item_rows(documents.select(key, text), _words(F.col(text), size["longest"] or 0), key).select(key, "item.*")
    whole = (F.lower(F.substring("ahead", F.lit(1), F.col("n"))) == F.col("run")) & ~F.substring("ahead", F.col("n") + 1, F.lit(1)).rlike(r"\w")
    found = words.join(F.broadcast(table) if size["n"] <= BROADCAST_PHRASES else table, (F.col("word") == F.col("first")) & whole)
    return found.select(key, "phrase", "start", (F.col("start") + F.col("n")).alias("end"))
