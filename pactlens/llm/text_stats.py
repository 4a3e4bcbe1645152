"""Whole-text statistics as column expressions, shared by the quality rules and the quality classifier.

Everything is built in: no user function sees a text.  Counts come from one pattern each, because making an array of all words costs more
than several passes over the bytes.  Only texts that hold a repeated window pay for finding where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import SPACES, text_of

#: Words of a window; a window counts as repeated when its words stand in the text twice or more.
WINDOW = 5
#: Frequent function words of English, German, French and Spanish, counted as whole words in any case of A-Z.
STOP_WORDS = "the of and to der die und ist le la les des de est el los que en".split()
SPACE = r"[\x20\x09-\x0D]"
NO_WORD = r"[^\x20\x09-\x0D]"
STOP_PATTERN = f"(?i)(?<!{NO_WORD})(?:{'|'.join(STOP_WORDS)})(?!{NO_WORD})"
#: White space besides the space and the line end.
OTHER_SPACE = r"[\x09\x0B-\x0D]"

COUNTS = {
    "n_symbols": r"[#*$%&|<>]",
    "n_stop": STOP_PATTERN,
    "n_exclaim": r"[!?]",
    "n_upper": r"[A-Z]",
    "n_digits": r"[0-9]",
}


def let(value: Column, use) -> Column:
    """`use(value)`, with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(w: Column, h: Column) -> Column:
    """How many words lie in windows found twice or more, from the words and the hash of each window.

    Most texts hold no hash twice and need no more.  In the others, windows sorted by hash have equals as neighbours, which are compared
    word by word; the places of repeated ones, in order, cover up to WINDOW words each.
    """

    def starts(s: Column) -> Column:
        n = F.size(s)

        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, WINDOW) == F.slice(w, y["i"] + 1, WINDOW))

        def repeated(x: Column, j: Column) -> Column:
            before = F.when(j > 0, same(x, F.get(s, j - 1))).otherwise(F.lit(False))
            after = F.when(j < n - 1, same(x, F.get(s, j + 1))).otherwise(F.lit(False))
            return before | after

        return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p, F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct((acc["words"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("words"), i.alias("last")),
            lambda acc: acc["words"],
        )

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = let(ordered, lambda s: let(starts(s), covered))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found).cast("long")


def with_stats(docs: DataFrame, text: str, prefix: str = "s_") -> DataFrame:
    """Adds, each named with the prefix: n_chars, n_words, word_chars, n_lines, n_dup_lines, n_distinct, n_repeat_words
    and the COUNTS.

    A missing text counts as empty; every count of an empty text is 0.
    """
    p = prefix
    named = docs.withColumn(f"{p}t", text_of(docs[text]))
    t, w, lines = F.col(f"{p}t"), F.col(f"{p}w"), F.col(f"{p}l")
    named = named.withColumns({
        f"{p}w": F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " "),
        f"{p}l": F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
    })
    # the plain split is right but for other white space, or several in a row or at an end
    even = F.regexp_replace(t, SPACE + "+", " ")
    trimmed = F.when(F.octet_length(F.btrim(even)) > 0, F.split(F.btrim(even), " ")).otherwise(F.array().cast("array<string>"))
    named = named.withColumn(f"{p}u", F.array_contains(w, "") | t.rlike(OTHER_SPACE))
    named = named.withColumn(f"{p}w", F.when(F.col(f"{p}u"), trimmed).otherwise(w))
    n = F.size(w)
    windows = F.slice(F.arrays_zip(w, *(F.slice(w, k + 1, n) for k in range(1, WINDOW))), 1, n - (WINDOW - 1))
    hashes = F.when(n > WINDOW, F.transform(windows, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<long>"))
    named = named.withColumn(f"{p}h", hashes)
    spaces = F.when(F.col(f"{p}u"), F.regexp_count(t, F.lit(SPACE))).otherwise(n - 1)
    return named.withColumns({
        f"{p}n_chars": F.char_length(t).cast("long"),
        f"{p}n_words": n.cast("long"),
        f"{p}word_chars": (F.char_length(t) - spaces).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_distinct": F.size(F.array_distinct(w)).cast("long"),
        f"{p}n_repeat_words": _repeat_words(w, F.col(f"{p}h")),
        **{f"{p}{name}": F.regexp_count(t, F.lit(pattern)).cast("long") for name, pattern in COUNTS.items()},
    }).drop(f"{p}t", f"{p}l", f"{p}w", f"{p}u", f"{p}h")
