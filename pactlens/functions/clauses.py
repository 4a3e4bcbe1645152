"""Clause extraction inside one row: candidates, context, de-duplication, top 25.

A document's clauses are found, compared and ranked within its own row, so extraction never
shuffles and the text never leaves its partition.  The text is cut into sentences once;
sentences without any keyword are dropped by one pattern before keywords are looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.functions.confidence import clause_confidence_level, rule_confidence
from pactlens.functions.text import (
    BUNDLE, WORD_END, WORD_START, any_word, chunks_of, fold, in_bundles, let, literal_table, strip, substring_of,
)

CANDIDATE = (
    "struct<ord:int,at:int,type:string,keyword:string,hit:string,content:string,lowered:string,start:int,end:int>"
)


def keyword_table(taxonomy=C.CLAUSE_TYPES) -> list[tuple[int, str, str]]:
    """(order, type, keyword) of the whole taxonomy."""
    pairs = [(t, k) for t, (_, keywords, _) in taxonomy.items() for k in keywords]
    return [(i, t, k) for i, (t, k) in enumerate(pairs)]


def any_keyword(taxonomy=C.CLAUSE_TYPES) -> str:
    """One pattern for all keywords as whole words."""
    return f"{WORD_START}{any_word(k for _, _, k in keyword_table(taxonomy))}{WORD_END}"


def sentences_with_keywords(text: Column, taxonomy=C.CLAUSE_TYPES) -> Column:
    """array<struct<at,body>> of the period-ended sentences that hold a keyword."""
    regex = any_keyword(taxonomy)
    kind = "struct<at:int,body:string>"

    def step(pos: Column, piece: Column) -> tuple[Column, Column]:
        entry = F.array(F.struct(pos.alias("at"), piece.alias("body")))
        return pos + F.length(piece) + 1, F.when(piece.rlike(regex), entry).otherwise(F.array().cast(f"array<{kind}>"))

    return let(
        F.split(text, r"\.", -1),
        lambda pieces: let(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda ended: fold(ended, F.lit(0), step, kind)),
    )


def clause_candidates(text: Column, taxonomy=C.CLAUSE_TYPES) -> Column:
    """All keyword matches with their context, in (type, keyword, position) order.

    A match is a whole keyword, at most 200 further characters and the period that ends the
    sentence; only the first such keyword position of a sentence counts, as matches may not
    overlap.  Context is 100 characters on both sides.
    """
    table = literal_table(
        {
            "ord": order, "type": clause_type, "keyword": keyword,
            "regex": rf"(?i){WORD_START}{keyword}{WORD_END}[^.]{{0,{C.SENTENCE_TAIL}}}[.]",
        }
        for order, clause_type, keyword in keyword_table(taxonomy)
    )

    def in_sentence(sentence: Column) -> Column:
        def match(k: Column) -> Column:
            return let(
                F.call_function("regexp_extract", F.concat(sentence["body"], F.lit(".")), k["regex"], F.lit(0)),
                lambda hit: F.struct(
                    k["ord"],
                    (sentence["at"] + F.length(sentence["body"]) + 1 - F.length(hit)).alias("at"),
                    k["type"],
                    k["keyword"],
                    hit.alias("hit"),
                ),
            )

        present = let(
            F.lower(sentence["body"]), lambda low: F.filter(table, lambda k: F.contains(low, k["keyword"]))
        )
        return F.filter(F.transform(present, match), lambda m: m["hit"] != "")

    def with_context(hit: Column, length: Column, chunks: Column) -> Column:
        start = F.greatest(F.lit(0), hit["at"] - C.CONTEXT_CHARS)
        end = F.least(length, hit["at"] + F.length(hit["hit"]) + C.CONTEXT_CHARS)
        return let(
            F.struct(start.alias("start"), end.alias("end")),
            lambda r: let(
                strip(substring_of(chunks, r["start"], r["end"] - r["start"])),
                lambda content: F.struct(
                    hit["ord"], hit["at"], hit["type"], hit["keyword"], hit["hit"],
                    content.alias("content"), F.lower(content).alias("lowered"), r["start"], r["end"],
                ).cast(CANDIDATE),
            ),
        )

    hits = F.sort_array(F.flatten(F.transform(sentences_with_keywords(text, taxonomy), in_sentence)))
    return let(
        F.struct(F.length(text).alias("length"), chunks_of(text).alias("chunks")),
        lambda t: F.transform(hits, lambda hit: with_context(hit, t["length"], t["chunks"])),
    )


#: Up to so many candidates of a type are compared with every kept one; beyond, a window index is asked.
COMPARED = 64
#: Text cells of the index.
CELLS = 64


def _compared(found: Column) -> Column:
    """Greedy de-duplication of a few candidates, each against every kept one."""

    def step(kept: Column, item: Column) -> Column:
        duplicate = let(
            F.substring(F.lower(item["hit"]), 1, C.DEDUPE_PREFIX),
            lambda p: F.exists(
                kept,
                lambda k: (F.abs(k["start"] - item["start"]) < C.DEDUPE_DISTANCE) | F.contains(k["lowered"], p),
            ),
        )
        keep = (F.length(item["content"]) > C.MIN_CLAUSE_CHARS) & ~duplicate
        return F.when(keep, F.concat(kept, F.array(item))).otherwise(kept)

    return F.aggregate(found, F.array().cast(f"array<{CANDIDATE}>"), step)


def window_pattern(keywords) -> str:
    """Captures what follows each place where a keyword starts, as far as a prefix reaches."""
    words = "|".join(re.escape(k.lower()) for k in keywords)
    return rf"(?s)(?=(?:{words}))(?=(.{{1,{C.DEDUPE_PREFIX}}}))"


def _indexed(found: Column, regex: Column) -> Column:
    """The same for any number of candidates: kept clauses are looked up in a hashed index, not gone through.

    A candidate's prefix starts with its keyword, and a short one ends with its only period.  So a kept
    clause contains it exactly if, behind one of the places where a keyword starts in the clause, either
    the next 50 characters or those up to the first period are the prefix.  Kept clauses put digests of these windows into the index,
    and their start under its number of 50-character slots: two kept starts never share a slot, so a start
    is near a kept one if its own slot is taken or that of a neighbouring slot lies near.

    The index is an array of CELLS texts, each holding the marks of its share of the hashes.  A fold copies its state at every step,
    so candidates go in bundles: the inner fold's state is the bundle's own marks, and the index, which it only reads, grows once a bundle.
    """
    mark_kind = "struct<cell:int,mark:string>"

    def cell_of(key: Column) -> Column:
        return F.pmod(key, F.lit(CELLS)).cast("int")

    def windows(item: Column) -> Column:
        first = F.call_function("regexp_extract_all", item["lowered"], regex, F.lit(1))
        both = F.transform(
            first,
            lambda w: F.array(
                F.when(F.length(w) == C.DEDUPE_PREFIX, w),
                F.when(F.contains(w, F.lit(".")), F.concat(F.substring_index(w, ".", 1), F.lit("."))),
            ),
        )
        return F.array_distinct(F.array_compact(F.flatten(both)))

    def slot_of(item: Column) -> Column:
        return F.floor(item["start"] / C.DEDUPE_DISTANCE).cast("long")

    def marks(item: Column) -> Column:
        texts = F.transform(windows(item), lambda w: F.struct(cell_of(F.xxhash64(w)).alias("cell"), F.concat(F.md5(w), F.lit(" ")).alias("mark")))
        start = F.concat(F.lit("@"), slot_of(item).cast("string"), F.lit("="), item["start"].cast("string"), F.lit(" "))
        return F.concat(texts, F.array(F.struct(cell_of(slot_of(item)).alias("cell"), start.alias("mark"))))

    def near(text: Column, item: Column, slot: Column) -> Column:
        """Whether a start kept in this text of marks, under this slot, lies near."""
        name = F.concat(F.lit("@"), slot.cast("string"), F.lit("="))
        value = F.substring_index(F.call_function("substring_index", text, name, F.lit(-1)), " ", 1)
        return F.contains(text, name) & (F.abs(value.try_cast("int") - item["start"]) < C.DEDUPE_DISTANCE)

    def inner(index: Column):
        def step(acc: Column, item: Column) -> Column:
            prefix = F.substring(F.lower(item["hit"]), 1, C.DEDUPE_PREFIX)
            contained = let(
                F.struct(F.concat(F.md5(prefix), F.lit(" ")).alias("mark"), F.get(index, cell_of(F.xxhash64(prefix))).alias("cell")),
                lambda p: F.contains(p["cell"], p["mark"]) | F.contains(acc["text"], p["mark"]),
            )
            close = F.exists(
                F.transform(F.array(F.lit(0), F.lit(-1), F.lit(1)), lambda d: slot_of(item) + d),
                lambda k: near(acc["text"], item, k) | near(F.get(index, cell_of(k)), item, k),
            )
            keep = (F.length(item["content"]) > C.MIN_CLAUSE_CHARS) & ~close & ~contained
            place = (acc["place"] + 1).alias("place")
            kept = let(
                marks(item),
                lambda more: F.struct(
                    place, F.concat(acc["text"], F.array_join(F.transform(more, lambda m: m["mark"]), "")).alias("text"),
                    F.concat(acc["marks"], more).alias("marks"), F.concat(acc["kept"], F.array(acc["place"])).alias("kept"),
                ),
            )
            return F.when(keep, kept).otherwise(F.struct(place, acc["text"].alias("text"), acc["marks"].alias("marks"), acc["kept"].alias("kept")))

        return step

    def outer(acc: Column, bundle: Column) -> Column:
        start = F.struct(
            (bundle * BUNDLE).alias("place"), F.lit("").alias("text"), F.array().cast(f"array<{mark_kind}>").alias("marks"),
            F.array().cast("array<int>").alias("kept"),
        )

        def grown(done: Column) -> Column:
            index = F.transform(
                acc["index"],
                lambda text, i: F.concat(text, F.array_join(F.transform(F.filter(done["marks"], lambda m: m["cell"] == i), lambda m: m["mark"]), "")),
            )
            return F.struct(index.alias("index"), F.concat(acc["kept"], F.array(done["kept"])).alias("kept"))

        return let(F.aggregate(F.slice(found, bundle * BUNDLE + 1, BUNDLE), start, inner(acc["index"])), grown)

    nothing = F.struct(F.array_repeat(F.lit(""), CELLS).alias("index"), F.array().cast("array<array<int>>").alias("kept"))
    places = F.aggregate(in_bundles(found), nothing, outer, lambda acc: F.flatten(acc["kept"]))
    return F.transform(places, lambda i: F.get(found, i))


def dedupe_clauses(candidates: Column, taxonomy=C.CLAUSE_TYPES, compared: int = COMPARED) -> Column:
    """Greedy de-duplication per type.

    A candidate is dropped when a kept clause of its type contains its first 50 characters or
    starts fewer than 50 characters away, or when its text has 30 characters or fewer.  Time grows in
    proportion to the candidates.
    """
    types = literal_table({"type": t, "regex": window_pattern(keywords)} for t, (_, keywords, _) in taxonomy.items())

    def of_type(found: Column, t: Column) -> Column:
        return let(
            F.filter(found, lambda c: c["type"] == t["type"]),
            lambda mine: F.when(F.size(mine) <= compared, _compared(mine)).otherwise(_indexed(mine, t["regex"])),
        )

    return let(candidates, lambda found: F.flatten(F.transform(types, lambda t: of_type(found, t))))


def top_clauses(kept: Column, limit: int | None = C.MAX_CLAUSES) -> Column:
    """One clause per start offset, by offset, at most `limit` (None: all), with confidence.

    array<struct<clause_no,type,content,start,end,confidence,confidence_level,requires_review>>
    """
    keyed = F.sort_array(
        F.transform(kept, lambda c: F.struct(c["start"], c["ord"], c["at"], c["type"], c["content"], c["end"]))
    )
    unique = let(
        keyed,
        lambda a: F.filter(a, lambda c, i: (i == 0) | (F.try_element_at(a, F.greatest(i, F.lit(1)))["start"] != c["start"])),
    )

    def finish(clause: Column, i: Column) -> Column:
        return let(
            rule_confidence(clause["content"], clause["type"]),
            lambda conf: F.struct(
                (i + 1).alias("clause_no"), clause["type"], clause["content"], clause["start"], clause["end"],
                conf.alias("confidence"),
                clause_confidence_level(conf).alias("confidence_level"),
                (conf < 0.7).alias("requires_review"),
            ),
        )

    return F.transform(unique if limit is None else F.slice(unique, 1, limit), finish)


def extract_clauses(text: Column, taxonomy=C.CLAUSE_TYPES, limit: int | None = C.MAX_CLAUSES) -> Column:
    """E1 to E4 of one text."""
    return top_clauses(dedupe_clauses(clause_candidates(text, taxonomy), taxonomy), limit)
