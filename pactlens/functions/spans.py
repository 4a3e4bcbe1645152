"""Spans: finding, merging and replacing stretches of text.

A span is struct<text, label, start, end, confidence, replacement>; offsets are zero-based
code points and `end` is exclusive.  All work is per row, so no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.functions.text import chunks_of, fold, let, literal_table, substring_of

SPAN = "struct<text:string,label:string,start:int,end:int,confidence:double,replacement:string>"
SPANS = f"array<{SPAN}>"


HIT = "struct<start:int,end:int,hit:string>"
HITS = f"array<{HIT}>"


def _fold_hits(pairs: Column) -> Column:
    """Running offsets over array<struct<gap,hit>>; an entry without a hit only moves on."""

    def step(pos: Column, pair: Column) -> tuple[Column, Column]:
        start = pos + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))

    return let(pairs, lambda p: fold(p, F.lit(0), step, HIT))


def pattern_hits(text: Column, regex: Column) -> Column:
    """array<struct<start,end,hit>> of all matches of a pattern that never matches ''.

    One pass of the pattern puts marks around its matches; plain splits at the marks then give
    the gaps and the matches, and offsets are the running sum of their lengths.  A text that
    holds the mark characters itself takes the slower way of matching twice.
    """
    opening, closing = "\x01", "\x02"
    none = F.array().cast(HITS)

    def from_marks(marked: Column) -> Column:
        def cut(pieces: Column) -> Column:
            # piece i (from 1 on) is "<hit> CLOSING <gap before the next hit>"
            def gap_before(i: Column) -> Column:
                before = F.element_at(pieces, i)
                return F.when(i == 1, before).otherwise(F.substring_index(before, closing, -1))

            pairs = F.transform(
                F.slice(pieces, F.lit(2), F.size(pieces)),
                lambda piece, i: F.struct(gap_before(i + 1).alias("gap"), F.substring_index(piece, closing, 1).alias("hit")),
            )
            return _fold_hits(pairs)

        return F.when(F.contains(marked, F.lit(opening)), let(F.split(marked, opening, -1), cut)).otherwise(none)

    def twice() -> Column:
        def cut(gaps: Column) -> Column:
            hits = F.regexp_extract_all(text, regex, F.lit(0))
            pairs = let(
                hits,
                lambda h: F.zip_with(
                    h, F.slice(gaps, F.lit(1), F.size(h)), lambda x, g: F.struct(g.alias("gap"), x.alias("hit"))
                ),
            )
            return _fold_hits(pairs)

        return let(F.split(text, regex, -1), cut)

    has_marks = F.contains(text, F.lit(opening)) | F.contains(text, F.lit(closing))
    return F.when(has_marks, twice()).otherwise(let(F.regexp_replace(text, regex, F.lit(f"{opening}$0{closing}")), from_marks))


def find_spans(text: Column, table: list[dict[str, object]]) -> Column:
    """Spans of all patterns of a table with regex, label, confidence and replacement, in table order."""

    def of_pattern(value: Column, p: Column) -> Column:
        return F.transform(
            pattern_hits(value, p["regex"]),
            lambda h: F.struct(
                h["hit"].alias("text"), p["label"], h["start"], h["end"], p["confidence"], p["replacement"],
            ),
        )

    return let(text, lambda value: F.flatten(F.transform(literal_table(table), lambda p: of_pattern(value, p))))


def merge_overlapping_spans(spans: Column) -> Column:
    """Resolve overlaps (D3): by start, higher confidence wins, then the longer, then the earlier.

    The order of spans with equal start is their order in the input.
    """
    ordered = F.sort_array(
        F.transform(
            spans, lambda s, i: F.struct(s["start"].alias("at"), i.alias("ord"), s.alias("span"))
        )
    )

    # the state is the last span kept so far, as only it can still be replaced
    def step(last: Column, item: Column) -> tuple[Column, Column]:
        span = item["span"]
        overlaps = last.isNotNull() & (span["start"] < last["end"])
        better = (span["confidence"] > last["confidence"]) | (
            (span["confidence"] == last["confidence"])
            & (span["end"] - span["start"] > last["end"] - last["start"])
        )
        done = F.when(overlaps | last.isNull(), F.array().cast(SPANS)).otherwise(F.array(last))
        return F.when(overlaps & ~better, last).otherwise(span), done

    def rest(last: Column) -> Column:
        return F.when(last.isNull(), F.array().cast(SPANS)).otherwise(F.array(last))

    return let(ordered, lambda spans: fold(spans, F.lit(None).cast(SPAN), step, SPAN, rest))


def redact_spans(text: Column, merged: Column) -> Column:
    """Replace each merged span by its token."""

    def pieces(t: Column) -> Column:
        spans, chunks = t["spans"], t["chunks"]

        def piece(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, i)["end"])
            return F.concat(substring_of(chunks, before, span["start"] - before), span["replacement"])

        tail = F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)

    parts = F.struct(merged.alias("spans"), chunks_of(text).alias("chunks"))
    return F.when(F.size(merged) == 0, text).otherwise(let(parts, pieces))


def redact_literal(text: Column, spans: Column) -> Column:
    """Replace every occurrence of each found string by its [LABEL], in detection order."""
    return F.aggregate(
        spans, text, lambda acc, s: F.replace(acc, s["text"], F.concat(F.lit("["), s["label"], F.lit("]")))
    )
