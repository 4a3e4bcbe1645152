"""Layout filtering: header, body and footer by line position (C11-C17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import noise as N
from pactlens.functions.text import (
    any_pattern, any_word, count_contained, expand_whitespace, let, normalize_whitespace, pattern, replace_all, strip,
)

LINE_PATTERNS = [(N.LINE_NOISE_FAST.get(s, s), flags) for group in N.LINE_NOISE.values() for s, flags in group]
INDICATOR = any_word(N.LAYOUT_INDICATORS)
STOP = any_pattern(N.BODY_STOP_PATTERNS)


# all line patterns start at a line start, so one test of them costs next to nothing elsewhere
ANY_LINE = "(?md)^(?:" + "|".join(expand_whitespace(s.removeprefix("^")) for s, _ in LINE_PATTERNS) + ")"


def replace_noise_lines(text: Column, replacement: str) -> Column:
    """Apply the line patterns in order; a text without any such line is left alone."""
    return let(text, lambda t: F.when(t.rlike(ANY_LINE), replace_all(t, LINE_PATTERNS, replacement)).otherwise(t))


def _count_matching(text: Column, patterns) -> Column:
    total = F.lit(0)
    for source, flags in patterns:
        total = total + text.rlike(pattern(source, flags)).cast("int")
    return total


def document_structure(text: Column) -> Column:
    """Header, footer and table flags, first contract line and body range (C11).

    Line numbers are zero-based; `body_end` is exclusive; `contract_start` is -1 when none.
    """

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        head_end = F.floor(n * N.HEADER_SHARE).cast("int")
        foot_start = F.floor(n * N.FOOTER_START_SHARE).cast("int")
        head = F.lower(F.array_join(F.slice(lines, F.lit(1), head_end), " "))
        foot = F.lower(F.array_join(F.slice(lines, foot_start + 1, n), " "))

        def assemble(flags: Column) -> Column:
            start = F.when(flags["header"], head_end).otherwise(0)
            end = F.when(flags["footer"], foot_start).otherwise(n)
            body = F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")
            # text up to the first indicator: its line breaks give the line number
            first = let(
                F.regexp_extract(body, f"(?s)^.*?{INDICATOR}", 0),
                lambda head_part: F.when(head_part != "", start + F.size(F.split(head_part, "\n", -1)) - 1).otherwise(-1),
            )
            return let(
                F.struct(start.alias("start"), end.alias("end"), first.alias("first")),
                lambda s: F.struct(
                    flags["header"].alias("has_header"),
                    flags["footer"].alias("has_footer"),
                    flags["tabular"].alias("has_table"),
                    s["first"].alias("contract_start"),
                    F.when(s["first"] > s["start"], F.greatest(s["start"], s["first"] - 2))
                    .otherwise(s["start"])
                    .alias("body_start"),
                    s["end"].alias("body_end"),
                ),
            )

        def flags_of(texts: Column) -> Column:
            header = _count_matching(texts["head"], N.LAYOUT_REGIONS["headerRegion"]) >= N.MIN_HEADER_INDICATORS
            table = _count_matching(texts["head"], N.TABULAR_PATTERNS) > 0
            footer = _count_matching(texts["foot"], N.LAYOUT_REGIONS["footerRegion"]) > 0
            return F.struct(header.alias("header"), footer.alias("footer"), (header & table).alias("tabular"))

        return let(
            let(F.struct(head.alias("head"), foot.alias("foot")), flags_of),
            assemble,
        )

    return let(F.split(text, "\n", -1), of_lines)


def remove_first(text: Column, source: str, flags: str) -> Column:
    """Delete only the first match; the rest of the text is matched once and put back."""
    return F.regexp_replace(text, f"(?s{flags})^(.*?){pattern(source)}(.*)$", "$1$2")


def filter_body_noise(text: Column) -> Column:
    """Delete noise lines and identity numbers, then short and stamp-like lines."""
    def without_numbers(cleaned: Column) -> Column:
        t = cleaned
        for source, flags in N.LAYOUT_REGIONS["metadataRegion"]:
            t = remove_first(t, source, flags)
        return F.when(cleaned.rlike(any_pattern(N.LAYOUT_REGIONS["metadataRegion"])), t).otherwise(cleaned)

    t = let(replace_noise_lines(text, ""), without_numbers)

    def keep(line: Column) -> Column:
        return let(
            strip(line),
            lambda s: (F.length(s) >= 10) & ((F.length(s) >= 30) | (s != F.upper(s)) | s.rlike(INDICATOR)),
        )

    return F.array_join(F.filter(F.split(t, "\n", -1), keep), "\n")


def filter_region_noise(text: Column) -> Column:
    """Noise lines to a blank, then one line."""
    return normalize_whitespace(replace_noise_lines(text, " "))


def conservative_body(text: Column) -> Column:
    """From the first contract line on, clean lines longer than 10, up to the stop line (C14).

    The stop line is the first noisy line at or after the sixth contract line.
    """

    def of_marks(lines: Column, marks: Column) -> Column:
        contract_at = F.filter(F.transform(marks, lambda m, i: F.when(m["contract"], i)), lambda i: i.isNotNull())

        def cut(at: Column) -> Column:
            first = F.try_element_at(at, F.lit(1))
            sixth = F.try_element_at(at, F.lit(6))
            stop = F.array_min(
                F.transform(marks, lambda m, i: F.when(m["noisy"] & (i >= sixth), i))
            )
            return let(
                F.struct(first.alias("first"), F.coalesce(stop, F.size(lines)).alias("stop")),
                lambda b: F.array_join(
                    F.filter(
                        lines,
                        lambda line, i: (i >= b["first"])
                        & (i < b["stop"])
                        & ~F.element_at(marks, i + 1)["noisy"]
                        & (F.length(strip(line)) > 10),
                    ),
                    "\n",
                ),
            )

        return let(contract_at, cut)

    def of_lines(lines: Column) -> Column:
        marks = F.transform(
            lines, lambda line: F.struct(line.rlike(INDICATOR).alias("contract"), line.rlike(STOP).alias("noisy"))
        )
        return let(marks, lambda m: of_marks(lines, m))

    return let(F.split(text, "\n", -1), of_lines)


def validate_layout_result(filtered: Column, original: Column, squeezed: bool = False) -> Column:
    """Fall back to C14 when too much was removed, else squeeze blanks and trim.

    `squeezed` says that the text has single blanks already, as C13 leaves it.
    """
    indicators = let(F.lower(filtered), lambda low: count_contained(low, N.LAYOUT_INDICATORS))
    removed = (F.length(original) - F.length(filtered)) / F.length(original)
    too_little = (removed > N.MAX_REMOVED_SHARE) | (
        (F.length(filtered) < N.SHORT_RESULT_CHARS) & (indicators < N.MIN_LAYOUT_INDICATORS)
    )
    kept = filtered if squeezed else strip(F.regexp_replace(filtered, pattern(r"\s{3,}"), " "))
    return F.when(too_little, conservative_body(original)).otherwise(kept)


def body_region(text: Column) -> Column:
    """The body lines cleaned by C12 when substantial, else C14 of the whole text."""

    def slice_body(s: Column) -> Column:
        lines = F.slice(F.split(text, "\n", -1), s["body_start"] + 1, F.greatest(s["body_end"] - s["body_start"], F.lit(0)))
        body = filter_body_noise(F.array_join(lines, "\n"))
        return let(
            body,
            lambda b: F.when(F.length(strip(b)) > N.MIN_BODY_CHARS, b).otherwise(conservative_body(text)),
        )

    return let(document_structure(text), slice_body)


def filter_layout_noise(text: Column) -> Column:
    """C11, body slice, C12 or C14, C13, C15."""
    filtered = filter_region_noise(body_region(text))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        let(filtered, lambda f: validate_layout_result(f, text, squeezed=True))
    )


def layout_findings(text: Column) -> Column:
    """array<struct<kind,region,pattern,matches,examples>> of indicators and noise lines (C17).

    Region indicators count once per text; noise patterns count every match.
    """
    entries = []
    for region, patterns in N.LAYOUT_REGIONS.items():
        for source, flags in patterns:
            regex = pattern(source, flags)
            entries.append(
                F.when(
                    text.rlike(regex),
                    F.struct(
                        F.lit("region").alias("kind"), F.lit(region).alias("region"), F.lit(source).alias("pattern"),
                        F.lit(1).alias("matches"), F.array(F.regexp_extract(text, regex, 0)).alias("examples"),
                    ),
                )
            )
    for family, patterns in N.LINE_NOISE.items():
        for source, flags in patterns:
            regex = pattern(N.LINE_NOISE_FAST.get(source, source), flags)
            found = let(
                F.regexp_extract_all(text, F.lit(regex), F.lit(0)),
                lambda m, family=family, source=source: F.when(
                    F.size(m) > 0,
                    F.struct(
                        F.lit("noise").alias("kind"), F.lit(family).alias("region"), F.lit(source).alias("pattern"),
                        F.size(m).alias("matches"), F.slice(m, 1, 2).alias("examples"),
                    ),
                ),
            )
            entries.append(found)
    return F.array_compact(F.array(*entries))
