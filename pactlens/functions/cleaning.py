"""Text cleaning (C1-C9, C18, C19, C21) and length caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.fixed import noise as N
from pactlens.functions.text import (
    WORD_END,
    WORD_START,
    any_held,
    any_pattern,
    any_word,
    fewer_contained,
    let,
    normalize_whitespace,
    pattern,
    literals_of,
    replace_present,
    strip,
)


KEPT = r"\w.,;:!?()\-"


def clean_text(text: Column) -> Column:
    """Keep words and basic punctuation, collapse runs.

    Every run of other characters and whitespace becomes one blank (a run that is a single
    blank is not touched).  Control characters and pipes are part of such runs.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, f" [^{KEPT}]+|[^{KEPT} ][^{KEPT}]*", " ")
    t = F.regexp_replace(t, r"\.{4,}", "...")
    t = F.regexp_replace(t, rf"{WORD_START}(\w)\1{{3,}}{WORD_END}", "$1")
    t = F.regexp_replace(t, "-{3,}", "---")
    t = F.regexp_replace(t, "_{3,}", " ")
    return strip(t)


def _lowered(text: Column, use) -> Column:
    return let(text, lambda t: let(F.lower(t).cast("binary"), lambda low: use(t, low)))


def _stamps(t: Column, low: Column) -> Column:
    phrases = [(phrase.replace(" ", r"\s+"), "i") for phrase in N.STAMP_PHRASES]
    return replace_present(t, low, N.NOISE_PATTERNS["eStamp"] + phrases, " ")


def _metadata(t: Column, low: Column) -> Column:
    return replace_present(t, low, N.NOISE_PATTERNS["metadata"] + N.NOISE_PATTERNS["government"], " ")


def _pages(t: Column, low: Column) -> Column:
    return replace_present(t, low, N.NOISE_PATTERNS["pageNumbers"], " ")


def _boilerplate(t: Column, low: Column) -> Column:
    return replace_present(t, low, N.NOISE_PATTERNS["boilerplate"] + N.NOISE_PATTERNS["watermarks"], " ")


def remove_stamp_noise(text: Column) -> Column:
    """Stamp, government and state wording to a blank."""
    return _lowered(text, _stamps)


def remove_metadata_noise(text: Column) -> Column:
    """Identity numbers and office names to a blank."""
    return _lowered(text, _metadata)


def remove_page_noise(text: Column) -> Column:
    """Page counters, number-only lines and bracketed numbers to a blank (C4)."""
    return _lowered(text, _pages)


def remove_ocr_artifacts(text: Column) -> Column:
    """Runs of marks and control characters: `{3,}` runs to a blank, the others deleted."""
    for source, flags in N.NOISE_PATTERNS["ocrArtifacts"]:
        by = " " if "{3,}" in source else ""
        text = let(text, lambda t, source=source, flags=flags, by=by: replace_present(t, t.cast("binary"), [(source, flags)], by))
    return text


def remove_boilerplate(text: Column) -> Column:
    """Signature phrases and watermark words to a blank, also inside clauses."""
    return _lowered(text, _boilerplate)


def conservative_noise(text: Column) -> Column:
    """Only the obvious noise, then C7."""
    return normalize_whitespace(_lowered(text, lambda t, low: replace_present(t, low, N.CONSERVATIVE_PATTERNS, " ")))


def filter_document_noise(text: Column) -> Column:
    """C2 to C7, or the conservative form when too little contract text is left."""

    def cleaned_of(t: Column, low: Column) -> Column:
        # up to the deletions of C5 no literal can arise that the text doesn't hold, so one lower-cased text serves three steps
        before = _pages(_metadata(_stamps(t, low), low), low)
        return normalize_whitespace(remove_boilerplate(remove_ocr_artifacts(before)))

    def keep(cleaned: Column) -> Column:
        too_little = (
            (F.length(cleaned) < F.length(text) * N.MIN_KEPT_SHARE)
            | (F.length(cleaned) < N.MIN_CLEAN_CHARS)
            | fewer_contained(F.lower(cleaned), N.CONTRACT_KEYWORDS, N.MIN_CONTRACT_KEYWORDS)
        )
        return F.when(too_little, conservative_noise(text)).otherwise(cleaned)

    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(let(_lowered(text, cleaned_of), keep))


def noise_findings(text: Column) -> Column:
    """array<struct<category,pattern,matches,examples,chars>>, patterns without a match left out."""
    return _lowered(text, _findings)


def _findings(text: Column, low: Column) -> Column:
    entries = []
    for category, patterns in N.NOISE_PATTERNS.items():
        for source, flags in patterns:
            regex, words = pattern(source, flags), literals_of(source)
            present = any_held(low, words) if words else F.lit(True)
            found = let(
                F.when(present, F.regexp_extract_all(text, F.lit(regex), F.lit(0))),
                lambda m, category=category, source=source: F.when(
                    F.size(m) > 0,
                    F.struct(
                        F.lit(category).alias("category"),
                        F.lit(source).alias("pattern"),
                        F.size(m).alias("matches"),
                        F.slice(m, 1, 3).alias("examples"),
                        F.length(F.array_join(m, "")).alias("chars"),
                    ),
                ),
            )
            entries.append(found)
    return F.array_compact(F.array(*entries))


def postprocess_ocr_text(text: Column) -> Column:
    """Collapse whitespace, literal artefacts to a blank, drop texts of 3 characters or fewer."""
    t = normalize_whitespace(F.coalesce(text, F.lit("")))
    for literal in N.OCR_LITERALS:
        t = F.replace(t, F.lit(literal), F.lit(" "))
    return let(strip(t), lambda s: F.when(F.length(s) > 3, s).otherwise(F.lit("")))


def character_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Pieces of a whitespace split; a leading or trailing blank adds an empty piece."""
    return F.size(F.split(text, pattern(r"\s+"), -1))


def detect_batch_content(text: Column) -> Column:
    """Whether the text is a merged batch."""
    return F.contains(text, F.lit(D.BATCH_CONTENT_MARK)) & F.contains(text, F.lit("---"))


def truncate_text(text: Column, limit: int, marker: str = "") -> Column:
    """Cap a text, adding the marker only when something was cut."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(marker)) if marker else cut).otherwise(text)


def contract_sections(text: Column) -> Column:
    """array<string> of sections: runs of clean lines, each from its first keyword line on.

    A line is marked where a noise pattern matches it.  Patterns are tried only where the whole text holds one of their literals.
    """
    sought = [(p, literals_of(p[0])) for group in N.NOISE_PATTERNS.values() for p in group]
    everywhere = any_pattern([p for p, words in sought if not words])
    keyword = any_word(N.CONTRACT_KEYWORDS)

    def marked_where(lines: Column, test) -> Column:
        return F.transform(lines, lambda line: F.when(test(line), F.lit("\x01")).otherwise(line))

    def marked(t: Column, low: Column) -> Column:
        lines = marked_where(F.split(t, "\n", -1), lambda line: (strip(line) == "") | line.rlike(everywhere))
        for p, words in sought:
            if words:
                regex, present = any_pattern([p]), any_held(low, words)
                lines = let(lines, lambda ls, regex=regex, present=present: F.when(present, marked_where(ls, lambda line: line.rlike(regex))).otherwise(ls))
        return lines

    runs = F.split(F.array_join(_lowered(text, marked), "\n"), "\x01", -1)

    def section(run: Column) -> Column:
        lines = F.filter(F.split(run, "\n", -1), lambda line: line != "")

        def from_first(ls: Column) -> Column:
            first = F.array_position(F.transform(ls, lambda line: line.rlike(keyword)), True)
            return F.when(first > 0, F.array_join(F.slice(ls, first.cast("int"), F.size(ls)), "\n"))

        return let(lines, from_first)

    return F.array_compact(F.transform(runs, section))
