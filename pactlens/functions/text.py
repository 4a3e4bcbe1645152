r"""Shared building blocks for the text operators.

Every function maps Columns to Columns and stays inside the JVM.  Two conventions matter:

* `let(value, body)` names an expensive expression once.  Without it a Column used twice is
  evaluated twice (and a chain of such uses grows exponentially).
* `pattern(source, flags)` turns a pattern from `pactlens.fixed` into one that means the same
  in Spark and in other engines: wide whitespace class, ASCII letters only for "i", and a line
  end that is the newline only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce
from itertools import groupby
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as members of a character class: ASCII blanks, no-break space, Unicode blanks, BOM.
WHITESPACE_CLASS = (
    r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WHITESPACE_CHARS = " \t\n\x0b\f\r" + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
# `\w` is ASCII here; it is far cheaper in Java than the spelled-out ranges.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"
NOT_PRINTABLE = "(?![!-~])"
CHUNK = 2048
# openings of patterns that cannot start with a letter
MARKS = (r"\|", r"\.", r"\s", r"\[", r"[\x", "_", "-")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


BUNDLE = 128


def in_bundles(items: Column, size: Column | int = BUNDLE) -> Column:
    """The numbers (from 0) of the bundles of `size` items."""
    n = F.size(items)
    return F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, last=None) -> Column:
    """What a fold gives out: `step(state, item)` returns the next state and the array of entries (of type `kind`) that it gives.

    A fold's state is copied at every step, entries gathered in it included, so a plain fold over n items copies n * n / 2 entries.
    Here a bundle's entries are gathered in an inner fold and put aside together; the outer fold copies them once for every bundle.
    With bundles of the square root of n items both folds copy the least.  `last(state)` gives the entries that follow the last item.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, item: Column) -> Column:
        then, entries = step(acc["state"], item)
        return F.struct(then.alias("state"), F.concat(acc["out"], entries).alias("out"))

    size = F.greatest(F.lit(8), F.ceil(F.sqrt(F.size(items)))).cast("int")

    def outer(acc: Column, bundle: Column) -> Column:
        mine = F.slice(items, bundle * size + 1, size)
        return let(
            F.aggregate(mine, F.struct(acc["state"].alias("state"), none.alias("out")), inner),
            lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")),
        )

    def finish(acc: Column) -> Column:
        out = F.flatten(acc["out"])
        return F.concat(out, last(acc["state"])) if last else out

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(in_bundles(items, size), start, outer, finish)


def chunks_of(text: Column, size: int = CHUNK) -> Column:
    """The text in pieces of `size` characters, for many cheap substrings of a long text.

    A substring has to count characters from the start of its string; inside a chunk that is a
    short way, so a document of any length costs the same per substring.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def substring_of(chunks: Column, start: Column, length: Column, size: int = CHUNK) -> Column:
    """`length` characters from the zero-based `start` of a text given as chunks of `size` characters."""
    first = F.floor(start / size).cast("int")
    last = F.floor((start + length) / size).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * size + 1, length)


def expand_whitespace(source: str) -> str:
    r"""Replace `\s` by the wide class, inside and outside brackets."""
    out, in_class, i = [], False, 0
    while i < len(source):
        ch = source[i]
        if ch == "\\":
            if source[i + 1] == "s":
                out.append(WHITESPACE_CLASS if in_class else f"[{WHITESPACE_CLASS}]")
            else:
                out.append(source[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def _gated(source: str) -> str:
    return (NOT_PRINTABLE if source.startswith(r"\s") else "") + expand_whitespace(source)


def pattern(source: str, flags: str = "") -> str:
    """Spark (Java) form of a fixed pattern; "i" ignores case, "m" is line-wise.

    A pattern that starts with whitespace first rules out the printable ASCII characters,
    because the wide whitespace class costs several tests per character.
    """
    text = _gated(source)
    java = ("i" if "i" in flags else "") + ("md" if "m" in flags else "")
    return f"(?{java}){text}" if java else text


def any_pattern(patterns: Iterable[tuple[str, str]]) -> str:
    """One pattern that matches somewhere exactly where one of the (source, flags) patterns does.

    Case-insensitive patterns that start with a letter are grouped by that letter, and those
    that start with a mark are tried only where there is no letter, which spares most of the
    alternatives at most positions.
    """
    by_letter, marks, others = defaultdict(list), [], []
    for source, flags in patterns:
        parts = [source] if re.search(r"[(\[]", source) else source.split("|")
        if flags == "i" and all(part[0].isalpha() for part in parts):
            for part in parts:
                by_letter[part[0].lower()].append(expand_whitespace(part[1:]))
        elif not flags and source.startswith(MARKS):
            marks.append(_gated(source))
        else:
            others.append(f"(?{flags}{'d' if 'm' in flags else ''}:{_gated(source)})")
    if marks:
        others.append(f"(?![A-Za-z])(?:{'|'.join(marks)})")
    letters = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return "|".join(([f"(?i:{letters})"] if letters else []) + others)


def any_word(words: Iterable[str]) -> str:
    """One case-insensitive pattern for all the words, as substrings.

    The words are grouped by first letter behind a test of that letter, so most positions fail
    after one class test.
    """
    ordered = sorted(set(words))
    groups = [f"{c}(?:{'|'.join(w[1:] for w in ws)})" for c, ws in groupby(ordered, key=lambda w: w[0])]
    letters = "".join(sorted({w[0] for w in ordered}))
    return f"(?=[{letters}{letters.upper()}])(?i:{'|'.join(groups)})"


def replace_all(text: Column, patterns: Iterable[tuple[str, str]], replacement: str) -> Column:
    """Apply the patterns one after the other."""
    for source, flags in patterns:
        text = F.regexp_replace(text, pattern(source, flags), replacement)
    return text


def literals_of(source: str) -> list[str]:
    """Lower-case literals of which a text that a pattern matches holds at least one; none for a pattern that needs no literal.

    They hold no blank: patterns that put a blank in place of a match can't make one, so literals of the first text do for a whole chain.
    """
    run = re.fullmatch(r"\\?([|_.\-])\{(\d+),\}", source)
    if run:
        return [run[1] * int(run[2])]
    if source.startswith(r"\["):
        return ["["]
    found = []
    for part in [source] if re.search(r"[(\[]", source) else source.split("|"):
        plain = re.sub(r"\[[^\]]*\]|\\.", "\x00", part)
        words = [w.lower() for w in re.findall(r"[A-Za-z]{3,}(?![?*])", plain)]
        if not words:
            return []
        found.append(max(words, key=len))
    return found


#: ASCII letters from the most to the least frequent one; any other character counts as rarer.
FREQUENT = "etaoinsrhldcumfpgwybvkxjqz"


def rare_tail(word: str, least: int = 3) -> str:
    """The end of a word, of at least `least` characters, that starts with its rarest letter."""
    starts = range(max(1, len(word) - least + 1))
    return word[max(starts, key=lambda i: FREQUENT.find(word[i]) % (len(FREQUENT) + 1)) :]


def holds(text: Column, word: str) -> Column:
    """Whether a fixed word is in a text given as bytes (`let(text.cast("binary"), ...)`).

    On strings `contains` makes a full comparison at every byte, on bytes only where the first one agrees.  So the end of the
    word from its rarest letter on is looked for first.
    """
    tail = rare_tail(word)
    found = F.contains(text, F.lit(word.encode()))
    return found if tail == word else F.contains(text, F.lit(tail.encode())) & found


def any_held(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the fixed words is in the text, given as bytes; False without words."""
    return reduce(or_, [holds(text, w) for w in words] or [F.lit(False)])


def replace_present(text: Column, lowered: Column, patterns: Iterable[tuple[str, str]], replacement: str) -> Column:
    """`replace_all`, where a pattern is tried only if one of its literals is in `lowered`, a `let` name of the bytes of the lower-cased text."""
    for source, flags in patterns:
        words = literals_of(source)
        if words:
            present = any_held(lowered, words)
            text = let(text, lambda t, source=source, flags=flags, present=present: F.when(present, F.regexp_replace(t, pattern(source, flags), replacement)).otherwise(t))
        else:
            text = F.regexp_replace(text, pattern(source, flags), replacement)
    return text


def strip(text: Column) -> Column:
    """Trim all kinds of whitespace, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def normalize_whitespace(text: Column) -> Column:
    """Collapse every whitespace run to one blank and trim.

    A run that is a single blank already is not matched, so ordinary text is left alone.
    """
    wide = f"[{WHITESPACE_CLASS}]"
    runs = f" {NOT_PRINTABLE}{wide}+|(?![ -~]){wide}+"
    return F.trim(F.regexp_replace(text, runs, " "))  # blanks are all the whitespace that is left


def _sql(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def literal_array(values: Iterable[object]) -> Column:
    """Constant array of strings or numbers; the optimizer folds it into one literal."""
    return F.expr(f"array({', '.join(map(_sql, values))})")


def literal_table(rows: Iterable[dict[str, object]]) -> Column:
    """Constant array of structs, one per row of a fixed table."""
    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{name}', {_sql(value)}" for name, value in row.items()) + ")" for row in rows
    ) + ")")


def count_contained(lowered: Column, words: Iterable[str]) -> Column:
    """How many of the words occur as substrings; `lowered` is a column or a `let` name."""
    return F.size(F.filter(literal_array(words), lambda w: F.contains(lowered, w)))


def fewer_contained(lowered: Column, words: Iterable[str], least: int, at_once: int = 5) -> Column:
    """Whether fewer than `least` of the words occur as substrings; words are looked up until that is known."""

    def rest(low: Column, words: list[str], found: Column) -> Column:
        if not words:
            return found < least
        then = reduce(add, [F.when(holds(low, w), 1).otherwise(0) for w in words[:at_once]], found)
        return let(then, lambda n: F.when(n < least, rest(low, words[at_once:], n)).otherwise(F.lit(False)))

    return let(lowered.cast("binary"), lambda low: rest(low, list(words), F.lit(0)))


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """Whether one of the words occurs as a substring; `lowered` is a column or a `let` name."""
    return F.exists(literal_array(words), lambda w: F.contains(lowered, w))


def round_half_up(value: Column, digits: int) -> Column:
    """Round to `digits` places, halves up, on the binary value."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def level_of(score: Column, scale: Iterable[tuple[str, float]], lowest: str) -> Column:
    """Name of the first threshold that the score reaches (thresholds given highest first)."""
    chain = None
    for name, threshold in scale:
        chain = (F.when if chain is None else chain.when)(score >= threshold, F.lit(name))
    return chain.otherwise(F.lit(lowest))


def message(template: str, *values: Column) -> Column:
    """Fill the %s / %d slots of a fixed message with columns."""
    parts = template.replace("%d", "%s").split("%s")
    pieces = [F.lit(parts[0])]
    for value, tail in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(tail)]
    return F.concat(*pieces)


def drop_nulls(*items: Column) -> Column:
    """Array of the given items without the NULL ones, order kept."""
    return F.array_compact(F.array(*items))


def lookup(table: dict[str, object], key: Column, default: object) -> Column:
    """Value of a small fixed table, or the default."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), key), F.lit(default))


def first_rule(text: Column, rules: Iterable[tuple[str, Iterable[str]]], otherwise: str) -> Column:
    """Label of the first rule with one of its words in the text (substring match)."""

    def chain(lowered: Column) -> Column:
        result = None
        for label, words in rules:
            result = (F.when if result is None else result.when)(contains_any(lowered, words), F.lit(label))
        return result.otherwise(F.lit(otherwise))

    return let(F.lower(text), chain)
