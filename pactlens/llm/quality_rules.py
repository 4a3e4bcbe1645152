"""Quality rules: a threshold table compiled into one projection, without user functions.

Every rule compares an integer statistic with an integer share of another one, so that it is exact.  A document is kept unless a rule
of the table fails.  `base` rules fail documents of under 10 words and those with over a fifth of their words in repeated 5-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.text_stats import with_stats


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * `value` < low * `per`, or > high * `per`; `per` None stands for 100, so that limits are counts."""

    name: str
    value: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    least_words: int = 0
    base: bool = False

    def fails(self, stat) -> Column:
        value, per = stat(self.value) * 100, stat(self.per) if self.per else F.lit(100)
        bounds = [value < per * self.low] if self.low is not None else []
        bounds += [value > per * self.high] if self.high is not None else []
        return reduce(or_, bounds) & (stat("n_words") >= self.least_words)

    def sql(self) -> str:
        """The same test in SQL, over columns of those names."""
        per = self.per or "100"
        bounds = [f"100 * {self.value} < {self.low} * {per}"] if self.low is not None else []
        bounds += [f"100 * {self.value} > {self.high} * {per}"] if self.high is not None else []
        return f"(({' OR '.join(bounds)}) AND n_words >= {self.least_words})"


RULES = (
    Rule("too_few_words", "n_words", low=10, base=True),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=20, base=True),
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop", "n_words", low=1, least_words=100),
)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    A missing or empty text has no words, so it fails the base rules.  Rows are judged one by one: ties and repeated rows have the same
    verdict, a missing doc_id stays missing, further columns don't matter, and an empty table gives an empty result.
    """
    slim = docs.select(docs["doc_id"], docs["text"].alias("text"))
    rows = with_stats(slim, "text", "s_")

    def stat(name: str) -> Column:
        return F.col(f"s_{name}")

    failed = F.filter(F.array(*(F.when(r.fails(stat), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    base = reduce(or_, (r.fails(stat) for r in rules if r.base), F.lit(False))
    return rows.select(
        "doc_id", *(stat(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base.alias("base_failed"), (F.size(failed) == 0).alias("kept"), F.array_join(failed, ",").alias("failed_rules"),
    )
