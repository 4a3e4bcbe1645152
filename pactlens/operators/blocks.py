"""Running totals and ordered cuts that never send a whole key to one task.

Rows are put into blocks of consecutive order values.  Block sums are aggregated first (with
map-side combine), cumulated on the small block table, and joined back; the window that is
left runs inside one block only, so a key that holds a third of all rows is spread over many
tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK, ties: list[str] | None = None
) -> DataFrame:
    """Adds `out`: the sum of `value` over the earlier rows of the key (0 for the first row).

    `order` numbers the rows of a key (an integer without large gaps); `ties` makes the order total when it is not unique.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        blocked.join(sums, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_before")
    )


@dataclass(frozen=True)
class Bracket:
    """Values above `low` (None: no bound) up to `high`, with the rows at or below `low` and those inside."""

    low: object
    high: object
    before: int
    inside: int


def bracket(values: DataFrame, rank: int, block: int = BLOCK, accuracy: int = 10_000) -> Bracket | None:
    """A stretch of about `block` values of the column `v` that holds the value of a rank (from 1); None if there is no such rank.

    A quantile sketch, which tasks merge, gives two values close to the rank; counts say exactly how many rows lie below and between.
    That narrows the stretch by a factor of some thousands, whatever the distribution of values, and is repeated inside it.  Only
    counts and bounds reach the driver.  Equal values stay together, so a stretch of one value may hold more than a block.
    """
    values = values.filter(F.col("v").isNotNull())
    inside = values.count()
    if not 1 <= rank <= inside:
        return None
    low, high, before = None, None, 0
    while inside > block:
        part = values
        part = part if low is None else part.filter(F.col("v") > F.lit(low))
        part = part if high is None else part.filter(F.col("v") <= F.lit(high))
        place, slack = (rank - before) / inside, max(2.0 / accuracy, block / inside / 4)
        cuts = part.agg(F.percentile_approx("v", [max(0.0, place - slack), min(1.0, place + slack)], accuracy)).first()[0]
        counts = part.agg(*(F.count_if(F.col("v") <= F.lit(c)) for c in cuts)).first()
        was = (low, high)
        if before + counts[1] >= rank:
            high, inside = cuts[1], counts[1]
        if before + counts[0] < rank:
            low, before, inside = cuts[0], before + counts[0], inside - counts[0]
        if (low, high) == was:
            break
    return Bracket(low, high, before, inside)


def within(df: DataFrame, order: str, found: Bracket) -> DataFrame:
    df = df if found.low is None else df.filter(F.col(order) > F.lit(found.low))
    return df if found.high is None else df.filter(F.col(order) <= F.lit(found.high))


def order_value_at(df: DataFrame, order: str, fraction: float, block: int = BLOCK) -> object:
    """The `order` value of row number floor(fraction * n), None if that is 0.

    The table is not shuffled: only the rows of one narrow stretch of values are ranked.  `order` must be unique; its values may lie
    as they like.
    """
    n = df.count()
    rank = math.floor(n * fraction)
    found = bracket(df.select(F.col(order).alias("v")), rank, block)
    if found is None:
        return None
    place = F.row_number().over(Window.orderBy(order))
    ranked = within(df.select(order), order, found).withColumn("_place", place)
    return ranked.filter(F.col("_place") == rank - found.before).first()[0]


def ordered_split(df: DataFrame, order: str, fraction: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Adds `part`: `train` for the first `fraction` of the rows in order, else `eval`."""
    cut = order_value_at(df, order, fraction, block)
    part = F.lit("eval") if cut is None else F.when(F.col(order) <= F.lit(cut), "train").otherwise("eval")
    return df.withColumn("part", part)
