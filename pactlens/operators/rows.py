"""Arrays to rows without computing the array more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Distribute a scan of few row groups over a number of tasks before per-row text work.

    Text work costs far more than moving the text once, but a Parquet row group is read by one
    task.  A table of many files doesn't need this; the caller decides.  Partitions follow the
    hash of a unique key, so a repeated task makes the same rows.
    """
    return df.repartition(tasks, key)


def item_rows(df: DataFrame, items: Column | str, *keep: str, position: str | None = None, item: str = "item") -> DataFrame:
    """One row per array entry with the kept columns, the entry and (zero-based) its position.

    The plain explode makes the optimizer filter empty arrays below the projection, which
    evaluates the array expression again for the filter; the outer form does not, and the
    NULL rows of empty arrays are dropped afterwards.
    """
    place = position or "_position"
    rows = df.select(*keep, F.posexplode_outer(items).alias(place, item)).filter(F.col(place).isNotNull())
    return rows if position else rows.drop(place)
