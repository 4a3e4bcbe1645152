"""What the operators share: reading a table, ASCII lower case, word and count expressions, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.session import materialize, scratch_path

__all__ = [
    "LOWER", "SPACES", "UPPER", "ascii_lower", "at_least", "fresh", "materialize", "partitions", "scratch_path", "table", "text_of", "word_count",
]

#: The six ASCII white-space characters: space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column | str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only in lower case.  `lower` does just that where every character is one byte; other texts go through `translate`."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; a cluster sets it to fit its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def at_least(spark: SparkSession, least: int) -> int:
    return max(least, partitions(spark))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
