"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and a join on the node; each round is written to shared storage, which cuts the lineage.  A node
with very many links is one key of the join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import materialize


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """node, root: for every node of the links (u, v) the smallest node that it is joined with.  Loops and repeated links don't matter."""
    u, v = F.col("u"), F.col("v")
    links = links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links = materialize(links, "links")
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(u.alias("node"), v.alias("root"))
