"""URL filters: explicit rules first, then trust and distrust spread over the graph of hosts.

A host is a seed of trust by the share of its pages that a rule allows, and a seed of distrust by the share that a rule blocks, or wholly
if a word of its name is on the list, which holds for hosts that are only linked, too.  Edges are links between hosts, weighted by the pages that hold them, and the ties of a host with
the domain above it, in both directions.  Trust is a personalised PageRank from the trusted seeds along the edges: who is linked by good
hosts is good.  Distrust is one from the blocked seeds against them: who links to bad hosts is bad.  Both keep the seeds' strength as it
is, so their scale doesn't depend on the number of hosts.  A host is blocked where distrust reaches the threshold and exceeds trust.

Everything runs on tables of hosts and edges, summed before they are shuffled.  A host with very many edges is dealt over parts of
PART_EDGES edges; a host with very many pages meets its row by a broadcast of such hosts, of which there are at most HOT_SHARE times the
number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.common import ascii_lower, at_least, materialize


@dataclass(frozen=True)
class Rule:
    """Pages of a host and its subdomains whose path starts with `path`."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))
#: Words of a host's name (between dots and dashes) that make it a seed of distrust.
BLOCKED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
#: Share passed on in each step, steps, distrust from which a host is blocked, weight of the tie between a host and its domain.
DAMPING, STEPS, BLOCK_AT, DOMAIN_WEIGHT = 0.6, 14, 0.15, 1.0
#: Edges of one host that are joined in one part; hosts with over 1 / (HOT_SHARE x partitions) of all pages are hot; rules sent by broadcast.
PART_EDGES, HOT_SHARE, BROADCAST_RULES = 100_000, 4, 10_000
#: Absolute links of a page, from the scheme or the two slashes on.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def link_hosts(html: Column) -> Column:
    """The distinct hosts of a page's absolute links."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: ascii_lower(F.regexp_extract(u, "//([^/?#]*)", 1))))


def domains(host: Column) -> Column:
    """The host and the domains above it, down to two labels; a host of numbers has none above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(host.rlike(r"^[0-9.:]+$"), F.array(host)).otherwise(up)


def rules_of_hosts(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host, rules: the rules that fit each host, the longest first (of equal ones the first by text)."""
    rows = [(r.host, r.path, r.text, r.allow, -len(r.text)) for r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "on string, path string, rule string, allow boolean, rank int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(suffixes).alias("suffix")).join(table, F.col("suffix") == F.col("on"))
    return fitting.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "rule", "path", "allow"))).alias("rules"))


def by_host(pages: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """The pages, each with the columns of its host's row (one or none) in `table`; those of hot hosts by broadcast."""
    table = table.withColumnRenamed("host", "of")
    hot_rows = F.broadcast(hot.join(table, F.col("hot") == F.col("of"), "left").drop("of"))  # at most HOT_SHARE x partitions rows
    columns = [c for c in table.columns if c != "of"]
    first = pages.join(hot_rows, F.col("host") == F.col("hot"), "left")
    done = first.filter(F.col("hot").isNotNull()).drop("hot")
    names = F.broadcast(hot)
    rest = pages.join(names, F.col("host") == F.col("hot"), "left_anti").join(table, F.col("host") == F.col("of"), "left").drop("of")
    return done.select(*pages.columns, *columns).unionByName(rest.select(*pages.columns, *columns))


def edges_of(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """src, dst, weight: links (host, dst, n) between different hosts, and ties of hosts with the domains above them."""
    named = hosts.select("host").unionByName(links.select(F.col("dst").alias("host"))).filter(F.col("host") != "").distinct()
    chain = named.select(domains(F.col("host")).alias("chain")).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("chain")), lambda k: F.struct(F.try_element_at("chain", k).alias("low"), F.try_element_at("chain", k + 1).alias("up")))).alias("t")
    )
    ties = chain.filter(F.col("t.up").isNotNull()).select("t.low", "t.up").distinct()
    weight = F.lit(DOMAIN_WEIGHT).alias("weight")
    both = ties.select(F.col("low").alias("src"), F.col("up").alias("dst"), weight).unionByName(ties.select(F.col("up").alias("src"), F.col("low").alias("dst"), weight))
    real = links.filter((F.col("dst") != "") & (F.col("host") != F.col("dst")) & (F.col("host") != ""))
    real = real.select(F.col("host").alias("src"), "dst", F.col("n").cast("double").alias("weight"))
    return both.unionByName(real).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def moves_of(edges: DataFrame, part_edges: int = PART_EDGES) -> tuple[DataFrame, DataFrame]:
    """(from, part, to, trust, distrust: what a host passes on of each; from, parts): trust goes along an edge, distrust back."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).withColumnRenamed("src", "o")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into")).withColumnRenamed("dst", "i")
    shares = edges.join(out, F.col("src") == F.col("o")).join(into, F.col("dst") == F.col("i"))
    zero = F.lit(0.0)
    along = shares.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("trust"), zero.alias("distrust"))
    back = shares.select(F.col("dst").alias("from"), F.col("src").alias("to"), zero.alias("trust"), (F.col("weight") / F.col("into")).alias("distrust"))
    moves = materialize(along.unionByName(back), "moves")
    parts = moves.groupBy("from").agg(F.ceil(F.count("*") / part_edges).cast("int").alias("parts"))
    dealt = moves.join(parts.withColumnRenamed("from", "f"), F.col("from") == F.col("f"))
    part = F.pmod(F.xxhash64("to"), F.col("parts")).cast("int").alias("part")
    return materialize(dealt.select("from", part, "to", "trust", "distrust"), "dealt-moves"), parts


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS, part_edges: int = PART_EDGES) -> DataFrame:
    """host, trust, distrust of all hosts of the seeds (host, good, bad) and the edges, after a number of steps."""
    moves, parts = moves_of(edges, part_edges)
    nodes = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    start = nodes.join(seeds.withColumnRenamed("host", "s"), F.col("host") == F.col("s"), "left").join(parts, F.col("host") == F.col("from"), "left")
    good, bad = ((1.0 - damping) * F.coalesce(c, F.lit(0.0)) for c in ("good", "bad"))
    ranks = start.select("host", F.coalesce("parts", F.lit(0)).alias("parts"), good.alias("good"), bad.alias("bad"))
    ranks = materialize(ranks.withColumns({"trust": F.col("good"), "distrust": F.col("bad")}), "ranks")
    for _ in range(steps):
        sent = ranks.filter((F.col("parts") > 0) & ((F.col("trust") > 0) | (F.col("distrust") > 0))).select(
            F.col("host").alias("h"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.col("trust").alias("t"), F.col("distrust").alias("d")
        )
        got = moves.join(sent, (F.col("from") == F.col("h")) & (F.col("part") == F.col("p"))).groupBy("to").agg(
            F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d")
        )
        ranks = materialize(
            ranks.join(got, F.col("host") == F.col("to"), "left").select(
                "host", "parts", "good", "bad", (F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
                (F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            ), "ranks",
        )
    return ranks.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, blocked_words: Sequence[str] = BLOCKED_WORDS, block_at: float = BLOCK_AT) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, trust and distrust of the host.

    Of the rules that fit, the longest text (host and path) decides, of equally long ones the first by text; a rule's path must start the
    page's, so a URL without a path fits none.  A missing URL and one without `://` have host and path empty, no rule, no trust and the
    verdict allow.  Hosts that fit no rule and that nothing reaches are allowed.  Rows that repeat a page_id or URL are judged one by one and
    count one by one.  A missing html has no links.  An empty table gives an empty result; further columns don't matter.
    """
    spark: SparkSession = pages.sparkSession
    url = pages["url"]
    plain = materialize(pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), "pages")
    links = pages.select(host_of(url).alias("host"), F.explode(link_hosts(pages["html"])).alias("dst")).groupBy("host", "dst").agg(F.count("*").alias("n"))
    links = materialize(links, "host-links")
    hosts = materialize(plain.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = hosts.filter(F.col("n") > total / (HOT_SHARE * at_least(spark, 2))).select(F.col("host").alias("hot"))
    fitted = by_host(plain, rules_of_hosts(hosts, rules), hot)
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = materialize(fitted.select("page_id", "host", "path", F.try_element_at(fits, F.lit(1)).alias("by")), "ruled-pages")
    allow = F.col("by.allow")
    named = F.arrays_overlap(F.split("host", "[.-]"), F.array(*(F.lit(w) for w in blocked_words)).cast("array<string>"))
    seeds = ruled.filter(F.col("host") != "").groupBy("host").agg(
        F.avg(F.coalesce(allow, F.lit(False)).cast("double")).alias("good"), F.avg(F.coalesce(~allow, F.lit(False)).cast("double")).alias("bad")
    )
    zero = F.lit(0.0)
    seeds = seeds.unionByName(links.filter(F.col("dst") != "").select(F.col("dst").alias("host"), zero.alias("good"), zero.alias("bad")))
    seeds = seeds.groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    seeds = materialize(seeds.withColumn("bad", F.when(named, 1.0).otherwise(F.col("bad"))), "seeds")
    ranks = propagate(seeds, materialize(edges_of(hosts, links), "host-edges"))
    judged = by_host(ruled, ranks, hot)
    by_host_verdict = F.when((F.col("distrust") >= block_at) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    verdict = F.when(allow.isNull(), by_host_verdict).when(allow, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
