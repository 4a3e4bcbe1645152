"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Equal fingerprints are folded first.  Two fingerprints within r bits agree wholly in one of r + 1 bands of their 64 bits, so comparing
inside the buckets of each band finds every link.  A bucket is compared in tiles, sorted by bit count; a pair of tiles whose bit counts
differ by more than r is skipped.  A bucket too large for one task is cut into blocks, and each pair of blocks is a task of its own.  A
task reports a spanning forest of the links it finds, never all pairs, and the forests meet in the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.arrow import mapped, texts
from pactlens.llm.common import at_least, fresh, materialize
from pactlens.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a block (the most that one task compares with one another or with another block), and of a tile.
BLOCK, TILE = 4096, 512


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes.  No words: 0; fewer than a shingle: one shingle of all."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and fp, the fingerprint of `text` as a signed 64-bit integer."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            return {"fp": np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)}

        return work

    return mapped(docs, make, "fp long", keep=list(keep))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) within the radius, tile by tile; both sorted by bit count."""
    ca, cb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            x, y = a[i : i + TILE], b[j : j + TILE]
            if ca[i] - cb[j + len(y) - 1] > radius or cb[j] - ca[i + len(x) - 1] > radius:
                continue
            rows, columns = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            yield rows + i, columns + j


def hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i[k] and j[k]; every entry of `parent` is the root of its tree, its smallest index, before and after."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the fingerprints one index that stands for all it is linked with, directly or through others.  Tiles are joined one
    after another, so no more than one tile's pairs are held."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    s = fps[order]
    parent = np.arange(len(s))
    for i, j in near(s, s, radius):
        if len(i):
            hook(parent, i, j)
    out = np.empty(len(s), np.int64)
    out[order] = order[parent]
    return out


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: forests of the links between distinct fingerprints `fp` that differ by at most `radius` bits."""
    n = at_least(distinct.sparkSession, 2)
    edges = np.linspace(0, 64, radius + 2).astype(int)
    values = [F.shiftrightunsigned("fp", int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    bands = F.array(*(F.struct(F.lit(k).alias("band"), v.alias("value")) for k, v in enumerate(values)))
    rows = distinct.select("fp", F.inline(bands))
    large = rows.groupBy("band", "value").count().filter(F.col("count") > 1)
    blocks = F.ceil(F.col("count") / block).cast("int")
    dealt = rows.join(large.select("band", "value", blocks.alias("blocks")), ["band", "value"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("fp", "band", "value", "own", other).select(
        "fp", "band", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )
    keys = ["band", "value", "a", "b"]
    placed = dealt.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        rest = None
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*keys, "fp")])
            rest = part if rest is None else np.concatenate([rest, part], axis=1)
            cut = np.flatnonzero((rest[:4, 1:] != rest[:4, :-1]).any(axis=0)) + 1
            if len(cut):
                yield from found(rest[:, : cut[-1]], cut[:-1], schema)
                rest = rest[:, cut[-1] :]
        if rest is not None and rest.shape[1]:
            yield from found(rest, np.flatnonzero((rest[:4, 1:] != rest[:4, :-1]).any(axis=0)) + 1, schema)

    def found(rows: np.ndarray, cut: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), rows.shape[1]], strict=True):
            if b - a > 1:
                fps = rows[4, a:b]
                root = forest(fps.view(np.uint64), radius)
                joined = np.flatnonzero(root != np.arange(len(fps)))
                us.append(fps[joined])
                vs.append(fps[root[joined]])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], schema=schema)

    return placed.mapInArrow(run, "u long, v long")


def rooted(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The rows of `distinct`, one per fingerprint `fp`, with `root`, a fingerprint that stands for all that are linked."""
    roots = components(links(distinct.select("fp"), radius, block))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, its own included).

    A missing or empty text, or one of white space, has fingerprint zero and is linked like any other.  Rows that repeat a doc_id are
    rows of their own.  A missing doc_id never is a component's id unless all ids of the component are missing.  An empty table gives an
    empty result; further columns don't matter.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = materialize(fingerprints(slim, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    placed = rooted(distinct, radius, block)
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One input row of each component, with all its columns: that of the smallest doc_id, of one doc_id that of the smallest digest of
    its text; rows without a doc_id come last.  Of rows with equal doc_id and text one stays, whatever their other columns.
    """
    digest = F.coalesce(F.sha2(docs["text"].cast("binary"), 256), F.lit(""))
    row_id = docs["doc_id"].cast("long")
    slim = docs.select(row_id.alias("doc_id"), digest.alias("digest"), docs["text"].alias("text"))
    rows = materialize(fingerprints(slim, shingle, ("doc_id", "digest")), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "digest")
    distinct = materialize(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    placed = materialize(rooted(distinct, radius), "rooted")
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    # what goes: rows that aren't the first of their component; what is left of it may stand there more than once
    first = placed.join(firsts.withColumnRenamed("first", "kept"), "root").select("fp", "kept")
    marked = rows.join(first, "fp").select("doc_id", "digest", (key == F.col("kept")).alias("stays"))
    marked = materialize(marked.groupBy("doc_id", "digest").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).filter("NOT stays OR n > 1"), "near-copies")
    gone, twice = (
        marked.filter(c).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")) for c in ("NOT stays", "stays AND n > 1")
    )

    def same(df: DataFrame):
        return row_id.eqNullSafe(df["gone_id"]) & (digest == df["gone_digest"])

    kept = docs.join(gone, same(gone), "left_anti")
    repeated = kept.join(twice, same(twice), "left_semi")
    if twice.isEmpty():
        return kept
    name = fresh(docs, "row_key")
    once = repeated.withColumn(name, F.struct(row_id.alias("i"), digest.alias("d"))).dropDuplicates([name]).drop(name)
    return kept.join(twice, same(twice), "left_anti").unionByName(once)
