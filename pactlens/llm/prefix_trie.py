"""Prefix trie of conversations: which beginnings are shared, by whom, and what sharing them saves.

A turn becomes a unit of 20 bytes, 16 of a SHA-256 digest of role and text and 4 with the text's code points, and a conversation the
sequence of its units, so sequences sort and cut as bytes.

1. Equal sequences are folded: number, smallest conv_id, and the digest of all their ids.  Ids are joined in blocks of 4,096 numbers
   first, so the one task that reads a common sequence's ids in order reads long pieces and holds none of them.
2. All sequences start in one container under the root.  A container is what lies below a trie head, the beginning that its sequences
   share; it is oversized if its turns exceed the limit and it holds two sequences or more.  Round by round, oversized containers burst: a
   sequence moves to the container of its next turn, and the head becomes a node of the upper trie.  A container whose sequences share
   further turns goes down that chain in the same round, so each burst splits it.  Weights of containers are summed before they are
   shuffled, so a first turn that a third of all conversations share is only a sum.
3. What remains is small: each container is sorted and swept once, which gives all its nodes and the sums below them.
4. The tops of containers report to the burst heads above them, whose sums are two grouped tables: members and leaves first, and then,
   as a head's own saving needs its members, savings.

Number of rounds: the most burst heads above one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.arrow import sliced
from pactlens.llm.common import at_least, materialize

#: Bytes of a unit, turns of a container, bits of the id that one block of joined ids spans.
UNIT, LIMIT, ID_BITS = 20, 4096, 12
NO_ENDS = hashlib.sha256().hexdigest()
#: From the sequences (conv_id, seq as hexadecimal text) of all conversations to those that the trie holds.
Rebuild = Callable[[DataFrame], DataFrame]


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq (40 hexadecimal digits a turn, in the order of turns)."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    unit = F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), F.struct(turns["turn"].cast("long").alias("turn"), unit.alias("unit")).alias("t"))
    rows = rows.filter(F.col("conv_id").isNotNull())
    ordered = F.array_sort(F.collect_list("t"))  # a missing turn comes first
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["unit"]), "").alias("seq"))


def shared_beginnings(seqs: DataFrame) -> DataFrame:
    """The contract's rebuilding: the first turns of conversation c - c % 100, as many as crc32(c) % 6, then the rest of one's own."""
    digits = 2 * UNIT
    heads = seqs.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.substring("seq", 1, 5 * digits).alias("head"))
    joined = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    taken = F.substring(F.coalesce("head", F.lit("")), F.lit(1), h * digits)
    return joined.select("conv_id", F.concat(taken, F.substring(F.col("seq"), h * digits + 1, F.length("seq"))).alias("seq"))


def folded(rebuilt: DataFrame) -> DataFrame:
    """seq (bytes), n, least, ends: one row per distinct sequence, with the digest of the ids of the conversations that are it."""
    n = at_least(rebuilt.sparkSession, 2)
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    parts = rebuilt.groupBy(F.unhex("seq").alias("seq"), block).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"),
    )
    placed = parts.repartition(n, "seq").sortWithinPartitions("seq", "block").select("seq", "n", "least", "ids")
    schema = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, count, first, digest = None, 0, None, hashlib.sha256()
        for batch in sliced(batches):
            done = []
            for s, n, least, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != seq:
                    if seq is not None:
                        done.append((seq, count, first, digest.hexdigest()))
                    seq, count, first, digest = s, 0, least, hashlib.sha256()
                digest.update((("," if count else "") + ids).encode())
                count += n
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done, strict=True) if done else [[]] * 4, schema, strict=True)], schema=schema)
        if seq is not None:
            yield pa.RecordBatch.from_pydict({"seq": [seq], "n": [count], "least": [first], "ends": [digest.hexdigest()]}, schema)

    return placed.mapInArrow(run, "seq binary, n long, least long, ends string")


def head_key(depth: Column) -> Column:
    """The name of a sequence's beginning of `depth` turns."""
    return F.substring(F.sha2(F.substring(F.col("seq"), F.lit(1), (depth * UNIT).cast("int")), 256), 1, 32)


def _unit(seq: Column, k: Column) -> Column:
    """The k-th unit of a sequence, from 1."""
    return F.substring(seq, (k * UNIT - (UNIT - 1)).cast("int"), F.lit(UNIT))


def in_root(distinct: DataFrame) -> DataFrame:
    """The sequences in one container under the root.  Written before they burst, so that the first head is a value and not a constant."""
    return distinct.withColumns({"head": F.lit("").cast("string"), "path": F.array().cast("array<string>"), "depth": F.lit(0).cast("long")})


def burst(distinct: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(containers: head, depth, path, seq, n, least, ends; burst heads: head, depth, deep, path, chars; sequences that end at a burst head:
    head, path, n, least, ends).

    A path holds the names of the heads above, the root first.  A head stands for the chain of nodes from its depth down to `deep`, which
    its smallest and largest sequence, and so all, share; `chars` holds the code points of the chain's turns.
    """
    opened = distinct
    closed: list[DataFrame] = []
    heads: list[DataFrame] = []
    ended: list[DataFrame] = []
    low, high = F.col("low"), F.col("high")
    both = F.least(F.octet_length(low), F.octet_length(high)) / UNIT
    same = F.transform(F.sequence(F.lit(0).cast("long"), both.cast("long")), lambda k: (k <= F.col("depth")) | (_unit(low, k) == _unit(high, k)))
    differ = F.array_position(same, F.lit(False))
    deep = F.when(differ == 0, both.cast("long")).otherwise(differ - 2)
    while True:
        below = F.octet_length("seq") / UNIT - F.col("depth")
        sums = opened.groupBy("head").agg(
            F.sum(below).alias("turns"), F.count("*").alias("seqs"), F.first("path").alias("path"), F.first("depth").alias("depth"),
            F.min("seq").alias("low"), F.max("seq").alias("high"),
        )
        over = sums.filter((F.col("turns") > limit) & (F.col("seqs") > 1)).withColumn("deep", deep)
        chars = F.transform(
            F.sequence("depth", "deep"), lambda k: F.when(k == 0, 0).otherwise(F.conv(F.hex(F.substring(_unit(low, k), -4, 4)), 16, 10).cast("long"))
        )
        over = materialize(over.select("head", "depth", "deep", "path", chars.alias("chars")), "burst")
        if over.isEmpty():
            closed.append(opened)
            break
        heads.append(over)
        marked = opened.join(over.select(F.col("head").alias("over"), "deep"), F.col("head") == F.col("over"), "left")
        at_end = F.octet_length("seq") == UNIT * F.col("deep")
        to = F.when(F.col("over").isNull(), 0).when(at_end, 1).otherwise(2)
        moves = F.col("to") == 2
        marked = materialize(
            marked.withColumn("to", to).select(
                "seq", "n", "least", "ends", "to", F.when(moves, head_key(F.col("deep") + 1)).otherwise(F.col("head")).alias("head"),
                F.when(moves, F.concat("path", F.array("head"))).otherwise(F.col("path")).alias("path"),
                F.when(moves, F.col("deep") + 1).otherwise(F.col("depth")).alias("depth"),
            ), "burst-rows",
        )
        closed.append(marked.filter("to = 0").drop("to"))
        ended.append(marked.filter("to = 1").drop("to", "seq", "depth"))
        opened = marked.filter("to = 2").drop("to")
    containers = closed[0]
    for more in closed[1:]:
        containers = containers.unionByName(more)
    if not heads:
        return containers, None, None
    all_heads, all_ended = heads[0], ended[0]
    for more, more_ended in zip(heads[1:], ended[1:], strict=True):
        all_heads, all_ended = all_heads.unionByName(more), all_ended.unionByName(more_ended)
    return containers, materialize(all_heads, "heads"), all_ended


NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.list_(pa.string())),
])


def swept(depth: int, rows: list[tuple[bytes, int, int, str]], path: list[str]) -> pa.RecordBatch:
    """All nodes of one container, whose sorted sequences (seq, n, least, ends) share their first `depth` turns; its top comes first."""
    first = rows[0][0]
    at, parent, n, least, ends, chars = [depth], [-1], [0], [None], [NO_ENDS], [int.from_bytes(first[UNIT * depth - 4 : UNIT * depth])]
    stack = [0]  # the nodes on the way to the sequence before
    before = first[: UNIT * depth]
    for seq, count, smallest, digest in rows:
        turns, common = len(seq) // UNIT, depth
        while UNIT * (common + 1) <= len(before) and seq[UNIT * common : UNIT * (common + 1)] == before[UNIT * common : UNIT * (common + 1)]:
            common += 1
        del stack[common - depth + 1 :]
        for d in range(common + 1, turns + 1):
            parent.append(stack[-1])
            stack.append(len(at))
            at.append(d)
            n.append(0)
            least.append(None)
            ends.append(NO_ENDS)
            chars.append(int.from_bytes(seq[UNIT * d - 4 : UNIT * d]))
        k = stack[-1]
        n[k], least[k], ends[k], before = count, smallest, digest, seq
    children, leaves, saved = [0] * len(at), [0] * len(at), [0] * len(at)
    for k in range(len(at) - 1, -1, -1):  # children stand behind their parents
        leaves[k] += not children[k]
        saved[k] += (n[k] - 1) * chars[k]
        p = parent[k]
        if p >= 0:
            n[p] += n[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    above = [None if p < 0 else least[p] for p in parent]
    paths = [path or None] + [None] * (len(at) - 1)
    columns = (least, at, above, n, children, leaves, saved, ends, paths)
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, NODES, strict=True)], schema=NODES)


def sweep(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; a top below a burst head has that head's path, other nodes have none."""
    n = at_least(containers.sparkSession, 2)
    placed = containers.select("head", "depth", "path", "seq", "n", "least", "ends").repartition(n, "head").sortWithinPartitions("head", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, depth, path, rows = None, 0, [], []
        for batch in sliced(batches):
            for h, d, p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != head:
                    if rows:
                        yield swept(depth, rows, path)
                    head, depth, path, rows = h, d, p, []
                rows.append(row)
        if rows:
            yield swept(depth, rows, path)

    return placed.mapInArrow(
        run, "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path array<string>"
    )


def upper_trie(tops: DataFrame, heads: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of the burst heads, with `head`, from the tops of the containers below them and the sequences that end there."""
    zero = F.lit(0).cast("long")
    up = tops.select(F.posexplode("path").alias("k", "head"), F.size("path").alias("m"), "n_convs", "conv_id", "n_leaves", "saved_tokens")
    up = up.select("head", "n_convs", "conv_id", "n_leaves", "saved_tokens", (F.col("k") == F.col("m") - 1).cast("long").alias("child"))
    here = ended.select(F.explode(F.concat("path", F.array("head"))).alias("head"), F.col("n").alias("n_convs"), F.col("least").alias("conv_id"))
    here = here.withColumns({"n_leaves": zero, "saved_tokens": zero, "child": zero})
    members = up.unionByName(here).groupBy("head").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("below"), F.sum("child").alias("tops"),
    )
    total = F.aggregate("chars", zero, lambda a, c: a + c)
    own = materialize(heads.join(members, "head").withColumn("own", (F.col("n_convs") - 1) * total), "upper-trie")
    size = F.size("path")
    over = own.select(F.posexplode(F.concat("path", F.array("head"))).alias("k", "head"), size.alias("m"), "own")
    over = over.groupBy("head").agg(F.sum("own").alias("own_saved"), F.count_if(F.col("k") == F.col("m") - 1).alias("heads_below"))
    ends = ended.select("head", F.col("ends").alias("ends_here"))
    above = own.select(F.col("head").alias("above"), F.col("conv_id").alias("least_above"))
    whole = own.join(over, "head").join(ends, "head", "left").join(above, F.element_at(F.when(size > 0, F.col("path")), -1) == F.col("above"), "left")
    chain = whole.select("*", F.posexplode("chars").alias("k", "last"))
    first, last = F.col("k") == 0, F.col("depth") + F.col("k") == F.col("deep")
    passed = F.aggregate(F.slice("chars", F.lit(1), F.col("k")), zero, lambda a, c: a + c)
    return chain.select(
        "head", "conv_id", (F.col("depth") + F.col("k")).alias("depth"), F.when(first, F.col("least_above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("tops") + F.col("heads_below")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + F.col("own_saved") - (F.col("n_convs") - 1) * passed).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_here", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, rebuild: Rebuild | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of the conversations (conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, a missing one first; turns of one number, repeated rows included, all count, in the order of their digests.
    A missing role or text is empty.  Rows without a conv_id belong to no conversation and are left out.  An empty table has no trie, not
    even a root; further columns don't matter.  A conversation is one row of 20 bytes a turn (40 while it is put together), so one of more
    than some 50 million turns exceeds what a cell holds and fails.
    """
    seqs = materialize(sequences(turns), "sequences")
    distinct = materialize(in_root(folded(rebuild(seqs) if rebuild else seqs)), "distinct-sequences")
    containers, heads, ended = burst(distinct, limit)
    columns = [f.name for f in NODES][:-1]
    if heads is None or ended is None:
        return sweep(containers).select(*columns)
    nodes = materialize(sweep(containers), "nodes")
    tops = nodes.filter(F.col("path").isNotNull())
    upper = materialize(upper_trie(tops, heads, ended), "upper-nodes")
    least = upper.groupBy("head").agg(F.min("conv_id").alias("least_above"))
    joined = tops.join(least, F.element_at("path", -1) == F.col("head")).withColumn("parent_conv_id", F.col("least_above"))
    return nodes.filter(F.col("path").isNull()).select(*columns).unionByName(joined.select(*columns)).unionByName(upper.select(*columns))
