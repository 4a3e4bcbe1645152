"""The trie of conversations against one that holds every beginning as a dictionary key."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from pactlens.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def direct(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    built = {c: own.get(c - c % 100, [])[: h[c]] + t[h[c] :] for c, t in own.items()} if rebuild else own
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below = {s: [t for t in nodes if t[: len(s)] == s] for s in nodes}
    inner = {s[:-1] for s in nodes if s}
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(s)))
        saved = sum((len(nodes[t]) - 1) * len(t[-1][1]) for t in below[s] if t)
        out.append((
            min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), sum(len(t) == len(s) + 1 for t in below[s]),
            sum(t not in inner for t in below[s]), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@pytest.mark.parametrize("limit", [3, 40, 10**6])
def test_rows(conversations, limit):
    want = direct([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in conversations.collect()])
    assert result(pt.prefix_trie(conversations, pt.shared_beginnings, limit)) == want


@pytest.mark.parametrize("limit", [0, 50, 10**6])
def test_odd_rows(spark, limit):
    rows = [
        (None, 0, "user", "nobody's"), (5, None, "user", "first"), (5, 0, None, None), (5, 7, "user", "é日本"), (6, 0, "user", "first"), (6, 1, None, ""),
        (7, 0, "user", "first"), (7, 2, "", None), (100, 0, "user", "shared"), (100, 1, "assistant", "answer"), (100, 2, "user", "more"),
        (100, 3, "x", "a"), (100, 4, "x", "b"), (100, 5, "x", "c"), (250, 0, "user", "no base"), (-3, 0, "user", "below zero"), (-3, 1, "user", "twice"),
        (-3, 1, "user", "twice"), (9, 0, "use", "rfirst"), (300, 0, "user", "long " * 2000),
    ] + [(c, 0, "user", "shared") for c in range(101, 180)] + [(c, 1, "user", f"own {c % 7}") for c in range(101, 180)]
    # copies that hold far more than one block of ids, and a long chain
    rows += [(c, 0, "user", "copy") for c in range(20_000, 20_300)] + [(400, k, "user", f"turn {k // 2}") for k in range(300)]
    rows += [(401, k, "user", f"turn {k // 2}") for k in range(200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(5)
    assert result(pt.prefix_trie(df, pt.shared_beginnings, limit)) == direct(rows)


def test_long_chains_burst_in_one_round(spark, monkeypatch):
    written = []
    keep = pt.materialize
    monkeypatch.setattr(pt, "materialize", lambda df, name: written.append(name) or keep(df, name))
    rows = [(c, k, "user", f"turn {k}" if k < 150 else f"own {c}") for c in (1, 2, 3) for k in range(152)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(pt.prefix_trie(df, None, 100)) == direct(rows, rebuild=False)
    assert written.count("burst") == 2


def test_turnless_and_empty(spark):
    """A conversation whose base has fewer turns than it takes may end up without turns; it is a member of the root alone."""
    schema = "conv_id long, turn long, role string, text string"
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)  # conversation 0 is absent
    rows = [(c, 0, "user", "a")]
    want = [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert direct(rows) == want
    for limit in (0, 100):
        assert result(pt.prefix_trie(spark.createDataFrame(rows, schema), pt.shared_beginnings, limit)) == want
    assert pt.prefix_trie(spark.createDataFrame([], schema), pt.shared_beginnings).count() == 0


def test_containers_stay_within_the_limit(spark, conversations):
    seqs = pt.sequences(conversations)
    distinct = pt.materialize(pt.in_root(pt.folded(pt.shared_beginnings(seqs))), "test-distinct")
    containers, heads, ended = pt.burst(distinct, 30)
    sizes = containers.selectExpr("head", "octet_length(seq) / 20 - depth AS turns").groupBy("head").agg({"turns": "sum", "*": "count"}).collect()
    assert all(r["sum(turns)"] <= 30 or r["count(1)"] == 1 for r in sizes)
    assert heads.count() > 1 and containers.count() + ended.count() == distinct.count()
