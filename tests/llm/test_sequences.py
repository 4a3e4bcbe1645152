import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactlens.llm import bpe, byte_dedup, components, simhash, suffix_arrays

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def small_leaves():
    return bpe.TreeBpe(PATH, leaf=16, reach=2)


def same(tree, library, text):
    ids, shown = tree.texts([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want and shown == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_of_any_text(small_leaves, library, text):
    same(small_leaves, library, text)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["ab", "thein", "aeiouthrsAE", "ñéáóabc", "日本語ab", "!?.'", "ab.,", "aB1.'s", "가é한ab"]), st.randoms(use_true_random=False), st.integers(1, 600))
def test_tree_concatenation(small_leaves, library, alphabet, rng, n):
    text = "".join(rng.choice(alphabet) for _ in range(n))
    same(small_leaves, library, text)
    same(small_leaves, library, text[: n // 2] + rng.choice(["<|endoftext|>", "'ll", "12", "İ", "Σ", "́", " "]) + text[n // 2 :])


def test_joins_mend_what_halves_get_wrong(library, monkeypatch):
    """Every long text goes through the tree, and without the windows around joins its ids are wrong."""
    text = " ".join(f"alphabet{k} internationalisation, reading" for k in range(200))
    want = library.encode(text, add_special_tokens=False).ids
    tree = bpe.TreeBpe(PATH, leaf=50, reach=4)
    ids, joins = tree.ids([text])[0]
    assert ids.tolist() == want and joins == len(tree.cuts(text)) - 2 > 100
    monkeypatch.setattr(bpe.TreeBpe, "joined", lambda self, text, x, y, *_: (x[0], y[1], np.concatenate([x[2], y[2]]), 0))
    assert tree.ids([text])[0][0].tolist() != want


def test_joins_on_the_tables(docs):
    rows = bpe.encode(docs, PATH).collect()
    long = {r["doc_id"] for r in docs.filter(f"char_length(text) > {bpe.LEAF + bpe.SHIFT}").collect()}
    assert long and all((r["n_joins"] > 0) == (r["doc_id"] in long) or r["n_joins"] <= 1 for r in rows) and sum(r["n_joins"] for r in rows) > 100


def test_table_of_known_runs_is_bounded(library):
    tree = bpe.TreeBpe(PATH, remembered=20)
    for k in range(30):
        same(tree, library, f"alpha{'bcdefgh'[k % 7]} beta{chr(97 + k % 26)} gamma {k} Delta.")
        assert len(tree.known) < 10


def test_encoder_starts_no_threads():
    """Spark's tasks hold the cores already; threads of the library in each of them cost half of the time."""
    code = """
import os, sys
from pactlens.llm import bpe
tree = bpe.TreeBpe(sys.argv[1], leaf=50, reach=4)
before = len(os.listdir("/proc/self/task"))
tree.ids(["A1 b-2 " * 40 + str(k) for k in range(100)] + ["short x%d" % k for k in range(100)])
assert len(os.listdir("/proc/self/task")) == before
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    subprocess.run([sys.executable, "-c", code, PATH], check=True, timeout=300, env=env)


def test_bpe_rows(odd, empty, docs, library):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = []
    for r in both.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    rows = bpe.encode(both, PATH, whole=True).collect()
    assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted(want, key=str)
    assert all(library.decode(r["ids"], skip_special_tokens=False) == r["decoded"] for r in rows)
    assert bpe.encode(empty, PATH).count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, radius):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return sorted(((d, f"{fps[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("radius", "block"), [(4, 4096), (14, 8)])
def test_simhash_groups(odd, docs, radius, block):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    got = simhash.near_duplicates(both, radius=radius, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows, radius)


def test_one_of_each_group_stays(odd, empty, docs):
    groups = simhash.near_duplicates(docs)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in groups.collect()}
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 20), st.integers(1, 16))
def test_tiles_find_all_pairs(values, radius, tile):
    fps = np.array(values + [v ^ 5 for v in values[:10]], np.uint64)
    fps = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    before, simhash.TILE = simhash.TILE, tile
    try:
        found = {(int(a), int(b)) for i, j in simhash.near(fps, fps, radius) for a, b in zip(i, j, strict=True)}
    finally:
        simhash.TILE = before
    assert found == {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_one_row_of_each_group(spark):
    """Rows of one id with different texts are told apart, equal rows are one, rows without an id come last."""
    a, b, c = "one two three four five six", "completely different words stand in this other text", "and a third text that shares nothing with them"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (5, b, 5), (None, c, 6), (None, c, 7), (None, a, 8), (7, None, 9), (8, "", 10)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, digest long").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None) == [(3, a), (5, b), (7, None)]
    assert [r["text"] for r in kept if r["doc_id"] is None] == [c] and len(kept) == 4


def test_dense_block_is_joined_tile_by_tile():
    rng = np.random.default_rng(2)
    fps = np.uint64(0x5555AAAA5555AAAA) ^ (np.uint64(1) << rng.integers(0, 64, 8192).astype(np.uint64))
    assert len(set(simhash.forest(fps, 4).tolist())) == 1


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(100, 101), (7, 7), (101, 102)], "u long, v long"))
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100, 102: 100}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40) | st.text("ab\0", max_size=60).map(str.encode), min_size=1, max_size=8))
def test_suffix_arrays_and_common_prefixes(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    if not len(data):
        return
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    order = suffix_arrays.suffix_array(data, ends)
    suffixes = [data.tobytes()[i : ends[i]] for i in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(data)))
    shared = suffix_arrays.common_prefixes(data, ends, order, (stops - sizes)[sizes > 0])
    assert shared[1:].tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def plain_removal(rows, length):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        text = (t or "").encode()
        mark = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen.setdefault(text[i : i + length], (d, t, i)) != (d, t, i):
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(text, mark, strict=True) if not m)
        spans = sum(m and (not i or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((d, len(text), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(n=250, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "bet", "gamma", "de", "epsilon", "zé", "eta"]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared)[rng.randint(0, 50) :], "as " * rng.randint(0, 80), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 4))]
        rows.append((i, None if i % 50 == 0 else rng.choice([" ", "\n", ""]).join(parts)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_repeats_are_removed(spark, monkeypatch, small):
    if small:  # several shards of one anchor, several folds and chunks
        for name, value in {"SHARD_CONTEXTS": 5, "SHARD_BYTES": 2000, "FOLD": 50, "CHUNK": 700}.items():
            monkeypatch.setattr(byte_dedup, name, value)
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = byte_dedup.remove_repeats(df, whole=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_removal(rows, 100)
    assert all(sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)


def test_repeats_of_odd_rows(odd, empty):
    """Rows of one id and one text are one document; rows without an id come last."""
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 9]
    got = byte_dedup.remove_repeats(odd.filter("doc_id is null or doc_id <> 9")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows, 100)
    assert byte_dedup.remove_repeats(empty).count() == 0


def test_anchors_of_equal_strings_are_equal():
    rng = random.Random(1)
    passage = bytes(rng.choice(b"abc ") for _ in range(400))
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 300))) + passage + bytes(rng.choice(b"abc ") for _ in range(50)) for _ in range(2)]
    found = []
    for t in texts:
        at, n, g = byte_dedup.contexts(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))
        assert at[0] == 0 and (at[1:] == at[:-1] + n[:-1]).all() and at[-1] + n[-1] == len(t) - 99
        start = t.index(passage)
        of = np.searchsorted(at, np.arange(start, start + 301), side="right") - 1
        found.append(g[of])
    assert (found[0] == found[1]).all()
