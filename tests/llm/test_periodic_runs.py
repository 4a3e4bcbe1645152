"""Runs of repeated words against direct comparison of every word with the one a period further on."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.llm import periodic_runs as pr


def direct_runs(words):
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w = np.array([numbers[x] for x in words], np.int64)
    found = {}
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        starts, stops = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(~same[1:] & same[:-1])
        long = stops - starts + q >= max(6, 4 * q)
        for start, length in zip(starts[long].tolist(), (stops - starts + q)[long].tolist(), strict=True):
            found.setdefault((start, length), q)  # shorter periods come first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def direct(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    n = len(words)
    if rewrite and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = direct_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * top[1] // top[2] if runs else None
    return doc_id, len(runs), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def in_tiles(words, top):
    parts = pr.tiles(len(words), top) if len(words) > pr.TILE << top else [(0, len(words), 0, pr.octaves(len(words)))]
    fragments = sorted((p, a + x, a + y) for a, b, low, high in parts for x, y, p in pr.stretches(words[a:b], low, high))
    whole = []
    for p, x, y in fragments:
        if whole and whole[-1][0] == p and x <= whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], y)
        else:
            whole.append([p, x, y])
    return pr.primitive([(x, y - x + p, p) for p, x, y in whole if y - x + p >= max(6, 4 * p)])


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 300), st.sampled_from([1, 2, 3, 6, 100]))
def test_tiles_give_the_runs_of_the_whole(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(5)):
        a, p = rng.randrange(n), 1 + rng.randrange(max(1, n // 4))
        for i in range(a + p, rng.randrange(a, n)):
            words[i] = words[a + (i - a) % p]
    want = direct_runs(words)
    for top in (0, 1, 3, 6):
        assert in_tiles(np.array(words, np.int32), top) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_z_function(s):
    want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
    assert pr.z_function(s)[1:] == want[1:]


def test_window_doubles_over_a_long_run():
    words = np.concatenate([np.arange(100, 150), np.tile(np.arange(7), 4000), np.arange(200, 230)]).astype(np.int32)
    assert pr.Boundary(words, 14_000, 8).interval(7) == (50, 50 + 28_000 - 7)


def test_a_hot_word_stays_linear():
    """One word throughout: multiples of its period add no candidates, so the whole takes one look per octave."""
    calls = []

    class Counted(pr.Boundary):
        def __init__(self, *args):
            calls.append(args[1])
            super().__init__(*args)

    whole, pr.Boundary = pr.Boundary, Counted
    try:
        assert pr.stretches(np.zeros(30_000, np.int32), 0, 14) == [(0, 29_999, 1)]
    finally:
        pr.Boundary = whole
    assert len(calls) == 1


def result(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("first_top", [0, 2, 6])
def test_rows(odd, empty, docs, first_top):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = sorted((direct(r["doc_id"], r["text"]) for r in both.collect()), key=str)
    assert result(pr.periodic_runs(both, pr.planted_period, first_top=first_top)) == want
    assert len(result(pr.periodic_runs(odd, pr.planted_period))) == odd.count()
    assert pr.periodic_runs(empty, pr.planted_period).count() == 0


def test_long_texts_ties_and_repeats(spark):
    rng = random.Random(5)
    long = [str(rng.randrange(10**6)) for _ in range(3000)]
    rows = [
        (1, " ".join(long + long[:700] * 5 + long)),  # a period beyond the first scale of tiles
        (1, " ".join(long + long[:700] * 5 + long)),
        (2, "a b c " * 5000),
        (3, "x " * 7 + "y " * 7),  # a tie: the first run counts
        (4, "A b c " * 12),  # these aren't ASCII white space
        (None, "k l " * 9),
        (None, "k l " * 9),
        (5, None),
        (6, " \t\x0b\n"),
        (7, "w" * 200_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((direct(i, t, rewrite=False) for i, t in rows), key=str)
    assert result(pr.periodic_runs(df)) == want
    whole = pr.periodic_runs(df, whole=True)
    assert result(whole) == want
    three = whole.filter("doc_id = 3").first()
    assert three["collapsed"] == "x y" and [tuple(r) for r in three["runs"]] == [(0, 7, 1), (7, 7, 1)]
    assert whole.filter("doc_id = 6").first()["collapsed"] == ""


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(pr, "PIECE", 10)
    vocabulary = {}
    text = b"aa bb  cc\nlonger-than-a-piece aa bb " * 20
    ids = pr.numbered(text, vocabulary)
    assert [list(vocabulary)[i] for i in ids] == text.split()
    assert pr.joined_sha256(ids, list(vocabulary)) == hashlib.sha256(b" ".join(text.split())).hexdigest()


def test_fragments_meet_by_text_and_period(spark):
    """Stitching alone: touching and overlapping fragments become one stretch, other texts and periods stay apart."""
    rows = [(b"a", 2, 0, 5), (b"a", 2, 5, 9), (b"a", 2, 8, 20), (b"a", 2, 22, 40), (b"a", 3, 0, 40), (b"b", 2, 0, 3)]
    df = spark.createDataFrame(rows, "doc_key binary, period long, start long, stop long").repartition(4)
    got = sorted((bytes(r["doc_key"]), r["start"], r["length"], r["period"]) for r in pr.stitch(df).collect())
    assert got == [(b"a", 0, 22, 2), (b"a", 0, 43, 3), (b"a", 22, 20, 2)]
    assert df.filter(F.lit(False)).count() == 0 and pr.stitch(df.filter(F.lit(False))).count() == 0
