"""Runs of repeated words: stretches that keep a period for at least four of it, found in tiles and stitched.

A stretch keeps period q where word i equals word i + q; the places i of one stretch are its match interval.

1. Each text becomes numbers, one per distinct word.  It is cut into tiles: one scale of tiles for each group of octaves of periods, long
   enough for the group's longest period and overlapping by six times the octave.  A text that fits one tile of the first scale is solved
   where it is read, many such texts at once; the tiles of longer texts are rows of their own, dealt over all tasks.
2. In a tile, octave k (periods 2^k up to 2^(k+1)) looks at every 2^k-th place, a boundary.  A stretch of four periods holds a whole block
   behind some boundary that equals the block q further on, so one comparison of block hashes for each boundary and period finds all
   candidates, n of them an octave.  A block inside a stretch of a shorter period that divides q adds nothing and is left out.
3. From a candidate's boundary, Z-functions of the words behind it and, reversed, before it give how far the stretch reaches; where that
   is the end of the window, the window is doubled.  Words are compared, so hashes only choose where to look.
4. The intervals are fragments, shuffled by text and period and stitched where they touch.  Fragments of one stretch in neighbouring tiles
   always touch, because the overlap of tiles exceeds the shortest interval that a tile is sure to find.
5. Intervals long enough are runs, unless a run of a shorter period that divides theirs holds them.  They go back to their text, of which
   the first pass has kept a compressed copy where it saw a fragment or cut tiles; other texts don't move at all.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactlens.llm.arrow import mapped, sliced, texts
from pactlens.llm.common import at_least, materialize

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Highest octave of the first scale of tiles, octaves of each further scale, words of a tile and of an overlap in units of 2^(highest octave).
FIRST_TOP, SCALE_OCTAVES, TILE, OVERLAP = 6, 3, 24, 6
#: Bytes of a long text that are split into words together.
PIECE = 4 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
#: From a document's id and number of words to the word shown at each place; None leaves the text as it is.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: one document in ten repeats a stretch of its words from some place to its end."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def numbered(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word, new words added to the vocabulary; a long text is split piece by piece."""
    parts, start = [], 0
    number = vocabulary.setdefault
    while start < len(text):
        end = SPACE.search(text, start + PIECE) if len(text) - start > PIECE else None
        stop = end.start() if end else len(text)
        words = (text if start == 0 and stop == len(text) else text[start:stop]).split()
        parts.append(np.fromiter((number(w, len(vocabulary)) for w in words), np.int32, len(words)))
        start = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def joined_sha256(ids: np.ndarray, words: list[bytes]) -> str:
    """SHA-256 of the words joined by one blank."""
    digest = hashlib.sha256()
    for k in range(0, len(ids), 1 << 16):
        digest.update((b" " if k else b"") + b" ".join([words[i] for i in ids[k : k + (1 << 16)].tolist()]))
    return digest.hexdigest()


def z_function(s: list[int]) -> list[int]:
    """For each place how many items from there on equal those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


class Boundary:
    """Z-functions around place b of the words for periods below `top`; the window grows where a stretch reaches its end."""

    def __init__(self, words: np.ndarray, b: int, top: int):
        self.words, self.b, self.top, self.reach = words, b, top, 4 * top
        self._solve()

    def _solve(self) -> None:
        w, b = self.words, self.b
        self.low, self.high = max(0, b - self.reach), min(len(w), b + self.top + self.reach)
        self.after = z_function(w[b : self.high].tolist())
        u = w[self.low : b][::-1].tolist()
        v = w[self.low : min(len(w), b + self.top)][::-1].tolist()
        self.back = z_function([*u, None, *v])
        self.first = len(u) + 1 + len(v) - (b - self.low)  # where place b - 1 stands

    def interval(self, q: int) -> tuple[int, int]:
        """The match interval of period q around b."""
        while True:
            ahead, behind = self.after[q], self.back[self.first - q]
            if (self.b + q + ahead == self.high < len(self.words)) or (self.b - behind == self.low > 0):
                self.reach *= 2
                self._solve()
            else:
                return self.b - behind, self.b + ahead


def stretches(words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of match intervals with periods of the octaves low <= k < high, the longest inside these words.

    Octaves below `low` are solved too, as their stretches make multiples of their periods superfluous, but not given.
    """
    n, out = len(words), []
    period, until = np.zeros(n, np.int64), np.zeros(n, np.int64)
    hashes, block = words.astype(np.int64).view(np.uint64) * _ODD[0], 1
    for k in range(high):
        step = 1 << k
        want = max(4, 2 * step)
        while block < want and len(hashes) > block:
            hashes = hashes[:-block] * _ODD[1] + hashes[block:]
            hashes ^= hashes >> np.uint64(29)
            block *= 2
        rows = (len(hashes) - step) // step
        if block < want or len(hashes) <= step:
            break
        row, column = np.nonzero(hashes[step : step + rows * step].reshape(rows, step) == hashes[: rows * step : step, None])
        rest = np.flatnonzero(hashes[step + rows * step :] == hashes[rows * step])
        at, q = np.concatenate([row, np.full(len(rest), rows)]) * step, np.concatenate([column, rest]) + step
        known = (period[at] > 0) & (until[at] >= at + q + want) & (q % np.maximum(period[at], 1) == 0)
        last: dict[int, int] = {}
        boundary, found = None, []
        for b, p in zip(at[~known].tolist(), q[~known].tolist(), strict=True):
            if last.get(p, -1) > b:
                continue
            if boundary is None or boundary.b != b:
                boundary = Boundary(words, b, 2 * step)
            start, stop = boundary.interval(p)
            if stop - b >= want:
                last[p] = stop
                found.append((start, stop, p))
        for start, stop, p in found:
            if stop - start >= 2 * p:
                inside = until[start : stop + p] < stop + p
                period[start : stop + p][inside] = p
                until[start : stop + p][inside] = stop + p
        if k >= low:
            out += found
    return out


def octaves(n: int) -> int:
    """The number of octaves with periods of which a text of n words can hold four."""
    return (n // LEAST_PERIODS).bit_length()


def tiles(n: int, first_top: int = FIRST_TOP) -> Iterator[tuple[int, int, int, int]]:
    """(first word, end, lowest octave, end of octaves) of the tiles of a text of n words."""
    low, top = 0, first_top
    while low < octaves(n):
        size, step = TILE << top, (TILE - OVERLAP) << top
        if size >= n:  # one tile holds the text, so it takes all further octaves
            yield 0, n, low, octaves(n)
            return
        for start in range(0, max(1, n - (OVERLAP << top)), step):
            yield start, min(n, start + size), low, min(top + 1, octaves(n))
        low, top = top + 1, top + SCALE_OCTAVES


READ = pa.schema([
    ("kind", pa.int32()), ("doc_key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("low", pa.int64()),
    ("high", pa.int64()), ("sha", pa.string()), ("data", pa.binary()),
])
#: Kinds of rows: a document, a fragment (at, high: interval; low: period), a tile of n words (low, high: octaves).
DOCUMENT, FRAGMENT, TILE_ROW = 0, 1, 2


def read(docs: DataFrame, rewrite: Rewrite | None = None, first_top: int = FIRST_TOP, keep: bool = False) -> DataFrame:
    """Rows of all three kinds of the texts (doc_id, text).  Documents carry their text where a run is possible, with `keep` always."""
    whole = TILE << first_top

    def solve(batch: pa.RecordBatch, squeeze: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        ids, many, vocabulary = batch.column("doc_id").to_pylist(), texts(batch), {}
        words = [numbered(t, vocabulary) for t in many]
        for k, doc_id in enumerate(ids):
            places = rewrite(doc_id, len(words[k])) if rewrite else None
            if places is not None:
                words[k] = words[k][places]
        keys = [hashlib.blake2b(t, digest_size=16, key=b"" if i is None else str(i).encode()).digest() for i, t in zip(ids, many, strict=True)]
        short = [k for k, w in enumerate(words) if LEAST_WORDS <= len(w) <= whole]
        hit = {k for k, w in enumerate(words) if len(w) > whole}
        if short:
            # short texts stand behind one another, each behind a number of its own
            line = np.concatenate([np.concatenate([[-1 - k], words[k]]) for k in short])
            starts = np.cumsum([0] + [len(words[k]) + 1 for k in short]) + 1
            for a, b, p in stretches(line, 0, octaves(max(len(words[k]) for k in short))):
                j = int(np.searchsorted(starts, a, side="right")) - 1
                k = short[j]
                hit.add(k)
                rows.append((FRAGMENT, keys[k], None, None, a - int(starts[j]), p, b - int(starts[j]), None, None))
        shown = list(vocabulary)
        for k, w in enumerate(words):
            rows.append((DOCUMENT, keys[k], ids[k], len(w), None, None, None, joined_sha256(w, shown), squeeze.compress(many[k]) if keep or k in hit else None))
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)
        for k, w in enumerate(words):
            if len(w) > whole:
                own = np.unique(w, return_inverse=True)[1]  # numbers of this text alone are smaller
                own = own.astype(np.min_scalar_type(len(own)))
                for start, stop, low, high in tiles(len(w), first_top):
                    row = (TILE_ROW, keys[k], None, stop - start, start, low, high, None, squeeze.compress(own[start:stop].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, READ, strict=True)], schema=READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches):
            if batch.num_rows:
                yield from solve(batch, squeeze)

    return docs.mapInArrow(run, "kind int, doc_key binary, doc_id long, n long, at long, low long, high long, sha string, data binary")


def tile_fragments(rows: DataFrame) -> DataFrame:
    """doc_key, period, start, stop of the fragments in tiles, which are dealt over all tasks."""
    schema = pa.schema([("doc_key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            found = []
            for key, n, at, low, high, data in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "n", "at", "low", "high", "data")), strict=True):
                plain = expand.decompress(data)
                words = np.frombuffer(plain, f"u{len(plain) // n}").astype(np.int64)
                found += [(key, p, at + a, at + b) for a, b, p in stretches(words, low, high)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    n = at_least(rows.sparkSession, 2)
    return rows.select("doc_key", "n", "at", "low", "high", "data").repartition(n, "doc_key", "at", "low").mapInArrow(
        run, "doc_key binary, period long, start long, stop long"
    )


def stitch(fragments: DataFrame) -> DataFrame:
    """doc_key, start, length, period of stretches that are long enough, from fragments that touch or overlap."""
    by = Window.partitionBy("doc_key", "period").orderBy("start", "stop")
    reached = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.withColumn("new", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    marked = marked.withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = marked.groupBy("doc_key", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    least = F.greatest(F.lit(LEAST_WORDS), F.lit(LEAST_PERIODS) * F.col("period"))
    return whole.select("doc_key", "start", length.alias("length"), "period").filter(F.col("length") >= least)


def primitive(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period), sorted, without those that a run of a shorter period dividing theirs holds."""
    kept: list[tuple[int, int, int]] = []
    active: list[tuple[int, int, int]] = []
    for start, length, period in sorted(runs, key=lambda r: (r[0], -r[1], r[2])):
        active = [r for r in active if r[0] + r[1] > start]
        if not any(period % p == 0 and p < period and s + m >= start + length for s, m, p in active):
            active.append((start, length, period))
            kept.append((start, length, period))
    return sorted(kept, key=lambda r: (r[0], r[2]))


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period, of equal ones the first by start, then period; compared without rounding."""
    top = runs[0]
    for run in runs[1:]:
        if run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, whole: bool = False, first_top: int = FIRST_TOP) -> DataFrame:
    """One row per input row: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; with `whole` also runs
    (array of start, length, period) and collapsed (text).

    A missing text has no words, and neither has an empty one.  A missing doc_id stays missing and is never rewritten.  Rows that repeat
    doc_id and text have equal results, as each row has its own.  Of runs with equal length / period the first counts, then the shorter
    period.  Words are bytes between the six ASCII white-space characters.  Further columns don't matter, and an empty table gives an
    empty result.  The largest value in one row is a text, or the numbers of its words; a text's longest tiles hold 24 times the octave
    of its longest period, so they are not longer than the text.
    """
    rows = materialize(read(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), rewrite, first_top, whole), "runs-read")
    here = rows.filter(F.col("kind") == FRAGMENT).select("doc_key", F.col("low").alias("period"), F.col("at").alias("start"), F.col("high").alias("stop"))
    fragments = here.unionByName(tile_fragments(rows.filter(F.col("kind") == TILE_ROW)))
    found = stitch(fragments).groupBy("doc_key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    read_texts = rows.filter(F.col("kind") == DOCUMENT)
    possible = read_texts.filter(F.col("data").isNotNull()).select("doc_key", "doc_id", "sha", "data").join(found, "doc_key", "left")
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + (["runs", "collapsed"] if whole else [])
    types = ["long"] * 5 + ["string"] * 2 + (["array<struct<start: long, length: long, period: long>>", "string"] if whole else [])

    def make():
        expand = zstandard.ZstdDecompressor()

        def one(doc_id: int | None, sha: str, data: bytes, found: list[dict] | None) -> tuple:
            runs = primitive([(r["start"], r["length"], r["period"]) for r in found or []])
            if not runs and not whole:
                return 0, None, None, None, None, hashlib.sha256().hexdigest(), sha
            vocabulary: dict[bytes, int] = {}
            ids = numbered(expand.decompress(data), vocabulary)
            places = rewrite(doc_id, len(ids)) if rewrite else None
            ids = ids if places is None else ids[places]
            change = np.zeros(len(ids) + 1, np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            kept, shown = ids[np.cumsum(change)[:-1] == 0], list(vocabulary)
            listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            top = best(runs) if runs else (None, None, None)
            row = len(runs), *top, 1000 * top[1] // top[2] if runs else None, listed, joined_sha256(kept, shown)
            if not whole:
                return row
            return *row, [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join([shown[i] for i in kept.tolist()]).decode()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            done = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sha", "data", "found")), strict=True)]
            return {name: [row[k] for row in done] for k, name in enumerate(names)}

        return work

    with_texts = mapped(possible, make, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)), keep=["doc_id"])
    if whole:
        return with_texts
    none = F.lit(None).cast("long")
    others = read_texts.filter(F.col("data").isNull()).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in names[1:5]),
        F.lit(hashlib.sha256().hexdigest()).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"),
    )
    return with_texts.unionByName(others)
