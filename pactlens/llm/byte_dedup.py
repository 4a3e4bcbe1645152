"""Removal of repeated byte strings with per-shard suffix arrays.

Each byte that lies in a string of LENGTH bytes which also starts earlier (smaller doc_id, or same document and earlier start) goes.
Strings are judged on the input; matches never cross documents.

Suffix arrays of shards find the repeats, so equal strings have to meet in one shard without sending every string there:

1. Every string has an anchor, the k-gram of least hash in it (the first such), so equal strings have equal anchors at equal places.
   Consecutive strings of one anchor make one context, about 140 bytes for each 35 bytes of text, and go as two hashes and a place.
2. Contexts are folded where they are read, then range-partitioned by (anchor, context) and sorted.  All but the first of equal contexts
   are gone as a whole.  An anchor with one context only can't repeat anywhere else.  What is left are contexts that share an anchor and
   differ, as at the edges of a passage.
3. These are fetched as bytes and dealt into shards by anchor.  A shard's suffix array (Larsson-Sadakane refinement) and common prefixes
   (Kasai) give the runs of equal strings; all but the earliest of a run go.
4. An anchor with more contexts than a shard takes is dealt over several shards.  Each sends the first of every distinct string on, and
   the sorted strings are merged by binary search over their bytes, so that only the earliest of all shards stays.
5. Gone starts are gathered by document, and the texts are cut.

Whole contexts are told apart by 128 bits of a seeded hash, texts of one id by 128 bits of a cryptographic one, strings by their bytes.  Rows move as numbers;
texts move twice, compressed.  A shard is bounded by bytes, inside an anchor too, so a task needs the same memory at every size.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.arrow import mapped, sliced, texts
from pactlens.llm.common import at_least, materialize
from pactlens.llm.suffix_arrays import common_prefixes, suffix_array

LENGTH, GRAM = 100, 24
#: Bytes hashed together (they fit the processor's cache), contexts folded together, bytes of a suffix array, contexts of one anchor in a shard.
CHUNK, FOLD, SHARD_BYTES, SHARD_CONTEXTS = 192 << 10, 400_000, 1 << 20, 5_000
NO_ID = (1 << 63) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes (a multiple of 8) at each place."""
    m = len(data) - gram + 1
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    x = eight[:m] * _ODD[0]
    x ^= x >> np.uint64(29)
    for k in range(8, gram, 8):
        x += eight[k : k + m] * _ODD[1 + k // 8 % 2]
        x ^= x >> np.uint64(31)
        x *= _ODD[0]
    x ^= x >> np.uint64(30)
    return x * _ODD[1]


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of the runs of strings that share an anchor; texts lie at starts..ends."""
    none = np.zeros(0, np.int64)
    if not (ends - starts >= length).any():
        return none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    bits = np.uint64(len(data).bit_length())
    key = ((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the first place
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if width > size:
        key = np.minimum(key[: size - width], key[width - size :])
    anchor = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[: len(anchor)]) > 0)
    anchor = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return start[first], np.diff(np.append(first, len(anchor))), hashes[anchor[first]]


ROWS = pa.schema([
    ("g", pa.int64()), ("h", pa.int64()), ("i", pa.int64()), ("doc", pa.int64()), ("dk", pa.int64()), ("dl", pa.int64()), ("at", pa.int64()), ("n", pa.int32()),
    ("gone", pa.bool_()),
])
PLACES = pa.schema([("doc", pa.int64()), ("dk", pa.int64()), ("dl", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("g", pa.int64()), ("gone", pa.bool_())])
#: The columns that name a text: its id and the two halves of its digest.
DOC = ("doc", "dk", "dl")


def digests(many: Iterable[bytes]) -> np.ndarray:
    """Two 64-bit halves of a BLAKE2b digest of each byte string."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(t, digest_size=16).digest() for t in many]), np.int64).reshape(-1, 2)


def _folded(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Contexts of many texts: of equal ones the first stays a candidate, the others are gone; repeats of one place are left out."""
    g, h, i, doc, dk, dl, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((at, dl, dk, doc, i, h, g.view(np.int64)))
    g, h, i, doc, dk, dl, at, n = (x[by] for x in (g, h, i, doc, dk, dl, at, n))
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (i[1:] != i[:-1])])
    top = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    same_place = ~new & (doc == doc[top]) & (dk == dk[top]) & (dl == dl[top]) & (at == at[top])
    # what is gone needs no neighbours any more; dealt by its place, a common context doesn't fill one partition
    g = np.where(new, g, (doc.view(np.uint64) * _ODD[0] + at.view(np.uint64)) * _ODD[1])
    arrays = [x[~same_place] for x in (g.view(np.int64), h, i, doc, dk, dl, at, n, ~new)]
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(arrays, ROWS, strict=True)], schema=ROWS)


def context_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per context of every text (doc, text), folded within what one task reads together.

    Contexts are named by 128 bits under a seed drawn for this plan, so that no text can be made to agree with another one.
    """
    seed, name = secrets.randbits(64), xxhash.xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in sliced(batches, CHUNK):
            if not batch.num_rows:
                continue
            ids, many = batch.column("doc").to_numpy(zero_copy_only=False), texts(batch)
            data = b"".join(many)
            if len(data) < length:
                continue
            sizes = np.array([len(t) for t in many], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            at, n, g = contexts(np.frombuffer(data, np.uint8), starts, ends, length)
            if not len(at):
                continue
            told = [name(data[a:b], seed) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
            told = np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)
            of, docs_told = np.searchsorted(ends, at, side="right"), digests(many)
            parts.append((g, told[:, 0], told[:, 1], ids[of], docs_told[of, 0], docs_told[of, 1], at - starts[of], n.astype(np.int32)))
            rows += len(at)
            if rows >= FOLD:
                yield _folded(parts)
                parts, rows = [], 0
        if rows:
            yield _folded(parts)

    return docs.mapInArrow(run, "g long, h long, i long, doc long, dk long, dl long, at long, n int, gone boolean")


def split_contexts(rows: DataFrame) -> DataFrame:
    """doc, dk, dl, at, n, g, gone: repeated contexts (gone) and contexts that share their anchor with another one (to be compared)."""
    n = at_least(rows.sparkSession, 2)
    # rows already gone only pass through
    placed = rows.repartitionByRange(n, "g", "h", "i").sortWithinPartitions("g", "h", "i", "doc", "dk", "dl", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last distinct context waits for the next one; at the ends of a partition a neighbour may be elsewhere, so those are compared
        waiting, joined, first = None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            everything = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ROWS.names}
            past = everything["gone"]
            if past.any():
                yield pa.RecordBatch.from_arrays([pa.array(everything[f.name][past], type=f.type) for f in PLACES], schema=PLACES)
                if past.all():
                    continue
            row = {c: x[~past] for c, x in everything.items()}
            told, place = (np.stack([row[c] for c in names]) for names in (("g", "h", "i"), (*DOC, "at")))
            differs = (told[:, 1:] != told[:, :-1]).any(axis=0)
            new = np.concatenate([[first is None or tuple(told[:, 0].tolist()) != first[:3]], differs])
            top = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            before = np.array(first[3:] if first is not None else (0,) * 4, np.int64)[:, None]
            same_place = ~new & (place == np.where(top < 0, before, place[:, np.maximum(top, 0)])).all(axis=0)
            out = [np.flatnonzero(~new & ~same_place)]
            fresh = np.flatnonzero(new)
            if len(fresh):
                last = fresh[-1]
                first = (*told[:, last].tolist(), *place[:, last].tolist())
                anchors = row["g"][fresh]
                if waiting is not None:
                    next_same = bool(waiting["g"][0] == anchors[0])
                    if joined or next_same:
                        yield pa.RecordBatch.from_pydict(waiting, PLACES)
                    joined = next_same
                with_before = np.concatenate([[joined], anchors[1:] == anchors[:-1]])
                with_next = np.append(anchors[1:] == anchors[:-1], False)
                out.append(fresh[:-1][(with_before | with_next)[:-1]])
                waiting = {c: [row[c][last]] for c in PLACES.names}
                joined = bool(with_before[-1])
            at_rows = np.concatenate(out)
            columns = {c: row[c][at_rows] for c in PLACES.names} | {"gone": np.arange(len(at_rows)) < len(out[0])}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in PLACES], schema=PLACES)
        if waiting is not None:
            yield pa.RecordBatch.from_pydict(waiting, PLACES)

    return placed.mapInArrow(run, "doc long, dk long, dl long, at long, n int, g long, gone boolean")


def packed(docs: DataFrame) -> DataFrame:
    """doc, dk, dl, z: the compressed text of each row."""

    def make():
        squeeze = zstandard.ZstdCompressor(level=3)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            many = texts(batch)
            told = digests(many)
            return {"dk": told[:, 0], "dl": told[:, 1], "z": [squeeze.compress(t) for t in many]}

        return work

    return mapped(docs, make, "dk long, dl long, z binary", keep=[c for c in docs.columns if c != "text"])


FOUND = pa.schema([
    ("doc", pa.int64()), ("dk", pa.int64()), ("dl", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("string", pa.binary()), ("gone", pa.bool_()),
])


def repeats_of_shard(many: list[bytes], rank: np.ndarray, spread: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of contexts with their order of place: (context, offset) of strings that also start earlier in the shard, and of the first ones
    of contexts whose anchor is spread over several shards."""
    sizes = np.array([len(t) for t in many], np.int64)
    stops = np.cumsum(sizes)
    data, ends = np.frombuffer(b"".join(many), np.uint8), np.repeat(stops, sizes)
    order = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order, stops - sizes)
    of = np.searchsorted(stops, order, side="right")
    offset = order - (stops - sizes)[of]
    place = (rank[of] << 32) | offset
    run = np.flatnonzero(shared < length)  # a new run starts where less is shared with the one before
    least = np.repeat(np.minimum.reduceat(place, run), np.diff(np.append(run, len(order))))
    full = ends[order] - order >= length
    gone, kept = np.flatnonzero(full & (place > least)), np.flatnonzero(full & (place == least) & spread[of])
    return of[gone], offset[gone], of[kept], offset[kept]


def shard_repeats(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Suffix arrays over the contexts (g, part, doc, dk, dl, at, ctx, spread) of each shard."""
    n = at_least(parts.sparkSession, 2)
    placed = parts.repartition(n, "g", "part").sortWithinPartitions("g", "part")

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*DOC, "at")])
        by = np.lexsort(place[::-1])
        new = np.concatenate([[False], (np.diff(place[:, by], axis=1) != 0).any(axis=0)])
        rank = np.empty(batch.num_rows, np.int64)
        rank[by] = np.cumsum(new)
        many = texts(batch, "ctx")
        c, off, c2, off2 = repeats_of_shard(many, rank, batch.column("spread").to_numpy(zero_copy_only=False), length)
        by = np.lexsort((off, c))
        c, off = c[by], off[by]
        # neighbouring starts of a context become one row
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (off[1:] != off[:-1] + 1)])[: len(c)]
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(c)))
        c, off = c[head], off[head]
        strings = [many[k][o : o + length] for k, o in zip(c2.tolist(), off2.tolist(), strict=True)]
        both, at = np.concatenate([c, c2]), np.concatenate([off, off2])
        arrays = [
            *(place[k, both] for k in range(3)), place[3, both] + at, np.concatenate([count, np.ones(len(c2), np.int64)]), [None] * len(c) + strings,
            np.arange(len(both)) < len(c),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(arrays, FOUND, strict=True)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[pa.RecordBatch] = []
        size = 0
        for anchor in groups_of(batches, ("g", "part")):
            more = anchor.column("ctx").nbytes
            if shard and size + more > SHARD_BYTES:  # a shard ends between anchors only; one anchor's part fits a shard
                yield found(pa.concat_batches(shard))
                shard, size = [], 0
            shard.append(anchor)
            size += more
        if shard:
            yield found(pa.concat_batches(shard))

    return placed.mapInArrow(run, "doc long, dk long, dl long, at long, n int, string binary, gone boolean")


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as one batch for each value of the keys (integers)."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = tuple(values[:, a].tolist())
            if rest and value != last:
                yield pa.concat_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = value
    if rest:
        yield pa.concat_batches(rest)


def merge_shards(firsts: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, dk, dl, at, n of strings that start earlier in another shard.

    Each shard has sent the first place of every distinct string of a spread anchor.  They are dealt by a hash of the string and sorted by
    its bytes; each string is looked up among the distinct ones by binary search, which compares bytes.
    """
    n = at_least(firsts.sparkSession, 2)
    order = ("string", *DOC, "at")
    placed = firsts.select(*order).repartition(n, "string").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([f for f in PLACES if f.name in (*DOC, "at", "n")])
        last = None  # the last string of the slice before, with its first place
        for batch in sliced(batches, rows=1 << 16):
            if not batch.num_rows:
                continue
            # a mark behind each string keeps zero bytes at its end
            strings = np.array([x + b"\x01" for x in batch.column("string").to_pylist()], f"S{length + 1}")
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*DOC, "at")])
            new = np.concatenate([[True], strings[1:] != strings[:-1]])
            distinct, heads = strings[new], np.flatnonzero(new)
            first = heads[np.searchsorted(distinct, strings)]
            earliest = place[:, first]
            if last is not None and last[0] == strings[0]:
                earliest[:, first == 0] = last[1][:, None]
            gone = (place != earliest).any(axis=0)
            last = (strings[-1], earliest[:, -1].copy())
            yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in place] + [pa.array(np.ones(gone.sum(), np.int32))], schema=schema)

    return placed.mapInArrow(run, "doc long, dk long, dl long, at long, n int")


def gone_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, dk, at, n: runs of starts whose strings of `length` bytes also start earlier.  docs: doc, text."""
    places = materialize(split_contexts(context_rows(docs, length)), "contexts")
    left = places.filter(~F.col("gone"))
    hot = left.groupBy(F.col("g").alias("hot")).agg(F.ceil(F.count("*") / SHARD_CONTEXTS).cast("int").alias("parts")).filter(F.col("parts") > 1)
    wanted = left.groupBy("doc", "dk", "dl").agg(F.collect_list(F.struct("at", "n", "g")).alias("spans"))
    fetched = packed(docs).join(wanted, ["doc", "dk", "dl"])

    def make():
        expand = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            out = []
            for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = expand.decompress(z)
                out.append([{"at": s["at"], "g": s["g"], "ctx": text[s["at"] : s["at"] + s["n"] + length - 1]} for s in spans])
            return {"c": out}

        return work

    cut = mapped(fetched, make, "c array<struct<at: long, g: long, ctx: binary>>", keep=["doc", "dk", "dl"])
    rows = cut.select("doc", "dk", "dl", F.inline("c"))
    dealt = rows.join(hot, F.col("g") == F.col("hot"), "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc", "dk", "dl", "at"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    dealt = dealt.select("g", part.alias("part"), "doc", "dk", "dl", "at", "ctx", F.col("parts").isNotNull().alias("spread"))
    found = materialize(shard_repeats(dealt, length), "repeats")
    merged = merge_shards(found.filter(~F.col("gone")), length)
    return places.filter("gone").select("doc", "dk", "dl", "at", "n").unionByName(found.filter("gone").select("doc", "dk", "dl", "at", "n")).unionByName(merged)


def without(text: bytes, starts: list[tuple[int, int]], length: int = LENGTH) -> tuple[list[tuple[int, int]], bytes]:
    """(removed byte ranges, what is left) for runs of gone starts (first, number)."""
    spans: list[list[int]] = []
    for at, n in sorted(starts):
        if spans and at <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], at + n + length - 1)
        else:
            spans.append([at, at + n + length - 1])
    kept, place = [], 0
    for a, b in spans:
        kept.append(text[place:a])
        place = b
    return [(a, b) for a, b in spans], b"".join([*kept, text[place:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `whole` also spans (array of byte ranges) and kept.

    A missing or empty text has no bytes.  A missing doc_id comes after all others.  Rows that repeat doc_id and text are one document;
    rows with one doc_id and different texts are different documents, in an order made of their texts.  Strings may be cut inside a
    character, so `kept` is binary.  Further columns don't matter, and an empty table gives an empty result.
    """
    slim = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), docs["text"].alias("text"))
    gone = gone_starts(slim, length).groupBy("doc", "dk", "dl").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    joined = packed(slim).join(gone, ["doc", "dk", "dl"], "left").select(F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"), "z", "starts")
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<a: long, b: long>>, kept binary" if whole else "")

    def make():
        expand = zstandard.ZstdDecompressor()

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for z, starts in zip(batch.column("z").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                text = expand.decompress(z)
                spans, kept = without(text, [(s["at"], s["n"]) for s in starts or []], length)
                for k, v in zip(out, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in spans], kept), strict=True):
                    out[k].append(v)
            return out

        return work

    return mapped(joined, make, added, keep=["doc_id"])
