"""BPE encoding and decoding with a vocabulary file of the tokenizers library, equal to the library's own result.

A text longer than a leaf is encoded by tree concatenation, without looking for places where it might be split: it is halved down to
leaves, which are encoded side by side; then halves are joined bottom-up.  Around a join a window is encoded anew and grown until it
shares a token, at the same place, with the encoding of each side.  A token sequence is the encoding of its text exactly if each
neighbouring pair of tokens is the encoding of its own text, so sequences that share a token may be spliced there.  What the halves got wrong
(a word cut in two, a merge across the cut, or the word-end mark that a half gets and the whole doesn't) lies inside the window.
Places are counted in bytes of the normalised text without white space, which belongs to no token.

Leaves are encoded with a table: white space always ends a word of this vocabulary, and so does the end of a run of
letters, so a leaf is a sequence of such words and of the rest between them, and equal ones have equal ids.  Each worker keeps the ids
of what it has met, within a bound of bytes, and encodes the new ones of a batch together.  Windows and words that a cut has broken go past it.  A-Z go to lower case first, as the
vocabulary's normaliser does anyway.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pactlens.llm.arrow import mapped

#: Characters of a leaf; characters on each side of a join at first; how far a cut may move to stand between ASCII characters.
LEAF, REACH, SHIFT = 1536, 24, 64
#: Bytes that a worker spends on what it has met, and bytes of an entry besides its texts.
REMEMBERED, ENTRY = 32 << 20, 320
#: Letters up to another ASCII character or the end are a word for the pre-tokenizer; what remains of a run stays together.
RUN = re.compile(r"[a-zß-öø-ÿ]+(?=[\x00-\x40\x5B-\x60\x7B-\x7F]|\Z)|[^\x20\x09-\x0D]+")
WORD_END = "</w>"


class TreeBpe:
    """Encoder of one vocabulary file, whose pre-tokenizer splits at white space and whose words end with a mark."""

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.reach, self.remembered, self.together = max(2, leaf), max(1, reach), remembered, 64
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([t.endswith(WORD_END) for t in self.tokens])
        # of a token, the bytes of text: a character of the byte alphabet stands for one byte
        self.bytes = [len(t.removesuffix(WORD_END)) for t in self.tokens]
        self.sizes = np.array(self.bytes, np.int64)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def plain(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def each(self, many: list[str]) -> list[list[int]]:
        """Ids of each text, one after the other: `encode_batch` starts threads for all cores of the machine, which Spark's tasks hold already."""
        return [self.tok.encode(t, add_special_tokens=False).ids for t in many]

    def _entry(self, ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def learn(self, runs: set[str]) -> None:
        """Put new runs into the table.  Runs of letters are one word each, so many are encoded as one text and cut at word ends."""
        rest = [r for r in runs if not r.isalpha()]
        words = list(runs.difference(rest))
        if words:
            ids = np.asarray(self.plain(" ".join(words)), dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                start, data = 0, ids.tobytes()
                for w, stop in zip(words, stops.tolist(), strict=True):
                    self.known[w] = data[4 * start : 4 * stop]
                    start = stop
            else:  # a letter that the normaliser takes apart
                rest += words
        for r, ids in zip(rest, self.each(rest), strict=True):
            self.known[r] = self._entry(ids)

    def _runs(self, text: str) -> list[str]:
        # special tokens are told by case, so a text that may hold one stays as it is
        return RUN.findall(text if "<|" in text else text.encode().lower().decode())

    def _of_runs(self, split: list[list[str]]) -> list[bytes]:
        """Ids of lists of runs, by the table."""
        known = self.known
        wanted = set().union(*split)
        new = wanted.difference(known)
        if new and self.held > self.remembered:
            known.clear()
            self.held = 0
            new = wanted
        if new:
            self.learn(new)
            self.held += sum(ENTRY + 2 * len(r) + len(known[r]) for r in new)
        return [b"".join([known[r] for r in runs]) for runs in split]

    def encoded(self, many: list[str]) -> list[np.ndarray]:
        """Ids of short texts."""
        return [np.frombuffer(data, "<u4") for data in self._of_runs([self._runs(t) for t in many])]

    def directly(self, many: list[str]) -> list[np.ndarray]:
        """Ids of texts that won't come again, such as windows, past the table."""
        return [np.asarray(ids, "<u4") for ids in self.each(many)]

    def leaves(self, many: list[str]) -> list[np.ndarray]:
        """Ids of neighbouring pieces.  What a cut has left of a word is not put into the table."""
        split, edges = [self._runs(t) for t in many], []
        for k, runs in enumerate(split):
            head = [runs.pop(0)] if k and runs else []
            tail = [runs.pop()] if k < len(split) - 1 and runs else []
            edges += [head, tail]
        cut = iter(self.directly([r for e in edges for r in e]))
        ends = [next(cut).astype("<u4").tobytes() if e else b"" for e in edges]
        middles = self._of_runs(split)
        return [np.frombuffer(ends[2 * k] + data + ends[2 * k + 1], "<u4") for k, data in enumerate(middles)]

    def cuts(self, text: str) -> list[int]:
        """Where the leaves of a text begin and end, between ASCII characters where there are any nearby."""
        out = [0]
        while len(text) - out[-1] > self.leaf:
            at = out[-1] + self.leaf
            near = range(at, min(at + SHIFT, len(text)))
            out.append(next((i for i in near if text[i - 1] < "\x80" and text[i] < "\x80"), at))
        return [*out, len(text)]

    def windows(self, text: str, pairs: list, reach: int) -> list[np.ndarray]:
        """Of each pair of nodes the ids of the window around the cut, and of its part before the cut."""
        sides = [(max(lo, mid - reach), mid, min(hi, mid + reach)) for (lo, mid, *_), (_, hi, *_) in pairs]
        return self.directly([t for x, mid, y in sides for t in (text[x:y], text[x:mid])])

    def joined(self, text: str, left, right, window: np.ndarray, before_cut: np.ndarray):
        """The node of both halves; a node is (start, end, ids, joins)."""
        (lo, mid, a, m), (_, hi, b, n) = left, right
        reach = self.reach
        while True:
            x, y = max(lo, mid - reach), min(hi, mid + reach)
            before_bytes = int(self.sizes[before_cut].sum())
            places = self._places(window, -before_bytes)
            some = before_bytes + 1
            at_left = a[max(0, len(a) - some) :]
            at_left = {p: len(a) - len(at_left) + k for k, p in enumerate(self._places(at_left, -int(self.sizes[at_left].sum())))}
            at_right = {p: k for k, p in enumerate(self._places(b[: int(self.sizes[window].sum()) - before_bytes + 1], 0))}
            # (place in the half, place in the window) of the shared tokens nearest to the cut; a window that reaches the end needs none
            first = (0, 0) if x == lo else next(((at_left[p], k) for k, p in reversed(list(enumerate(places))) if p in at_left), None)
            last = (len(b), len(window)) if y == hi else next(((at_right[p], k) for k, p in enumerate(places) if p in at_right), None)
            if first and last and first[1] <= last[1]:
                return lo, hi, np.concatenate([a[: first[0]], window[first[1] : last[1]], b[last[0] :]]), m + n + 1
            reach *= 2
            window, before_cut = self.windows(text, [(left, right)], reach)

    def _places(self, ids: np.ndarray, start: int) -> list[tuple[int, int]]:
        """(first byte, id) of each token."""
        sizes = self.sizes[ids]
        return list(zip((np.cumsum(sizes) - sizes + start).tolist(), ids.tolist(), strict=True))

    def tree(self, text: str) -> tuple[np.ndarray, int]:
        """Ids of a text by tree concatenation, and the number of joins."""
        cuts = self.cuts(text)
        leaves = self.leaves([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        level = [(a, b, ids, 0) for a, b, ids in zip(cuts, cuts[1:], leaves, strict=False)]
        while len(level) > 1:
            pairs = list(zip(level[::2], level[1::2], strict=False))
            around = self.windows(text, pairs, self.reach)
            nodes = [self.joined(text, x, y, around[2 * k], around[2 * k + 1]) for k, (x, y) in enumerate(pairs)]
            level = nodes + (level[-1:] if len(level) % 2 else [])
        return level[0][2], level[0][3]

    def ids(self, many: list[str]) -> list[tuple[np.ndarray, int]]:
        """(ids, joins) of each text.  Strings of special tokens are told by case and may stand across a cut: such texts go whole."""
        long = [len(t) > self.leaf and "<|" not in t for t in many]
        out: list[tuple[np.ndarray, int] | None] = [self.tree(t) if far else None for t, far in zip(many, long, strict=True)]
        short = [k for k, far in enumerate(long) if not far]
        for start in range(0, len(short), self.together):
            some = short[start : start + self.together]
            for k, ids in zip(some, self.encoded([many[k] for k in some]), strict=True):
                out[k] = ids, 0
        return out

    def shown(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist()])

    def texts(self, many: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        return [(ids.astype("<u4").tobytes(), self.shown(ids)) for ids, _ in self.ids(many)]

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeBpe:
    """One per worker, so that what it has learnt outlives a task."""
    return TreeBpe(path)


def encode(docs: DataFrame, path: str, whole: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_joins; with `whole` also ids (array) and decoded (text).

    A missing or empty text, and one of white space only, has no tokens.  Strings of special tokens in a text become those tokens, as in
    the library.  Rows are encoded one by one: ties and repeated rows have equal results, a missing doc_id stays missing, further columns
    don't matter, and an empty table gives an empty result.  `path` must be readable on the executors.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long" + (", ids array<int>, decoded string" if whole else "")

    def make():
        bpe = encoder(path)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            found = bpe.ids([t or "" for t in batch.column("text").to_pylist()])
            shown = [bpe.shown(ids) for ids, _ in found]
            out = {
                "n_tokens": [len(ids) for ids, _ in found],
                "ids_sha256": [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids, _ in found],
                "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in shown],
                "n_joins": [joins for _, joins in found],
            }
            return out | ({"ids": [ids.astype("i4") for ids, _ in found], "decoded": shown} if whole else {})

        return work

    return mapped(docs.select(docs["doc_id"], docs["text"].alias("text")), make, added, keep=["doc_id"])
