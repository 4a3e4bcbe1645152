"""License scans with a positional index of rare words.

The index holds, for each word of the licence templates, where it stands in which template.  A word's rarity (IDF) is counted over the
whole corpus.  A file is looked up by the rarest word of each template's key phrases; every place of it gives a place of the template in the
file.  These are intersected with the places that the next rare words give, until none is left, and what is left is verified: all
mandatory key phrases must stand, consecutively, where the template has them, and enough of the template's words at their places.

Phrases that make base labels are places of consecutive words; they are found through the rarest word of each phrase.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.arrow import mapped, sliced, texts

#: Runs of ASCII letters and digits and of all other characters beyond ASCII, in lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, sentence of the licence's usual notice, mandatory key phrases.  Fixed values: the wording is that of the licences.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     ("permission is hereby granted", "free of charge")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
     ("this permission notice shall be included",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
     ("in no event will the authors be held liable",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     ("free software", "gnu general public license")),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license",
     ("gnu general public license", "version 2 of the license")),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license",
     ("gnu general public license", "version 3 of the license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0-1.0", "waived all copyright and related or neighboring rights to this work", ("all copyright and related or neighboring rights",)),
    ("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("artistic-2.0", "under the terms of the artistic license 2 0", ("artistic license",)),
    ("ofl-1.1", "licensed under the sil open font license version 1 1", ("sil open font license",)),
    ("odbl", "made available under the open database license", ("open database license",)),
)
#: Identifiers of SPDX lines.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()


def spdx_template(name: str) -> tuple[str, str, tuple[str, ...]]:
    line = "spdx license identifier " + re.sub("[^0-9a-z]+", " ", name.lower())
    return name.lower(), line, (line,)


TEMPLATES = NOTICES + tuple(spdx_template(name) for name in SPDX)
#: Rarest words of a template's key phrases that the look-up intersects; share of a template's words that must stand at their places.
RARE_WORDS, LEAST_SHARE = 4, 0.75


def _split(text: str) -> list[bytes]:
    return text.encode().split()


def vocabulary(templates=TEMPLATES, phrases=BASE_PHRASES) -> list[bytes]:
    return sorted({w for _, text, _ in templates for w in _split(text)} | {w for p in phrases for w in _split(p)})


def document_frequencies(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES) -> tuple[int, dict[bytes, int]]:
    """Documents, and how many hold each licence word, over the whole table; as many rows come back as the templates have words."""
    words = frozenset(vocabulary(templates, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in texts(batch):
                seen[b""] += 1
                seen.update(words.intersection(WORD.findall(text.lower())))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen], "n": list(seen.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select(docs["text"].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"].encode(): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class LicenseIndex:
    """The templates as postings of their rarest words, and the scan of one file."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, phrases=BASE_PHRASES, rare_words: int = RARE_WORDS, least_share: float = LEAST_SHARE):
        def rarity(w: bytes) -> tuple[float, bytes]:
            return -idf.get(w, math.inf), w

        self.least = least_share
        self.labels = [label for label, _, _ in templates]
        self.words = [_split(text) for _, text, _ in templates]
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        #: word -> (template, place in it) of the postings that begin an intersection: each template's rarest key word
        self.first: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        #: of each template, the further (word, place) to intersect with, rarest first
        self.others: list[list[tuple[bytes, int]]] = []
        for t, words in enumerate(self.words):
            keys = [_split(k) for k in templates[t][2]]
            at = [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in keys]
            self.keys.append(list(zip(at, keys, strict=True)))
            # a file that lacks a key word lacks the template, so key words alone may be intersected
            places = sorted({(w, a + i) for a, k in self.keys[t] for i, w in enumerate(k)}, key=lambda x: (rarity(x[0]), x[1]))[:rare_words]
            self.first[places[0][0]].append((t, places[0][1]))
            self.others.append(places[1:])
        #: rarest word of a phrase -> (place in it, phrase, label)
        self.anchors: dict[bytes, list[tuple[int, list[bytes], str]]] = defaultdict(list)
        for p, label in phrases.items():
            phrase = _split(p)
            k = min(range(len(phrase)), key=lambda i: (rarity(phrase[i]), i))
            self.anchors[phrase[k]].append((k, phrase, label))
        self.rare = frozenset(self.first) | {w for o in self.others for w, _ in o}
        self.wanted = self.rare | frozenset(self.anchors)

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base labels, labels, score)"""
        words = WORD.findall(text.lower())
        found = self.wanted.intersection(words)
        starts, base, labels, score = [], set(), set(), 0.0
        if found:
            places: dict[bytes, list[int]] = {w: [] for w in found}
            for i, w in enumerate(words):
                if w in places:
                    places[w].append(i)
            for w in found & self.anchors.keys():
                for k, phrase, label in self.anchors[w]:
                    hits = [i - k for i in places[w] if i >= k and words[i - k : i - k + len(phrase)] == phrase]
                    if hits:
                        starts += hits
                        base.add(label)
            labels, score = self._templates(words, places)
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
            1.0 if base else score,
        )

    def starts(self, places: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """(template, place of its first word) where all its rarest key words stand at their relative places."""
        for w in self.first.keys() & places.keys():
            for t, place in self.first[w]:
                left = {i - place for i in places[w]}
                for other, at in self.others[t]:
                    left.intersection_update([i - at for i in places.get(other, ())])
                    if not left:
                        break
                yield from ((t, at) for at in left)

    def _templates(self, words: list[bytes], places: dict[bytes, list[int]]) -> tuple[set[str], float]:
        """Labels of verified templates, and the largest share of a template found in place."""
        labels, best = set(), 0.0
        for t, at in self.starts(places):
            want = self.words[t]
            if any(at + k < 0 or words[at + k : at + k + len(key)] != key for k, key in self.keys[t]):
                continue
            share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(want)) / len(want)
            best = max(best, share)
            if share >= self.least:
                labels.add(self.labels[t])
        return labels, best


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places count words from 0; first and last are missing where no phrase stands.  Labels are distinct, sorted and joined by commas, empty
    where there are none.  A missing or empty text has no words and score 0.  Rows are judged one by one: ties and repeated rows have equal
    results, a missing doc_id stays missing, further columns don't matter, and an empty table gives an empty result.  The score is 1 for a
    phrase, else the largest share of a template found in place with its key phrases.
    """
    n, counts = document_frequencies(docs, templates, phrases)
    idf = {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary(templates, phrases)}

    def make():
        index = LicenseIndex(idf, templates, phrases)
        names = [c.split()[0] for c in SCAN.split(", ")]

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            rows = [index.scan(t) for t in texts(batch)]
            return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[] for _ in names], strict=True))

        return work

    return mapped(docs.select(docs["doc_id"], docs["text"].alias("text")), make, SCAN, keep=["doc_id"])
