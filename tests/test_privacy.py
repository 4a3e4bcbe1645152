import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.fixed import privacy as P
from pactlens.functions import privacy as PF
from pactlens.functions import spans as SF
from pactlens.functions.spans import find_spans, merge_overlapping_spans, redact_spans
from pactlens.session import materialize


def tuples(spans):
    return [(s["text"], s["label"], s["start"], s["end"]) for s in spans]


def expected_hits(text, patterns, flags):
    return [(m.group(), name, m.start(), m.end()) for name, regex in patterns for m in re.finditer(regex, text, flags)]


TEXTS = [
    "", "nothing here", "a@b.co", "mail a.b@c.org and x@y.net, call 555-123-4567 or +1 555.123.4567",
    "ssn 123-45-6789 card 4111-1111-1111-1111 host 10.0.0.1", "4111111111111111", "(555) 987-6543",
    "éa@b.com a@b.comé 12é3.4.5.6", "John Smith met Mary Ann Jones", "Le Moé Xa Yb", "marks \x01 in x@y.org \x02 text 123-45-6789",
    "x@y.org\x01\x02", "😀 x@y.org 😀 123-45-6789", "555 123 4567", "$555$-123-4567", "١٢٣-٤٥-٦٧٨٩",
]


def test_configured_spans_equal_finditer(one):
    patterns = [(n.upper(), r) for n, r, _ in P.CONFIGURED_PATTERNS]
    for text, spans in zip(TEXTS, one(PF.detect_pii_configured, TEXTS), strict=True):
        assert tuples(spans) == expected_hits(text, patterns, re.IGNORECASE), text


def test_basic_spans_equal_finditer(one):
    patterns = [(n, r) for n, r, _ in P.BASIC_PATTERNS]
    for text, spans in zip(TEXTS, one(PF.detect_pii_basic, TEXTS), strict=True):
        assert tuples(spans) == expected_hits(text, patterns, 0), text


def test_phone_is_found_and_card_wins_the_overlap(one):
    merged = one(PF.find_and_merge, ["call 555-123-4567", "card 4111111111111111 end"])
    assert [s["label"] for s in merged[0]] == ["PHONE"]
    assert [s["label"] for s in merged[1]] == ["CREDIT_CARD"]


span = st.tuples(st.integers(0, 30), st.integers(1, 10), st.sampled_from([0.8, 0.9, 1.0]))


def brute_merge(spans):
    kept = []
    for s in sorted(spans, key=lambda s: s[0]):
        if not kept or s[0] >= kept[-1][0] + kept[-1][1]:
            kept.append(s)
        elif (s[2], s[1]) > (kept[-1][2], kept[-1][1]):
            kept[-1] = s
    return kept


def test_merge_and_redact_against_brute_force(spark):
    cases = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(span, max_size=8))
    def collect(spans):
        cases.append(spans)

    collect()
    text = "".join(chr(ord("a") + i % 26) for i in range(45))
    rows = [
        (i, text, [(text[s:s + n], "L", s, s + n, c, "[X]") for s, n, c in spans]) for i, spans in enumerate(cases)
    ]
    df = spark.createDataFrame(rows, f"i int, text string, spans {SF.SPANS}")
    merged = df.select("i", "text", SF.merge_overlapping_spans(F.col("spans")).alias("m"))
    result = merged.select("i", "m", SF.redact_spans(F.col("text"), F.col("m")).alias("r")).collect()
    assert len(result) == len(cases)
    for row in result:
        kept = brute_merge(cases[row["i"]])
        assert [(s["start"], s["end"], s["confidence"]) for s in row["m"]] == [(s, s + n, c) for s, n, c in kept]
        assert all(a["end"] <= b["start"] for a, b in zip(row["m"], row["m"][1:], strict=False))
        wanted = text
        for s, n, _ in reversed(kept):
            wanted = wanted[:s] + "[X]" + wanted[s + n:]
        assert row["r"] == wanted


def test_scores_levels_and_advice(spark):
    text = "Contact user1@mail.example.com, ssn 123-45-6789."
    df = spark.createDataFrame([(text,), ("clean text",), ("",)], "text string")
    merged = df.select("text", PF.find_and_merge(F.col("text")).alias("m"))
    rows = merged.select(
        PF.privacy_score(F.col("text"), F.col("m")).alias("s"), PF.weighted_privacy_score(F.col("m")).alias("w"),
        PF.basic_privacy_audit(F.col("m")).alias("b"),
    ).collect()
    chars = len("user1@mail.example.com") + 11
    assert rows[0]["s"] == max(0.0, round(1 - (2 * chars / len(text) + 0.5 * 0.85), 3))
    assert rows[1]["s"] == rows[2]["s"] == 1.0
    assert (rows[0]["w"]["score"], rows[0]["w"]["level"]) == (40, "FAIR")
    assert (rows[1]["w"]["score"], rows[1]["w"]["level"]) == (100, "EXCELLENT")
    assert rows[0]["b"]["compliance_level"] == "MODERATE" and rows[1]["b"]["compliance_level"] == "SAFE"


def test_literal_redaction_replaces_every_occurrence(one):
    result = one(lambda t: SF.redact_literal(t, PF.detect_pii_basic(t)), ["John Smith and John Smith, a@b.co"])
    assert result == ["[PERSON] and [PERSON], [EMAIL]"]


def test_no_configured_match_of_a_removed_span_stays(one):
    texts = [t for t in TEXTS if "\x01" not in t]
    redacted = one(lambda t: SF.redact_spans(t, PF.find_and_merge(t)), texts)
    for text, out in zip(texts, redacted, strict=True):
        for name, regex, _ in P.CONFIGURED_PATTERNS:
            if name in ("email", "credit_card"):
                assert not re.search(regex, out, re.IGNORECASE), (text, out)


def test_spans_over_chunks_equal_those_of_the_whole(spark):
    """Overlapping spans of random confidence, across the edges of chunks of any size."""
    from pactlens.operators import long_texts as OL

    rng = random.Random(12)
    table = [
        {"regex": r"[ab]{2,9}", "label": "AB", "confidence": 0.5, "replacement": "[AB]"}, {"regex": r"b[bc]{1,12}", "label": "BC", "confidence": 0.7, "replacement": "[BC]"},
        {"regex": r"c[a-d]{3}", "label": "CD", "confidence": 0.7, "replacement": "[CD]"}, {"regex": r"dé", "label": "D", "confidence": 0.9, "replacement": ""},
    ]
    rows = [(k, "".join(rng.choice("abcdé  ") for _ in range(rng.choice([0, 1, 50, 400, 2000])))) for k in range(30)] + [(100, None)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "texts")
    find = lambda text: find_spans(text, table)
    whole = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), merge_overlapping_spans(find(F.coalesce("text", F.lit("")))).alias("spans"))
    want = {r["doc_id"]: (r["redacted"], [tuple(s) for s in r["spans"]]) for r in whole.select("doc_id", "spans", redact_spans(F.col("text"), F.col("spans")).alias("redacted")).collect()}
    for chunk, margin in ((20, 20), (64, 30), (10**6, 100)):
        chunks = OL.chunk_documents(df, chunk, margin)
        merged = materialize(OL.merge_span_rows(OL.spans_of_chunks(chunks, find, chunk)), "merged")
        pieces, spans = {k: [] for k in want}, {k: [] for k in want}
        for r in OL.redact_chunks(chunks, merged, chunk).collect():
            pieces[r["doc_id"]].append((r["chunk"], r["redacted"]))
        for r in merged.collect():
            spans[r["doc_id"]].append(tuple(r["span"]))
        got = {k: ("".join(p for _, p in sorted(pieces[k])), sorted(spans[k], key=lambda s: s[2])) for k in want}
        assert got == want
    with pytest.raises(ValueError, match="margin"):
        OL.chunk_documents(df, 10, 20)
