import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import risk as R
from pactlens.functions import clauses as CC
from pactlens.functions import confidence as CF
from pactlens.functions import risk as RF
from pactlens.functions.text import WHITESPACE_CHARS
from pactlens.session import materialize
from workload.bank import BANK


def brute_candidates(text):
    found = []
    for order, kind, keyword in CC.keyword_table():
        for m in re.finditer(rf"(?ai)\b{keyword}\b[^.]{{0,200}}[.]", text):
            start, end = max(0, m.start() - 100), min(len(text), m.end() + 100)
            found.append((order, m.start(), kind, m.group(), text[start:end].strip(WHITESPACE_CHARS), start, end))
    return found


def brute_kept(text):
    kept = []
    for c in brute_candidates(text):
        prefix = c[3].lower()[:50]
        same = [k for k in kept if k[2] == c[2]]
        if len(c[4]) > 30 and not any(prefix in k[4].lower() or abs(k[5] - c[5]) < 50 for k in same):
            kept.append(c)
    return kept


def brute_top(text):
    first = {}
    for c in brute_kept(text):
        first.setdefault(c[5], c)
    return [first[s] for s in sorted(first)][:25]


def sample_texts():
    texts = ["", "no period at all but a term", "term.", "Term. term. term.", "x" * 300 + " rent " + "y" * 250 + "."]
    pool = BANK + ["é term é.", "TERM and term, term.", "endend end_ end-end.", "a.b.c.", "rent " * 60 + "."]

    @settings(max_examples=80, deadline=None, database=None)
    @given(st.lists(st.sampled_from(pool), max_size=12))
    def collect(parts):
        texts.append(" ".join(parts))

    collect()
    return texts


def test_extraction_against_brute_force(spark):
    texts = sample_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    found = df.select("i", CC.clause_candidates(F.col("text")).alias("c"), F.col("text"))
    rows = found.select("i", "c", CC.dedupe_clauses(F.col("c")).alias("k")).select(
        "i", "c", "k", CC.top_clauses(F.col("k")).alias("t")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert [(c["ord"], c["at"], c["type"], c["hit"], c["content"], c["start"], c["end"]) for c in r["c"]] == brute_candidates(text)
        assert [(c["ord"], c["at"]) for c in r["k"]] == [(c[0], c[1]) for c in brute_kept(text)]
        assert [(c["clause_no"], c["start"], c["type"], c["content"]) for c in r["t"]] == [
            (i + 1, c[5], c[2], c[4]) for i, c in enumerate(brute_top(text))]


def test_at_most_25_clauses_and_every_sentence_counts(spark):
    text = " ".join(f"Sentence number {i:03d} sets the term and the rent for house {i * 7919 % 997} in street {i * 31}." for i in range(60))
    n = spark.createDataFrame([(text,)], "text string").select(F.size(CC.extract_clauses(F.col("text"))).alias("n")).first()["n"]
    assert n == 25


def test_long_documents_are_read_to_the_end(spark):
    text = "word " * 60_000 + "The arbitration takes place in a far town near the sea."
    clauses = spark.createDataFrame([(text,)], "text string").select(CC.extract_clauses(F.col("text")).alias("c")).first()["c"]
    assert [c["type"] for c in clauses] == ["dispute_resolution"]


def test_rule_classifiers(one):
    assert one(CF.classify_first_match, ["the tender offer", "Payment now", "governing", "zzz"]) == [
        "termination", "payment", "governing_law", "other"]
    assert one(CF.classify_rules_13, ["act of god", "the assignor will assign", "upkeep", "zzz"]) == [
        "force_majeure", "assignment", "internal_maintenance", "other"]
    assert one(CF.classify_dominant, ["pay the fee or end", "terminate and pay", "loss of secret private data", "zzz"]) == [
        "payment", "termination", "confidential", "general"]


def test_rule_confidence(spark):
    rows = [("pay", "payment", 0.5), ("pay the fee and the invoice", "payment", 0.8), ("x" * 101, "other", 0.6), ("x" * 30, "other", 0.5),
            ("pay payment fee cost price invoice " + "x" * 100, "payment", 0.95), ("short", "nothing", 0.4), ("term of the lease here", "DURATION", 0.6)]
    df = spark.createDataFrame(rows, "text string, label string, want double")
    for r in df.select("text", "want", CF.rule_confidence(F.col("text"), F.col("label")).alias("got")).collect():
        assert r["got"] == r["want"], r


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, 2.0],), ([5.0],)], "logits array<double>")
    assert [r[0] for r in df.select(CF.softmax_confidence(F.col("logits"))).collect()] == [0.5, 0.881, 1.0]


def test_levels(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(CF.confidence_level(F.col("s"))).collect()] == ["HIGH", "MEDIUM", "LOW", "VERY_LOW"]
    assert [r[0] for r in df.select(CF.clause_confidence_level(F.col("s"))).collect()] == ["high", "medium", "low", "low"]


def test_base_risk_by_hand(spark):
    rows = [("unlimited liability for all", "liability", 1.0, 10.0),  # 5.4 + 1.5 + 4 = 10.9, clamped
            ("nothing special", "force_majeure", 0.5, 1.6),  # 2.4 * 0.65 = 1.56
            ("good faith and a cure period", "governing_law", 1.0, 1.5),  # 2.7 - 0.4 - 0.8
            ("a BROAD IP ASSIGNMENT", "intellectual_property", 1.0, 6.3),  # 4.8 + 1.5
            ("text", "unknown", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "c string, t string, k double, want double")
    for r in df.select("want", RF.base_clause_risk(F.col("c"), F.col("t"), F.col("k")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_triggers_positions_overlaps_and_type_words(spark):
    text = "Immediate written consent; immediately no. A commercially reasonable NOTICE, éwaive waive."
    df = spark.createDataFrame([(text,)], "c string")
    got = df.select(RF.risk_triggers(F.col("c")).alias("t")).first()["t"]
    want = sorted(
        (m.start(), i, w) for i, (w, *_) in enumerate(R.RISK_TRIGGERS + R.MITIGATORS) for m in re.finditer(rf"(?ai)\b{w}\b", text))
    assert [(t["start"], t["word"]) for t in got] == [(s, w) for s, _, w in want]
    assert all(t["end"] - t["start"] == len(t["word"]) for t in got)
    extra = df.select(RF.risk_triggers(F.col("c"), F.lit("payment"), {"payment": ["consent", "waive"], "duration": ["NOTICE"]}).alias("t")).first()["t"]
    added = [t for t in extra if t["kind"] == "clause_specific"]
    assert [(t["word"], t["weight"], t["category"]) for t in added] == [("consent", 2.0, "payment")]


def test_xai_risk_explanation_and_priority(spark):
    df = spark.createDataFrame([("unlimited and binding under good faith", "payment"), ("plain", "payment")], "c string, t string")
    out = df.select(RF.risk_triggers(F.col("c")).alias("x"), "t").select(
        RF.xai_risk(F.lit(5.0), F.col("x")).alias("s"), RF.xai_explanation(F.col("x"), F.col("t")).alias("e")).collect()
    assert abs(out[0]["s"] - (5 + 0.3 * (4 + 2 - 0.6))) < 1e-9
    assert out[0]["e"] == ('Risk factors identified: 2 trigger(s) found. Key concerns include "unlimited", "binding". '
                           'Positive factors: 1 risk mitigator(s) found including "good faith". ')
    assert out[1]["s"] == 5.0 and out[1]["e"].startswith("No specific risk triggers identified in this payment clause.")
    levels = spark.createDataFrame([(8.0, "other"), (6.0, "payment"), (6.0, "venue"), (5.0, "confidentiality"), (3.9, "payment")], "s double, t string")
    assert [r[0] for r in levels.select(RF.clause_priority(F.col("s"), F.col("t"))).collect()] == ["critical", "high", "medium", "high", "low"]


CLAUSE = "array<struct<type:string,confidence:double,risk_score:double,requires_review:boolean,priority:string,confidence_level:string>>"


def test_document_scores(spark):
    some = [("payment", 0.5, 8.0, True, "critical", "low"), ("duration", 1.0, 2.0, False, "low", "high")]
    df = spark.createDataFrame([(some, 2000), ([], 10)], f"c {CLAUSE}, n int")
    out = df.select(
        RF.overall_risk(F.col("c"), F.col("n")).alias("r"), RF.missing_clauses(F.col("c")).alias("m"), "c", "n").select(
        "r", "m", RF.recommendations(F.col("c"), F.col("m"), F.col("n"), F.lit(True)).alias("rec"),
        RF.analysis_summary(F.col("c"), F.col("r"), F.col("m"), F.lit(False)).alias("s"), RF.trust_report(F.col("c")).alias("t")).collect()
    assert abs(out[0]["r"] - ((8 * 0.5 + 2) / 1.5 + 1.4 + 0.8)) < 1e-9
    assert out[0]["m"] == [t for t in C.STANDARD_TYPES if t not in ("payment", "duration")]
    assert out[1]["r"] == 6.0 and out[1]["m"] == C.STANDARD_TYPES
    assert out[1]["rec"][0] == R.REC_BATCH and R.REC_SHORT in out[1]["rec"] and len(out[1]["rec"]) <= 15
    assert out[1]["s"].startswith("Trust & Safety enhanced AI analysis reveals medium risk level (6/10) with 0 clause(s) identified. ")
    assert out[1]["t"]["average_confidence"] is None
    assert out[0]["t"].asDict() == {
        "high_confidence": 1, "requires_review": 1, "audit_recommended": False, "average_confidence": 0.75, "low_confidence": 1}


def test_advice_overrides_and_suffix(spark):
    rows = [("unlimited and sole discretion", "liability", "HIGH", "low", True, 8.0), ("x", "venue", "ODD", "medium", False, 5.0),
            ("x", "duration", "LOW", "high", False, 4.0)]
    df = spark.createDataFrame(rows, "c string, t string, l string, k string, r boolean, s double")
    c, t, lv, k, r, s = (F.col(x) for x in "ctlkrs")
    book = df.select(RF.handbook_suggestions(c, t, lv, k, r).alias("a")).select("a.*").collect()
    assert book[0]["suggestion"] == R.LEVEL_MODIFIERS["high"][0] + R.HANDBOOK_SOLE_DISCRETION[0] + R.ADVICE_REVIEW_SUFFIX
    assert book[1]["suggestion"].startswith(R.LEVEL_MODIFIERS["medium"][0])
    assert book[1]["specific_language"] == R.HANDBOOK_LANGUAGE_DEFAULT
    tiers = df.select(RF.tiered_suggestions(c, t, s, k, r).alias("a")).select("a.*").collect()
    assert tiers[0]["suggestion"] == R.ADVICE_SOLE_DISCRETION[0] + R.ADVICE_REVIEW_SUFFIX
    assert tiers[1]["suggestion"] == R.GENERIC_ADVICE["medium"][0]
    assert tiers[2]["suggestion"] == R.TIERED_ADVICE[("duration", "low")][0]


def test_segments_repeat_overlaps(spark):
    df = spark.createDataFrame([("a commercially reasonable act",), ("plain",), ("",)], "c string")
    rows = df.select(RF.highlight_segments(F.col("c"), RF.risk_triggers(F.col("c"))).alias("s")).collect()
    assert [(x["text"], x["kind"]) for x in rows[0]["s"]] == [
        ("a ", "plain"), ("commercially reasonable", "mitigator"), ("reasonable", "mitigator"), (" act", "plain")]
    assert [(x["text"], x["kind"]) for x in rows[1]["s"]] == [("plain", "plain")]
    assert rows[2]["s"] == []


def test_running_value_is_not_a_mean(spark):
    some = [("payment", 0.5, v, True, "low", "low") for v in (2.0, 4.0, 8.0)]
    r = spark.createDataFrame([(some,)], f"c {CLAUSE}").select(RF.clause_type_rollup(F.col("c")).alias("x")).first()["x"][0]
    assert (r["n"], r["running"], round(r["mean"], 3)) == (3, 5.5, 4.667)


def _clause_text(rng, sentences, numbers):
    keywords = [k for _, words, _ in C.CLAUSE_TYPES.values() for k in words]
    out = []
    for _ in range(sentences):
        words = [rng.choice(["alpha", "beta", "the", "of", "Party", "shall", "x", str(rng.randrange(numbers))]) for _ in range(rng.randrange(1, 14))]
        for _ in range(1 + (rng.random() < 0.3)):
            words.insert(rng.randrange(len(words)), rng.choice(keywords))
        out.append(" ".join(words) + rng.choice([".", ". ", ".\n", ".."]))
    return "".join(out)


def test_window_index_keeps_what_comparing_keeps(spark):
    rng = random.Random(3)
    rows = [(i, _clause_text(rng, rng.randrange(3, 60), rng.choice([3, 1000]))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4).select("id", CC.clause_candidates(F.col("text")).alias("c"))
    both = df.select(
        "id", CC.dedupe_clauses(F.col("c"), compared=10**9).alias("compared"), CC.dedupe_clauses(F.col("c"), compared=-1).alias("indexed"),
        CC.dedupe_clauses(F.col("c"), compared=5).alias("mixed"), F.size("c").alias("n"),
    ).collect()
    assert all(r["compared"] == r["indexed"] == r["mixed"] for r in both)
    assert 0 < sum(len(r["compared"]) for r in both) < sum(r["n"] for r in both)


def test_dedupe_time_grows_with_the_candidates(spark):
    """Four times the candidates of one type take well below the sixteen-fold time of comparing all with all."""
    rng = random.Random(5)
    took = {}
    for n in (1000, 4000, 16000):
        text = "".join(f"tenant pays rent number {i} and {rng.randrange(10**12)} {rng.randrange(10**12)} more for it. " for i in range(n))
        df = materialize(spark.createDataFrame([(text,)], "text string").select(CC.clause_candidates(F.col("text")).alias("c")), "candidates")
        kept = df.select(F.size(CC.dedupe_clauses(F.col("c"))).alias("k"))
        start = time.monotonic()
        assert kept.first()["k"] > n // 4
        took[n] = time.monotonic() - start
    assert took[16000] < 8 * took[4000] + 1.0


def test_folds_of_bundles(spark):
    from pactlens.functions.text import BUNDLE, fold

    sizes = [0, 1, BUNDLE - 1, BUNDLE, BUNDLE + 1, 3 * BUNDLE + 7]
    df = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, items array<int>")
    out = fold(
        F.col("items"), F.lit(0), lambda s, x: (s + x, F.when(x % 2 == 0, F.array(s + x)).otherwise(F.array().cast("array<int>"))), "int", lambda s: F.array(-s),
    )
    for r in df.select("n", out.alias("out")).collect():
        sums = [sum(range(k + 1)) for k in range(0, r["n"], 2)]
        assert r["out"] == [*sums, -sum(range(r["n"]))]


def test_phrases_of_a_table(spark):
    from pactlens.operators.phrases import phrase_hits

    rng = random.Random(9)
    words = ["rent", "Due", "a", "sole", "discretion", "12", "é", "x_y"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ". "]) for _ in range(rng.randrange(300))) for _ in range(40)] + ["", None, "rent"]
    phrases = ["rent", "sole discretion", "a a a", "due a 12", "SOLE discretion", "x_y  rent", "rent, due", "12", " no", "é a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, phrase_hits(df, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()))
    want = [
        (k, p, m.start(1), m.end(1)) for k, t in enumerate(texts) for p in phrases if p not in (" no", "é a")
        for m in re.finditer(rf"(?ai)(?<!\w)(?=({p})(?!\w))", t or "")
    ]
    assert got == sorted(want) and len(got) > 300
    assert phrase_hits(df, spark.createDataFrame([], "phrase string")).count() == 0


def test_phrase_time_hardly_grows_with_the_table(spark):
    from pactlens.operators.phrases import phrase_hits

    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    df = materialize(spark.createDataFrame([(k, " ".join(rng.choice(vocabulary) for _ in range(2000))) for k in range(40)], "doc_id long, text string").repartition(8), "texts")
    took = {}
    for n in (100, 100, 10_000):
        table = spark.createDataFrame([(f"{rng.choice(vocabulary)} {rng.choice(vocabulary)}",) for _ in range(n)], "phrase string")
        start = time.monotonic()
        phrase_hits(df, table).count()
        took[n] = time.monotonic() - start
    assert took[10_000] < 3 * took[100] + 1.0
