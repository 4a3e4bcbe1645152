import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pactlens.llm import licenses, mixing, quality_rules, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, k in enumerate(windows):
        if seen[k] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(odd, docs):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = sorted((r["doc_id"], *base_rules(r["text"])) for r in both.filter("doc_id is not null").collect())
    rows = quality_rules.quality_rules(both).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"], *(r[c] for c in names)) for r in rows if r["doc_id"] is not None) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["failed_rules"] == "")


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    rule = quality_rules.Rule("words", "n_words", low=4)
    assert [r["kept"] for r in quality_rules.quality_rules(df, (rule,)).collect()] == [False]
    assert [r["kept"] for r in quality_rules.quality_rules(df, ()).collect()] == [True]


def test_rules_of_nothing(empty):
    assert quality_rules.quality_rules(empty).count() == 0


def test_targets_are_capped_and_reshared(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 100), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    total, weights = 1610 * 1.5, {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    limits = {"a": 20, "b": 2000, "c": 1000, None: 200, "d": 0}
    assert sum(got.values()) == pytest.approx(total)
    free = [k for k in got if got[k] < limits[k] - 1e-9]
    assert all(got[k] <= limits[k] for k in got) and len({round(got[k] / weights[k], 6) for k in free}) == 1


def by_hand(rows, plan):
    """Taken words by sorting each source as a whole."""
    out = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    for source, members in groups.items():
        size, target = plan[source]
        full = min(2, math.floor(target / size)) if size else 0
        rest, upto = target - full * size, 0
        for r in sorted(members, key=lambda r: r["key"]):
            upto += r["size"]
            extra = rest > 0 and (upto <= rest or upto - rest < rest - (upto - r["size"]))
            out[r["doc_id"]] = r["size"] * (full + bool(extra))
    return out


def test_mix_is_a_weighted_sample(docs):
    sized = mixing.sized_documents(docs)
    keyed = sized.withColumn("key", -F.log(mixing.uniform(F.col("doc_id"))) / F.col("weight")).collect()
    plan = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).collect()}
    want = by_hand(keyed, plan)
    for bin_rows in (3, 200, 10**6):
        got = {r["doc_id"]: r["taken"] for r in mixing.mix(sized.repartition(3), bin_rows=bin_rows).collect()}
        assert got == want


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(mixing.sized_documents(odd)).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(mixing.sized_documents(empty)).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.schema == odd.schema and mixed.count() > 0


def test_bins_are_even_whatever_the_weights(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'s' AS source", "1L AS size", "CASE WHEN id % 10 = 0 THEN 1.0D WHEN id % 3 = 0 THEN 0.1D ELSE 0.32D END AS weight")
    keyed = rows.withColumn("key", -F.log(mixing.uniform(F.col("doc_id"))) / F.col("weight"))
    sizes = keyed.withColumn("share", mixing.key_share(rows)).groupBy(F.floor(F.col("share") * 100).alias("bin")).count().collect()
    assert len(sizes) == 100 and max(r["count"] for r in sizes) < 2 * 200
    by_key = [r["share"] for r in keyed.withColumn("share", mixing.key_share(rows)).orderBy("key").select("share").collect()]
    assert by_key == sorted(by_key)


def test_rows_of_the_mix_are_those_taken(spark):
    """Rows without an id, or with one id and different texts, are taken one by one; equal rows share what is taken of them."""
    rows = [(None, f"w {k} " * (20 + k % 30), "a") for k in range(200)] + [(1, "x y " * 5, "a"), (1, "z " * 9, "a"), (1, "x y " * 5, "a")]
    rows += [(k, "b " * 10, "b") for k in range(2, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = mixing.mix(mixing.sized_documents(df)).agg(F.sum("taken")).first()[0]
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert sum(len(r["text"].split()) for r in mixed.collect()) == taken


def test_stop_words_are_whole_words(spark):
    from pactlens.llm.text_stats import with_stats

    texts = ["x the of and to x", "The OF\nand", "thee soften, the. -to", "the the the", "", None, "\x0bdes\x0b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    assert [r["s_n_stop"] for r in with_stats(df, "text").orderBy("doc_id").collect()] == [4, 3, 0, 3, 0, 0, 1]


def test_rollup_follows_changes(spark, tmp_path):
    schema = "batch_id string, change_id string, op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    rows = [
        ("b1", "1", "insert", "s", "en", "v1", 10, None), ("b1", "2", "insert", "s", None, "v1", 5, None), ("b1", "1", "insert", "s", "en", "v1", 10, None),
        ("b2", "3", "revise", "s", "en", "v1", 12, 10), ("b2", "4", "delete", "s", None, "v1", None, 5), ("b2", "5", "insert", None, "en", "v2", 3, None),
    ]
    feed = spark.createDataFrame(rows, schema)
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    rollup.commit(feed.filter("batch_id = 'b1'"))
    first = {tuple(r) for r in rollup.totals().collect()}
    assert first == {("s", "en", "v1", 1, 10), ("s", None, "v1", 1, 5)}
    rollup.commit(feed)  # b1 again, b2 for the first time
    again = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    again.commit(feed)
    want = {("s", "en", "v1", 1, 12), ("s", None, "v1", 0, 0), (None, "en", "v2", 1, 3)}
    assert {tuple(r) for r in again.totals().collect()} == want


def test_two_writers_of_one_batch(spark, tmp_path):
    rows = [("b1", "1", "insert", "s", "en", "v1", 10, None)]
    feed = spark.createDataFrame(rows, "batch_id string, change_id string, op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    a, b = (token_counts.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    a.commit(feed)
    b.commit(feed)  # b hasn't seen the commit of a
    assert [tuple(r) for r in token_counts.TokenRollup(spark, str(tmp_path / "r")).totals().collect()] == [("s", "en", "v1", 1, 10)]


def test_feed_of_odd_documents(spark, odd, empty, tmp_path):
    total = token_counts.rollup_of([token_counts.document_changes(odd)], spark, str(tmp_path / "odd"))
    n = sum(len(WORDS.findall(r["text"] or "")) >= 10 for r in odd.collect())
    assert {r["tokenizer"]: r["n"] for r in total.groupBy("tokenizer").agg(F.sum("n_docs").alias("n")).collect()} == {"words-1": n, "pieces-2": n}
    assert token_counts.rollup_of([token_counts.document_changes(empty)], spark, str(tmp_path / "none")).count() == 0


def license_base(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    found = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_phrases(odd, docs):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    want = sorted(((r["doc_id"], *license_base(r["text"])) for r in both.collect()), key=str)
    rows = licenses.scan_licenses(both).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=str) == want
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_license_templates(spark, empty):
    texts = [
        "x y z Licensed under the Apache License, Version 2.0 (the License)", "under the apache tribe, licensed version 2 0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the quick permission is granted",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == ["apache-2.0", "", "mit", ""]
    assert licenses.scan_licenses(empty).count() == 0


def plain_scan(text, templates, phrases):
    """Every template and phrase at every place of the file."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    base, starts, labels, best = set(), [], set(), 0.0
    for p, label in phrases.items():
        p = p.encode().split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        base |= {label} if hits else set()
    for label, notice, keys in templates:
        want = notice.encode().split()
        places = [next(i for i in range(len(want)) if want[i : i + len(k)] == k) for k in (x.encode().split() for x in keys)]
        for at in range(-len(want), len(words)):
            if all(at + i >= 0 and words[at + i : at + i + len(k.split())] == k.encode().split() for i, k in zip(places, keys, strict=True)):
                share = sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(want)) / len(want)
                best = max(best, share)
                labels |= {label} if share >= licenses.LEAST_SHARE else set()
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
        1.0 if base else best,
    )


def test_labels_and_score_against_every_place(spark):
    rng = __import__("random").Random(4)
    filler = "some other words of the license software and public free text".split()
    texts = ["SPDX-License-Identifier: GPL-3.0-or-later", "All rights reserved. Some rights reserved.", ""]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):  # altered, cut and prolonged notices
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice(filler)]
            parts += [rng.choice(filler) for _ in range(rng.randrange(5))] + words[rng.randrange(3) * (rng.random() < 0.3) :]
        texts.append(rng.choice([" ", ", "]).join(parts).title())
    phrases = licenses.BASE_PHRASES | {"some rights reserved": "some"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(df, phrases=phrases).collect()}
    want = {k: plain_scan(t, licenses.TEMPLATES, phrases) for k, t in enumerate(texts)}
    assert got == want and len({w[5] for w in want.values()}) > 40
    assert "some" in got[1][5] and got[1][1] == 2 and got[0][5] == "gpl-3.0-or-later"


def test_an_intersection_ends_early():
    """A template whose second rare word stands elsewhere gives no place to verify."""
    index = licenses.LicenseIndex({}, (("t", "one two three four", ("one two three four",)),), {})
    assert list(index.starts({b"one": [5], b"two": [6], b"three": [7], b"four": [8]})) == [(0, 5)]
    assert list(index.starts({b"one": [5, 20], b"two": [7], b"three": [22], b"four": [8, 23]})) == []
