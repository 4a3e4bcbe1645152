import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlens.llm import quality_model, toxicity, training
from pactlens.llm.text_stats import STOP_WORDS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows_are_never_learnt_from(larger):
    docs, labels = larger
    rows = training.training_rows(docs, labels, "toxic").collect()
    assert rows and not any(held(r["doc_id"]) for r in rows)
    assert training.training_rows(docs, labels, "toxic", rows=50).count() == 50


def test_training_rows_are_bounded_after_the_join(spark):
    """An id that many documents carry gives one row."""
    docs = spark.createDataFrame([(k % 10, f"text {k}") for k in range(1000)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, toxic int")
    rows = training.training_rows(docs, labels, "toxic", rows=5).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 5
    assert sorted(rows) == sorted(training.training_rows(docs.repartition(7), labels, "toxic", rows=5).collect())


def agreement(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert rows and all(held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    return np.mean([r["predicted"] == r[label] for r in rows]), rows


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    scored = toxicity.score_toxicity(docs, labels)
    share, rows = agreement(scored, labels, "toxic")
    assert share > 0.9
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(clean) < 0.05
    assert scored.count() == docs.count() and scored.filter(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).count() == 0


def test_labels_alone_dont_enter_a_score(larger):
    """Flipping the held-out labels changes nothing."""
    docs, labels = larger
    flipped = labels.withColumn("toxic", F.when(training.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_of_odd_rows(odd, empty, larger):
    model = toxicity.train(*larger)
    kept = toxicity.with_scores(odd, model, "s")
    assert kept.columns == [*odd.columns, "s"]
    insult, null, blank = (kept.filter(c).first()["s"] for c in ("doc_id = 10", "doc_id = 1", "doc_id = 2"))
    assert insult > 0.3 > null == blank
    assert toxicity.drop_toxic(empty, larger[1]).count() == 0
    none = toxicity.score_toxicity(odd, larger[1].limit(0)).collect()
    assert len(none) == odd.count() and all(r["score"] == 0 for r in none)


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    good, copy = (truth & (rng.random(4000) < 0.7)), None
    copy = good.copy()
    noise = rng.random(4000) < 0.3
    labels = (truth ^ (rng.random(4000) < 0.1)).astype(int)
    posterior, accuracy, groups = toxicity.label_model(np.stack([good, copy, noise], axis=1), labels)
    assert ((posterior > 0.5) == truth).mean() > (labels == truth).mean()
    assert accuracy[0] > accuracy[2] and groups[:3].tolist() == [2, 2, 1]


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    scored = quality_model.score_quality(docs, labels)
    share, _ = agreement(scored, labels, "quality")
    assert share > 0.95 and scored.count() == docs.count()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_sparse_conjunctions(larger):
    model = quality_model.train(*larger)
    assert 0 < len(model.rules) < 40 and all(1 <= len(r) <= quality_model.DEPTH for r in model.rules)
    assert model == quality_model.train(*larger)


def test_compiled_rules_equal_rules_one_by_one(odd, larger):
    """The column against plain Python: statistics counted anew, conditions tested one after another, weights summed."""
    docs, labels = larger
    model = quality_model.train(docs, labels)
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    scored = quality_model.with_statistics(both, "text").select("doc_id", "text", model.score(quality_model._stat).alias("s"))
    space = " \t\n\x0b\x0c\r"

    def statistics(text):
        words = re.findall(rf"[^{space}]+", text)
        lines = [x for x in text.split("\n") if x.strip(space)]
        counts = {
            "n_words": len(words), "n_chars": len(text), "word_chars": sum(map(len, words)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_distinct": len(set(words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_exclaim": sum(c in "!?" for c in text),
            "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text),
            "n_stop": sum(re.sub("[A-Z]", lambda m: m[0].lower(), w) in STOP_WORDS for w in words),
        }
        return {"n_words": float(len(words))} | {k: counts[a] / counts[b] if counts[b] else 0.0 for k, (a, b) in quality_model.SHARES.items()}

    rows = scored.collect()
    assert len({round(r["s"], 6) for r in rows}) > 5
    for r in rows:
        have, total = statistics(r["text"] or ""), model.constant
        for rule, weight in zip(model.rules, model.weights, strict=True):
            if all(have[c.statistic] <= c.limit if c.at_most else have[c.statistic] > c.limit for c in rule):
                total += weight
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_toxicity_scores_counted_anew(odd, larger):
    """The scores against word lists counted one by one and a sum over votes and rates."""
    docs, labels = larger
    model = toxicity.train(docs, labels)
    assert model.entries and len(model.weights) == 2 * len(model.limits) + 1
    texts = [r["text"] or "" for r in odd.collect() + docs.limit(150).collect()]
    for text, got in zip(texts, model.scores(texts), strict=True):
        words = re.findall(r"[^\W\d_]+", text.lower())
        per = 1 / max(len(words), 1)
        rates = [sum(w.startswith(e[:-1]) if e.endswith("*") else w == e for w in words) * per for e in model.entries]
        rates.append(sum(w in toxicity.SEEDS for w in words) * per)
        rates += [sum(c in p for c in text) * per for p in toxicity.PATTERNS.values()]
        shares = [r / limit for r, limit in zip(rates, model.limits, strict=True)]
        total = model.weights[-1] + sum(w * (s >= 1) for w, s in zip(model.weights, shares, strict=False))
        total += sum(w * min(s, 2.0) for w, s in zip(model.weights[len(shares) :], shares, strict=False))
        assert got == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def test_label_model_against_plain_loops():
    """Expectation-maximisation written out for each row and voter."""
    rng = random.Random(11)
    votes = [[rng.random() < (0.6 if k % 3 == 0 else 0.1) for _ in range(3)] for k in range(60)]
    votes = [[a, a if rng.random() < 0.95 else not a, c] for a, _, c in votes]
    labels = [int((k % 3 == 0) ^ (rng.random() < 0.1)) for k in range(60)]
    rows = [[float(x) for x in v] + [float(y)] for v, y in zip(votes, labels, strict=True)]
    p, groups = [0.9 * y + 0.05 for y in labels], [1] * 4
    for _ in range(5):
        w1, w0 = sum(p) + 2, sum(1 - x for x in p) + 2
        on1 = [(sum(x * r[j] for x, r in zip(p, rows, strict=True)) + 1) / w1 for j in range(4)]
        on0 = [(sum((1 - x) * r[j] for x, r in zip(p, rows, strict=True)) + 1) / w0 for j in range(4)]
        cov = [[sum(x * (r[i] - on1[i]) * (r[j] - on1[j]) for x, r in zip(p, rows, strict=True)) / max(sum(p), 1) for j in range(4)] for i in range(4)]
        sd = [math.sqrt(max(cov[j][j], 1e-9)) for j in range(4)]
        groups = [max(1, sum(cov[i][j] / (sd[i] * sd[j]) > 0.5 for j in range(4))) for i in range(4)]
        p = [
            1 / (1 + math.exp(-max(-30, min(30, math.log(w1 / w0) + sum(
                (r[j] * math.log(on1[j] / on0[j]) + (1 - r[j]) * math.log((1 - on1[j]) / (1 - on0[j]))) / groups[j] for j in range(4))))))
            for r in rows
        ]
    got, _, got_groups = toxicity.label_model(np.array(votes), np.array(labels), rounds=5)
    assert got.tolist() == pytest.approx(p) and got_groups.tolist() == groups


def test_quality_of_odd_rows(odd, empty, larger):
    rows = quality_model.score_quality(odd, larger[1]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.score_quality(empty, larger[1]).count() == 0
    assert {r["score"] for r in quality_model.score_quality(odd, larger[1].limit(0)).collect()} == {0.5}


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == before.columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_and_empty_tables(spark, odd, empty, sf_dir, stage):
    assert stage(spark, empty, sf_dir).count() == 0
    out = stage(spark, odd, sf_dir)
    assert 0 < out.count() <= 2 * odd.count()
