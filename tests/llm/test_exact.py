import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pactlens.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(LOWER)


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for d, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("pieces", [1, 4])
def test_groups(odd, pieces):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact_dedup.exact_groups(odd, pieces=pieces).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({norm(t) for _, t in rows}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_text_that_holds_most_rows_is_spread(spark):
    rows = [(i, "Copy Of A Text" if i % 3 else f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    assert sum(r["kept"] for r in got) == 201


def test_smallest_id(spark):
    df = spark.createDataFrame([(3, "A"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(df, keep="smallest").collect()} == {(3, 1, False), (1, 1, True), (2, 2, True)}


def test_rows_that_stay_are_whole(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    assert len(rows) == len({norm(r["text"]) for r in odd.collect()})
    assert {tuple(r) for r in rows} <= {tuple(r) for r in odd.collect()}


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def test_plan_is_native_and_moves_texts_once(odd):
    plan = exact_dedup.exact_groups(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(norm" not in plan


def test_normalised_by_ascii_only(spark):
    df = spark.createDataFrame([(1, "É"), (2, "é"), (3, "E"), (4, "e")], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).filter(F.col("kept")).count() == 3
