"""Group operators on small tables, hot keys, sources, sinks and streams."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pactlens.fixed import documents as D
from pactlens.functions import risk as RF
from pactlens.functions import validation as V
from pactlens.operators import blocks as B
from pactlens.operators import catalog as OG
from pactlens.operators import documents as OD
from pactlens.operators import evaluation as OE
from pactlens.operators import fairness as OF
from pactlens.operators import feedback as OB
from pactlens.operators import learning as ML
from pactlens.operators.privacy import audit_privacy, entity_distribution, privacy_stats
from pactlens.plans.analyze import analyze_documents, extract_file_text
from pactlens.session import scratch_path
from pactlens.sources import commits
from pactlens.sources import readers as R
from pactlens.sources import writers as W
from pactlens.streaming import streams as ST


def preds(spark, rows):
    return spark.createDataFrame(rows, "true_label string, predicted_label string, contract_type string")


def test_evaluation_by_hand(spark):
    df = preds(spark, [("payment", "payment", "a")] * 3 + [("payment", "other", "a"), ("duration", "payment", "b"), ("strange", "strange", "b")])
    matrix = {(r["true_label"], r["predicted_label"]): r["n"] for r in OE.confusion_matrix(df).collect()}
    assert len(matrix) == 169 and sum(matrix.values()) == 5 and matrix[("payment", "payment")] == 3
    per = {r["label"]: r for r in OE.per_class_metrics(df).collect()}
    assert len(per) == 13
    assert (per["payment"]["precision"], per["payment"]["recall"], per["payment"]["f1_score"], per["payment"]["support"]) == (0.75, 0.75, 0.75, 4)
    assert per["assignment"]["f1_score"] == 0.0
    overall = OE.overall_metrics(df).first()
    assert overall["total_samples"] == 6 and abs(overall["accuracy"] - 4 / 6) < 1e-12
    # labels seen: payment, other, duration, strange
    assert abs(overall["macro_precision"] - (0.75 + 0 + 0 + 1) / 4) < 1e-12


def test_low_f1_success_row(spark):
    perfect = preds(spark, [("payment", "payment", "a")])
    rows = OE.low_f1_classes(OE.per_class_metrics(perfect, ["payment"])).collect()
    assert [(r["type"], r["message"]) for r in rows] == [("success", D.MSG_F1_OK)]


def test_fairness_positive_and_data_rows(spark):
    same = preds(spark, [("payment", "payment", g) for g in ("a", "b") for _ in range(5)])
    metrics = OF.group_metrics(same)
    assert {r["contract_type"]: r["accuracy"] for r in metrics.collect()} == {"a": 1.0, "b": 1.0, None: 1.0}
    assert OF.bias_issues(metrics).count() == 0
    assert [r["type"] for r in OF.fairness_recommendations(OF.bias_issues(metrics)).collect()] == ["positive"]
    worse = preds(spark, [("payment", "payment", "a")] * 20 + [("payment", "other", "b")] * 3 + [("payment", "payment", "b")] * 17)
    issues = OF.bias_issues(OF.group_metrics(worse))
    found = {r["metric"]: (r["severity"], r["best_performing"], r["worst_performing"]) for r in issues.collect()}
    assert found["accuracy"] == ("medium", "a", "b")
    kinds = sorted(r["type"] for r in OF.fairness_recommendations(issues).collect())
    assert kinds == ["data", "warning"]
    single = preds(spark, [("payment", "other", "a")])
    assert OF.bias_issues(OF.group_metrics(single)).count() == 0


def test_feedback_summary_empty_and_missing_user(spark):
    schema = "timestamp timestamp, feedback_type string, model_confidence double, user_id long, model_prediction string, user_correction string"
    empty = OB.feedback_summary(spark.createDataFrame([], schema), "2024-01-01", "2024-01-02").first()
    assert {k: v for k, v in empty.asDict().items() if not k.startswith("range")} == {"total_feedback": 0, "corrections": 0, "avg_confidence": 0.0, "unique_users_count": 0, "prediction_accuracy": 0.0}
    rows = [("2024-01-01 10:00:00", "correction", 0.5, 1, "a", "a"), ("2024-01-01 11:00:00", "other", 0.7, None, "a", "b"),
            ("2024-01-01 12:00:00", "correction", 0.9, None, "a", "b"), ("2024-02-01 12:00:00", "correction", 0.9, 9, "a", "b")]
    df = spark.createDataFrame(rows, schema.replace("timestamp timestamp", "timestamp string")).withColumn("timestamp", F.to_timestamp("timestamp"))
    got = OB.feedback_summary(df, "2024-01-01", "2024-01-02").first()
    assert (got["total_feedback"], got["corrections"], got["unique_users_count"]) == (3, 2, 2)
    assert abs(got["avg_confidence"] - 0.7) < 1e-9 and abs(got["prediction_accuracy"] - 1 / 3) < 1e-9


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_total_with_a_hot_key(spark, block):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(50)) for i in range(600)] + [(f"k{i % 40}", i, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["before"] for r in B.running_total(df, ["k"], "o", "v", "before", block).collect()}
    total = {}
    for k, o, v in sorted(rows):
        assert got[(k, o)] == total.get(k, 0)
        total[k] = total.get(k, 0) + v


@pytest.mark.parametrize("n,block,gap", [(1, 10, 1), (5, 2, 1), (1003, 100, 1), (1003, 100, 10**12)])
def test_ordered_split_is_exact(spark, n, block, gap):
    orders = [v * gap for v in random.Random(n).sample(range(-5 * n, 20 * n), n)]
    df = spark.createDataFrame([(o,) for o in orders], "o long")
    train = sorted(r["o"] for r in B.ordered_split(df, "o", 0.8, block).filter("part = 'train'").collect())
    assert train == sorted(orders)[: int(0.8 * n)]


def test_a_bracket_stays_narrow_whatever_the_values(spark):
    """One value far away, values in heaps, and values in the millions: the stretch that is ranked holds about a block."""
    block = 1000
    df = spark.range(1, 100_001).select(F.when(F.col("id") == 100_000, F.lit(10**15)).otherwise(F.col("id") + F.floor(F.col("id") / 50_000) * 10**9).alias("v"))
    for rank in (1, 2, 50_000, 80_000, 99_999, 100_000):
        found = B.bracket(df, rank, block, accuracy=1000)
        assert found.inside <= 2 * block and found.before < rank <= found.before + found.inside
        inside = B.within(df, "v", found)
        assert inside.count() == found.inside
        assert sorted(r["v"] for r in inside.collect())[rank - found.before - 1] == sorted(r["v"] for r in df.collect())[rank - 1]
    assert B.bracket(df, 0) is None and B.bracket(df, 100_001) is None
    same = spark.range(5000).select(F.lit(7).alias("v"))
    assert B.bracket(same, 2500, 10).inside == 5000  # equal values stay together


@pytest.mark.parametrize("ascending", [True, False])
def test_deep_pages_equal_shallow_ones(spark, ascending):
    rng = random.Random(8)
    rows = [(k, None if k % 9 == 0 else rng.choice([rng.randrange(50), rng.randrange(10**9)]), "t", "s", "r") for k in range(700)]
    df = spark.createDataFrame(rows, "id long, size long, text string, status string, risk_level string").repartition(4)
    for page in (1, 3, 8, 9, 60, 63, 64, 69, 70, 71):
        plain = OG.list_documents(df, page, 10, sort_by="size", ascending=ascending, deep=10**9).collect()
        assert OG.list_documents(df, page, 10, sort_by="size", ascending=ascending, deep=20).collect() == plain
        if plain and page < 60 and plain[-1]["size"] is not None:
            after = OG.list_documents_after(df, plain[-1]["size"], plain[-1]["id"], 10, sort_by="size", ascending=ascending).collect()
            want = [r for r in OG.list_documents(df, page + 1, 10, sort_by="size", ascending=ascending).collect() if r["size"] is not None]
            assert after[: len(want)] == want


def brute_merge(files, cap):
    text = ""
    for _, name, body, error in sorted(files):
        text += "\n\n" if text else ""
        if error is not None:
            text += f"--- Content from {name} (extraction failed) ---\n\n[Text extraction failed: {error}]"
        else:
            text += f"--- Content from {name} ---\n\n" + (body if body.strip() else f"[No readable text content found in {name}]")
    return text if len(text) <= cap else text[:cap] + D.BATCH_MARKER


@pytest.mark.parametrize("cap", [120, 121, 122, 123, 2000, 10**6])
def test_merge_batch_against_brute_force(spark, cap):
    rng = random.Random(5)
    rows = []
    for batch, n in (("hot", 300), ("one", 1), ("few", 4)):
        for i in range(n):
            rows.append((batch, i, f"f{i}.txt", rng.choice(["text " * rng.randrange(1, 30), " ", "x"]), rng.choice([None, None, "bad"])))
    df = spark.createDataFrame(rows, "batch_id string, ord long, original_name string, text string, error string")
    got = {r["batch_id"]: r["text"] for r in OD.merge_batch(df, cap, block=16).collect()}
    for batch in ("hot", "one", "few"):
        assert got[batch] == brute_merge([r[1:] for r in rows if r[0] == batch], cap)


def test_uploads_above_the_file_limit_are_refused(spark):
    rows = [("big", i, f"s{i}", f"n{i}", 1, "text/plain") for i in range(51)] + [("ok", i, f"s{i}", f"n{i}", 1, "text/plain") for i in range(50)]
    df = spark.createDataFrame(rows, "batch_id string, ord long, filename string, original_name string, size long, mime string")
    header = OD.batch_header(df).collect()
    assert {(r["batch_id"], r["file_count"], r["file_size"], r["status"]) for r in header} == {("ok", 50, 50, "uploaded"), ("big", 51, None, "error")}
    assert {r["error"] for r in header} == {None, "Too many files: 51, at most 50 are accepted"}
    assert {(r["batch_id"], r["file_size"]) for r in OD.batch_header(df, limit=None).collect()} == {("ok", 50), ("big", 51)}


def test_only_valid_files_count_for_the_batch_size(spark):
    mib = 1024 * 1024
    rows = [("a", 1, "s", "n", 49 * mib, "text/plain")] + [("b", i, "s", "n", 50 * mib, "text/plain") for i in range(5)]
    rows += [("a", 2, "s", "n", 51 * mib, "text/plain"), ("a", 3, "s", "n", 1, "application/zip"), ("a", 4, "s", "n", 1, None)]
    df = spark.createDataFrame(rows, "batch_id string, ord long, filename string, original_name string, size long, mime string")
    sizes = {r["batch_id"]: (r["total_size"], r["is_valid"]) for r in OD.batch_sizes(df).collect()}
    assert sizes == {"a": (49 * mib, True), "b": (250 * mib, False)}
    assert {r["batch_id"] for r in OD.admitted_files(df).collect()} == {"a"}
    errors = {r["ord"]: r["error"] for r in OD.file_errors(df).collect()}
    assert errors == {2: f"n: {D.ERR_FILE_SIZE}", 3: f"n: {D.ERR_MIME}", 4: f"n: {D.ERR_MIME}"}


def test_display_and_routes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 1024 ** 3,), (1234567,)], "n long")
    assert [r[0] for r in df.select(V.file_size_display(F.col("n"))).collect()] == ["0 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "5 GB", "1.18 MB"]
    one = spark.range(1)
    assert one.select(V.type_display_name(F.lit("ip_Rights_x"))).first()[0] == "Ip Rights X"
    assert one.select(V.extraction_route(F.lit("x/y"), F.lit("A.DOC"))).first()[0] == "docx"
    assert one.select(V.extraction_route(F.lit("x/y"), F.lit("doc"))).first()[0] == "unsupported"
    names = one.select(V.first_files(F.array(*[F.lit(x) for x in "abcde"]))).first()[0]
    assert names == "a, b, c +2 more"


def test_constraints_report(spark):
    df = spark.createDataFrame([("x.txt", 5, "text/plain", "odd")], "original_name string, file_size long, mime string, status string")
    assert [(r["rule"], r["n"]) for r in OD.constraint_violations(df).collect()] == [("status.enum", 1)]
    clause = {"type": F.lit("x"), "suggestion": F.repeat(F.lit("a"), F.lit(501)), "risk_level": F.lit("LOW"), "risk_score": F.lit(11)}
    assert spark.range(1).select(V.clause_violations(clause)).first()[0] == ["type.enum", "risk_score.range", "suggestion.length"]
    arrays = spark.range(1).select(F.array(F.lit("payment"), F.lit("assignment")).alias("missing_clauses"), F.array(F.lit("x" * 51)).alias("tags"),
                                   F.lit("b").alias("filename"), F.lit("b").alias("original_name"))
    assert {r["rule"] for r in OD.constraint_violations(arrays).collect()} == {"missing_clauses.enum", "tags.length"}


def test_listing_pages(spark):
    rows = [(i, f"2024-01-{1 + i % 5:02d}", "completed", "text") for i in range(23)]
    df = spark.createDataFrame(rows, "id long, uploaded_at string, status string, text string").withColumn("risk_level", F.lit("low"))
    page = OG.list_documents(df, page=2, limit=10)
    assert "text" not in page.columns
    expected = [r[0] for r in sorted(rows, key=lambda r: (-int(r[1][-2:]), r[0]))][10:20]
    assert [r["id"] for r in page.collect()] == expected
    info = OG.pagination(df, page=3, limit=10).first()
    assert (info["total_pages"], info["has_next"], info["has_prev"]) == (3, False, True)


def test_gate_and_errors_become_rows(spark):
    docs = spark.createDataFrame([(1, "  "), (2, "too short"), (3, None), (4, "The term of this lease is one year and the rent is due monthly.")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in analyze_documents(docs).collect()}
    assert [rows[i]["error"] for i in (1, 2, 3, 4)] == [D.ERR_NO_TEXT, D.ERR_SHORT_TEXT, D.ERR_NO_TEXT, None]
    assert rows[1]["status"] == "error" and rows[1]["overall_risk_score"] is None and rows[1]["summary"] is None
    assert rows[4]["status"] == "completed" and len(rows[4]["clauses"]) == 1
    clause = rows[4]["clauses"][0]
    assert {"risk_score", "triggers", "advice", "explanation"} <= set(clause.asDict())
    plain = {r["doc_id"]: r for r in analyze_documents(docs, redact=False).collect()}
    assert plain[4]["overall_risk_score"] == rows[4]["overall_risk_score"]
    assert [r["error"] for r in extract_file_text(docs.filter("doc_id = 1")).collect()] == ["No text could be extracted from the document"]


def test_redaction_happens_before_extraction(spark):
    docs = spark.createDataFrame([(1, "The tenant pays rent by card 4111-1111-1111-1111 every month to a@b.org on time.")], "doc_id long, text string")
    row = analyze_documents(docs).first()
    assert row["entities_redacted"] == 2 and "[CREDIT_CARD]" in row["clauses"][0]["content"] and "4111" not in str(row)


def test_privacy_stats_on_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    stats = privacy_stats(audit_privacy(docs)).first()
    assert (stats["total_documents_processed"], stats["total_entities_redacted"], stats["avg_redaction_percentage"]) == (0, 0, 0.0)
    timed = audit_privacy(docs.union(spark.createDataFrame([(1, "a@b.org")], docs.schema))).withColumn("processing_time", F.lit(2.0))
    assert privacy_stats(timed).first()["max_processing_time"] == 2.0
    assert [(r["label"], r["n"]) for r in entity_distribution(timed).collect()] == [("EMAIL", 1)]


def test_prediction_reader_checks_columns(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([("x", "y")], "clause_text string, true_label string").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="predicted_label"):
        R.read_predictions(spark, path)


def test_json_array_file(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"id": "a", "text": "x"}, {"id": "b"}, {"id": "c", "text": None}], indent=1))
    rows = R.read_json_documents(spark, str(tmp_path / "in.json")).collect()
    assert [(r["batch_index"], r["id"], r["text"]) for r in rows] == [(0, "a", "x"), (1, "b", ""), (2, "c", "")]


def test_text_files_blank_and_too_large(spark, tmp_path):
    for name, text in (("a.txt", "some text"), ("b.txt", " \n"), ("c.txt", "x" * 50), ("d.pdf", "no")):
        (tmp_path / name).write_text(text)
    rows = {r["name"]: r for r in R.read_text_documents(spark, str(tmp_path), max_bytes=40).collect()}
    assert set(rows) == {"a.txt", "b.txt", "c.txt"} and rows["a.txt"]["text"] == "some text" and rows["a.txt"]["size"] == 9
    assert [rows[n]["extraction_error"] for n in ("a.txt", "b.txt", "c.txt")] == [None, D.ERR_EMPTY_FILE, D.ERR_FILE_SIZE]


def test_annotation_reader(spark, tmp_path):
    (tmp_path / "Label Report - Insurance.csv").write_text('text,other\n"A long enough text, quoted here",1\nshort,2\n')
    from pactlens.plans.evaluate import labeled_rows_from_files

    rows = labeled_rows_from_files(R.read_annotations(spark, str(tmp_path))).collect()
    assert [(r["text"], r["label"]) for r in rows] == [("A long enough text, quoted here", "insurance")]


@pytest.mark.parametrize("camel", [False, True])
def test_handbook_file(spark, tmp_path, camel):
    names = ["targetedQuestion", "expertGuidance"] if camel else ["targeted_question", "expert_guidance"]
    entry = {names[0]: "Q?", names[1]: "Do this."}
    level = {"urgencyPrefix": "NOW: ", "actionIntensifier": "!"} if camel else {"urgency_prefix": "NOW: ", "action_intensifier": "!"}
    inner = {("clauseTypePrompts" if camel else "clause_type_prompts"): {"payment": entry, "default": {names[1]: "Else."}},
             ("riskLevelModifiers" if camel else "risk_level_modifiers"): {"medium": level}}
    (tmp_path / "book.json").write_text(json.dumps({"promptHandbook" if camel else "prompt_handbook": inner}))
    book = R.read_handbook(str(tmp_path / "book.json"))
    df = spark.createDataFrame([("payment",), ("venue",)], "t string")
    out = df.select(RF.handbook_suggestions(F.lit("x"), F.col("t"), F.lit("HIGH"), F.lit("low"), F.lit(False), book)["suggestion"]).collect()
    assert [r[0] for r in out] == ["NOW: Do this.", "NOW: Else."]
    with pytest.raises(ValueError):
        RF.Handbook({"payment": {}})


def test_configuration_files(spark, tmp_path):
    from pactlens.functions.confidence import confidence_level
    from pactlens.functions.privacy import detect_pii_configured

    (tmp_path / "p.json").write_text(json.dumps({"regex_patterns": {"badge": {"pattern": r"\bB-[0-9]+\b", "replacement": "[BADGE]"}}}))
    patterns = R.read_privacy_config(str(tmp_path / "p.json"))
    one = spark.createDataFrame([("see b-17 and xB-1",)], "t string")
    spans = one.select(detect_pii_configured(F.col("t"), patterns).alias("s")).first()["s"]
    assert [(s["text"], s["label"], s["replacement"]) for s in spans] == [("b-17", "BADGE", "[BADGE]")]
    (tmp_path / "a.json").write_text(json.dumps({
        "confidence_thresholds": {"high_confidence": 0.8, "medium_confidence": 0.6, "low_confidence": 0.4}, "clause_types": ["x", "y"]}))
    thresholds, labels = R.read_accountability_config(str(tmp_path / "a.json"))
    assert labels == ["x", "y"] and spark.range(1).select(confidence_level(F.lit(0.8), thresholds)).first()[0] == "HIGH"
    (tmp_path / "f.json").write_text(json.dumps({
        "bias_thresholds": {"performance_disparity": 0.01, "high_severity_threshold": 0.02}, "metrics_to_calculate": ["recall"]}))
    df = preds(spark, [("a", "a", "g")] * 9 + [("a", "b", "g")] + [("a", "a", "h")])
    issues = OF.bias_issues(OF.group_metrics(df), **R.read_fairness_config(str(tmp_path / "f.json"))).collect()
    assert [(r["metric"], r["severity"]) for r in issues] == [("recall", "high")]


def test_writers(spark):
    rows = [("c1", "2024-01-10 00:00:00"), ("c2", "2024-03-10 00:00:00")]
    fb = spark.createDataFrame(rows, "clause_id string, ts string").select("clause_id", F.to_timestamp("ts").alias("timestamp"))
    assert W.write_feedback_csv(fb, scratch_path(spark, "csv"), "2020-01-01") == {"success": False, "error": "No feedback data found"}
    done = W.write_feedback_csv(fb, scratch_path(spark, "csv"), "2024-01-20", days=30)
    assert done["records_exported"] == 1
    with pytest.raises(ValueError, match="json"):
        W.write_analysis_export(fb, scratch_path(spark, "x"), fmt="pdf")
    path = scratch_path(spark, "log")
    W.append_feedback(fb, path)
    W.append_feedback(fb.limit(1), path)
    log = W.read_feedback(spark, path)
    assert log.count() == 3 and log.select("feedback_id").distinct().count() == 2
    assert log.first()["feedback_type"] == "correction" and log.first()["is_processed"] is False


def test_export_file_has_one_record_per_document(spark):
    path = scratch_path(spark, "export")
    docs = spark.createDataFrame([(4, "The term of this lease is one year and the rent is due monthly.")], "doc_id long, text string")
    W.write_analysis_export(analyze_documents(docs), path)
    record = json.loads(spark.read.text(path).first()[0])
    assert record["document"] == {"doc_id": 4} and record["analysis"]["status"] == "completed" and record["exportedAt"]


def test_streams_equal_batch(spark):
    docs = spark.createDataFrame([(i, f"The lease number {i} goes to user{i}@mail.example.com, phone 555-123-4567.") for i in range(20)], "doc_id long, text string")
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    docs.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ST.run_available(ST.clean_and_redact(stream), out, scratch_path(spark, "cp"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, ST.clean_and_redact(docs).collect()))


def test_status_stream_over_many_batches(spark):
    rows = [(i % 7, f"2024-01-01 00:{i:02d}:00", i, f"s{i}") for i in range(50)]
    events = spark.createDataFrame(rows, "doc_id long, ts string, event_id long, status string").withColumn("ts", F.to_timestamp("ts"))
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    events.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ST.maintain_status(stream, out, scratch_path(spark, "cp"))
    assert sorted(map(tuple, ST.current_status(spark, out).collect())) == sorted(map(tuple, OG.latest_status(events).collect()))


@pytest.mark.parametrize("slide", [None, "1 day"])
def test_stream_windows_equal_batch(spark, slide):
    """Windows come out once each, closed by the watermark, with exact users; nothing is rewritten."""
    rows = [(f"2024-01-{1 + i % 9:02d} 10:00:00", "correction", 0.5, i % 400, "a", "a") for i in range(900)] + [("2024-01-02 11:00:00", "other", None, None, None, None)]
    fb = spark.createDataFrame(rows, "timestamp string, feedback_type string, model_confidence double, user_id long, model_prediction string, user_correction string")
    fb = fb.withColumn("timestamp", F.to_timestamp("timestamp"))
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    fb.repartition(4).write.parquet(source)
    width = "3 days" if slide else "1 day"
    stream = spark.readStream.schema(fb.schema).parquet(source)
    result, checkpoint = ST.feedback_windows(stream, width, slide, late="30 days"), scratch_path(spark, "cp")
    ST.run_available(result, out, checkpoint)
    assert spark.read.schema(result.schema).parquet(out).count() == 0  # all windows are still open
    ST.closing_event(fb, "60 days").write.mode("append").parquet(source)
    ST.run_available(result, out, checkpoint)
    got = spark.read.schema(result.schema).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ST.feedback_windows(fb, width, slide).collect()))
    assert got.agg(F.max("unique_users")).first()[0] >= 100


def test_status_table_is_compacted(spark, tmp_path):
    rows = [(i % 40, i, f"s{i}") for i in range(600)]
    events = spark.createDataFrame(rows, "doc_id long, event_id long, status string").withColumn("ts", F.timestamp_seconds("event_id"))
    table = ST.StatusTable(spark, str(tmp_path / "t"))
    batches = [events.filter(f"event_id >= {k * 50} AND event_id < {k * 50 + 50} AND doc_id < {40 if k < 2 else 5}") for k in range(12)]
    seen = events.limit(0)
    for k, batch in enumerate(batches):
        table.apply(batch, k)
        table.apply(events.filter("event_id = 599"), k)  # a batch that comes again changes nothing
        seen = seen.unionByName(batch)
        assert len([n for n in commits.children(spark, table.snapshots.path) if n != commits.POINTERS]) <= 4
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, OG.latest_status(seen).collect()))
    table.snapshots.clean()
    folders = [n for n in commits.children(spark, table.snapshots.path) if n != commits.POINTERS]
    assert len(folders) == len(table.snapshots.current().parts) <= 2
    again = ST.StatusTable(spark, str(tmp_path / "t"))  # a new process
    assert sorted(map(tuple, again.read().collect())) == sorted(map(tuple, table.read().collect()))


def test_feedback_batches_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    fb = spark.createDataFrame([(f"c{k % 7}",) for k in range(50)], "clause_id string")
    assert W.append_feedback(fb, path) and not W.append_feedback(fb.repartition(7), path)
    assert W.append_feedback(fb, path, batch="again") and not W.append_feedback(fb, path, batch="again")
    assert W.read_feedback(spark, path).count() == 100
    # what a dead job has left, without a mark of success, is written anew
    (tmp_path / "log" / "batch_id=again" / "_SUCCESS").unlink()
    assert W.append_feedback(fb.limit(3), path, batch="again")
    assert W.read_feedback(spark, path).count() == 53


def test_publishing_shows_a_file_once(spark, tmp_path):
    path = str(tmp_path / "p" / "x.json")
    assert commits.publish(spark, path, '{"a": "é"}') and not commits.publish(spark, path, "other")
    assert commits.read_small(spark, path) == '{"a": "é"}' and commits.children(spark, str(tmp_path / "p")) == ["x.json"]
    assert commits.children(spark, str(tmp_path / "none")) == [] and commits.Snapshots(spark, str(tmp_path / "none")).read() is None


def test_sliding_windows_in_one_and_two_steps(spark):
    rows = [(f"2024-01-{1 + i % 9:02d} 10:00:00", "correction", i / 100, i % 5, "a", "ab"[i % 2]) for i in range(90)]
    rows.append(("2024-01-03 09:00:00", "other", None, None, "a", None))
    fb = spark.createDataFrame(rows, "timestamp string, feedback_type string, model_confidence double, user_id long, model_prediction string, user_correction string")
    fb = fb.withColumn("timestamp", F.to_timestamp("timestamp"))
    two = sorted(map(tuple, ST.feedback_windows(fb, "4 days", "1 day").collect()))
    assert two == sorted(map(tuple, ST.feedback_windows(fb, "4 days", "1 day", two_step=False).collect()))
    assert len(two) == 12 and max(r[5] for r in two) == 6  # five and the missing one


def direct_word_model(train):
    labels = sorted({label for _, label in train})
    counts = {x: Counter(w.lower() for t, label in train if label == x for w in re.findall("[A-Za-z0-9]{2,}", t)) for x in labels}
    words = {w for c in counts.values() for w in c}
    logs = {w: [math.log((counts[x][w] + 1) / (sum(counts[x].values()) + len(words))) for x in labels] for w in words}
    return labels, logs, [math.log(sum(label == x for _, label in train) / len(train)) for x in labels]


def test_word_model_is_stored_and_scores(spark, tmp_path):
    rng = random.Random(6)
    words = {"rent": "tenant rent landlord pays monthly".split(), "nda": "secret confidential disclose information".split(), "other": "Über é 12 x y and".split()}
    rows = [(k, " ".join(rng.choice(words[label] + ["the", "of"]) for _ in range(rng.randrange(12))), label) for k, label in enumerate(rng.choices(list(words), k=300))]
    rows += [(1000, None, "nda"), (1001, "", "rent"), (1002, "tenant", None)]
    df = spark.createDataFrame(rows, "k long, text string, label string").repartition(4)
    path = str(tmp_path / "model")
    assert ML.save_word_model(ML.train_word_model(df.filter("k < 50")), path) == 1
    assert ML.save_word_model(ML.train_word_model(df), path) == 2
    model = ML.load_word_model(spark, path)
    labels, logs, priors = direct_word_model([(t or "", label) for _, t, label in rows if label])
    assert list(model.labels) == labels
    table = {r["word"]: r["weights"] for r in model.table.collect()}
    assert table.pop(None) == pytest.approx(priors) and table.keys() == logs.keys()
    assert all(table[w] == pytest.approx(logs[w]) for w in logs)
    for r in ML.score_words(model, df, ["k"]).collect():
        known = [w.lower() for w in re.findall("[A-Za-z0-9]{2,}", r["text"] or "") if w.lower() in logs]
        score = [p + sum(logs[w][i] for w in known) for i, p in enumerate(priors)]
        share = [math.exp(x - max(score)) for x in score]
        assert r["clause_type"] == labels[score.index(max(score))] and r["confidence"] == pytest.approx(max(share) / sum(share))
        assert sum(r["all_scores"].values()) == pytest.approx(1.0)
    with pytest.raises(FileNotFoundError):
        ML.load_word_model(spark, str(tmp_path / "none"))


def test_documents_without_noise_have_a_record(spark):
    df = spark.createDataFrame([(1, "Rent is due."), (2, ""), (3, "PAGE 1 OF 2"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["noise_chars"], r["noise_percentage"], r["pattern"]) for r in OD.analyze_noise(df).collect() if r["doc_id"] != 3}
    assert got == {1: (0, 0.0, None), 2: (0, None, None), 4: (0, None, None)}


def test_classifier_beats_the_commonest_label(spark):
    rng = random.Random(1)
    words = {"payment": ["rent", "fee", "invoice"], "duration": ["term", "years", "months"], "other": ["garden", "weather"]}
    rows = [(" ".join(rng.choices(words[k], k=4) + rng.choices(["the", "and", "of"], k=4)), k) for k in words for _ in range(60)]
    df = spark.createDataFrame(rows, "text string, label string")
    scored = ML.score_clauses(ML.train_clause_classifier(df, features=256, max_iter=10), df.select("text", "label"))
    hits = scored.agg(F.avg((F.col("label") == F.col("clause_type")).cast("int")), F.min("confidence"), F.max(F.size("all_scores"))).first()
    assert hits[0] > 0.95 and hits[1] > 1 / 3 and hits[2] == 3
    labels = spark.createDataFrame([("other",), ("zzz",)], "l string").select(ML.encode_label(F.col("l")).alias("i"))
    assert [tuple(r) for r in labels.select("i", ML.decode_label(F.col("i"))).collect()] == [(10, "other"), (None, None)]


def test_ungrouped_rows_count_overall_only(spark):
    rows = [("a", "a", "g"), ("a", "b", None)]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string, contract_type string")
    got = {(r["contract_type"], r["is_overall"]): (r["sample_size"], r["accuracy"]) for r in OF.group_metrics(df).collect()}
    assert got == {("g", 0): (1, 1.0), (None, 1): (2, 0.5)}


def test_predictions_with_another_header_fail(spark, tmp_path):
    names = ["clause_text", "predicted_label", "true_label", "contract_type"]
    for i, order in enumerate((names, [names[0], names[2], names[1], names[3]])):
        (tmp_path / f"part{i}.csv").write_text(",".join(order) + "\n" + ",".join(f"{c} {i}" for c in order) + "\n")
    assert R.read_predictions(spark, str(tmp_path / "part1.csv")).first()["true_label"] == "true_label 1"
    with pytest.raises(Exception, match="header|Header|CSV"):
        R.read_predictions(spark, str(tmp_path)).collect()


def test_feedback_ids_cover_all_fields(spark, tmp_path):
    rows = [("c", {"a": "1"}), ("c", {"a": "2"}), ("c", {"b": "1", "a": "1"}), ("c", {"a": "1", "b": "1"})]
    df = spark.createDataFrame(rows, "clause_id string, additional_metadata map<string,string>")
    W.append_feedback(df, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(back) == 4 and len({r["feedback_id"] for r in back}) == 3


def test_missing_labels_agree_only_with_missing_labels(spark):
    ts = "2024-01-10 00:00:00"
    rows = [(None, "x", None), ("x", "x", 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "model_prediction string, user_correction string, user_id long").withColumns(
        {"timestamp": F.lit(ts).cast("timestamp"), "feedback_type": F.lit("correction"), "model_confidence": F.lit(0.5)})
    summary = OB.feedback_summary(df, "2024-01-01", "2024-02-01").first()
    window = ST.feedback_windows(df).first()
    assert round(summary["prediction_accuracy"], 6) == round(window["prediction_accuracy"], 6) == 0.666667
    assert summary["unique_users_count"] == window["unique_users"] == 3


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from pactlens.session import scratch_path as path_of

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        path_of(fake, "x")


def test_text_files_are_written_by_many_tasks_and_read_once(spark, tmp_path, monkeypatch):
    """The files of one row group are spread over tasks, without checksum files; files of the right size make no tasks of the scan for refused ones."""
    from workload.sections import streams

    rows = [(i, None if i == 5 else f"text {i}") for i in [*range(60), None, 3, 3]]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: str(tmp_path / name))
    got = streams.read_text_documents(spark, str(tmp_path))
    names = [p.name for p in (tmp_path / "texts").iterdir()]
    assert len({n.split("-")[1] for n in names if n.startswith("part-")}) > 8 and not any(n.endswith(".crc") for n in names)
    assert got.rdd.getNumPartitions() == spark.read.format("binaryFile").load(str(tmp_path / "texts")).rdd.getNumPartitions()
    texts = ["  " if i is not None and i % 9 == 0 else t or "" for i, t in rows]
    assert sorted((r["size"], r["text"] or "", r["extraction_error"] or "") for r in got.collect()) == sorted(
        (len(t) + 1, t + "\n" if t.strip() else "", "" if t.strip() else D.ERR_EMPTY_FILE) for t in texts)


def test_labelled_clauses_are_extracted_once_a_query(spark, tmp_path, monkeypatch):
    """Training and scoring of one query share the labelled clauses."""
    from workload.sections import streams

    spark.createDataFrame([(i, f"plain text {i}.") for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made, write = [], streams.materialize
    monkeypatch.setattr(streams, "materialize", lambda df, name: (made.append(name), write(df, name))[1])
    assert streams.score_clauses(spark, str(tmp_path)).count() > 0 and made == ["labelled"]


def test_documents_of_few_splits_are_dealt(spark, tmp_path):
    """A table of some more splits than cores takes a second round of tasks: it is dealt over several tasks a core, with the same rows."""
    from workload import derived

    cores = spark.sparkContext.defaultParallelism
    rows = [(k % 50 if k % 9 else None, None if k % 7 == 3 else f"text {k}") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(cores + 4).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert cores <= spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions() < 2 * cores
        docs = derived.documents(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() == derived.TASKS_PER_CORE * cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(rows, key=str)


def test_text_files_are_written_without_a_process_each(spark, tmp_path):
    """Texts become files as Spark's text writer makes them; on a disk no process is started for each, and a level holds few folders."""
    from pathlib import Path

    texts = [None, "", " ", "a\nb\r\n", "\u00e9\U0001f600", "x" * 200_000, *(f"text {k}" for k in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3 * W.FOLDERS)
    started = lambda: int(re.search(r"processes (\d+)", Path("/proc/stat").read_text())[1])
    df.mapInArrow(lambda batches: batches, "text string").count()  # workers are up
    before = started()
    W.write_text_files(df, str(tmp_path / "texts"))
    assert started() - before < len(texts)
    files = [p for p in (tmp_path / "texts").rglob("*") if p.is_file()]
    assert sorted(p.read_bytes() for p in files) == sorted((t or "").encode() + b"\n" for t in texts)
    assert all(p.suffix == ".txt" for p in files) and not list((tmp_path / "texts").glob("_*"))
    assert len(list((tmp_path / "texts").iterdir())) <= W.FOLDERS
    assert sorted(r["size"] for r in R.read_text_documents(spark, str(tmp_path / "texts")).collect()) == sorted(len((t or "").encode()) + 1 for t in texts)
    with pytest.raises(FileExistsError):
        W.write_text_files(df, str(tmp_path / "texts"))
    W.write_text_files(df.filter("false"), str(tmp_path / "none"))
    assert R.read_text_documents(spark, str(tmp_path / "none")).count() == 0


def test_a_repeated_task_writes_its_text_files_once(spark, tmp_path, monkeypatch):
    """A task whose files are there already leaves them, and an attempt that fails leaves nothing."""
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    late = df.select(F.when(F.col("text") == "b", F.raise_error(F.lit("late"))).otherwise(F.col("text")).alias("text"))
    with pytest.raises(Exception, match="late"):
        W.write_text_files(late, str(tmp_path / "failed"))
    assert list((tmp_path / "failed").iterdir()) == []
    done = tmp_path / "again" / "part-set=0" / "task=0"
    done.mkdir(parents=True)
    (done / "0.txt").write_text("first")
    monkeypatch.setattr(W, "disk_folder", lambda spark, path: path)
    W.write_text_files(df, str(tmp_path / "again"))
    assert [p.name for p in (tmp_path / "again").iterdir()] == ["part-set=0"] and [p.read_text() for p in done.iterdir()] == ["first"]
    monkeypatch.setattr(W, "disk_folder", lambda spark, path: None)  # as in another store
    W.write_text_files(df, str(tmp_path / "other"))
    assert sorted(p.read_text() for p in (tmp_path / "other").glob("*.txt")) == ["a\n", "b\n"]


def test_many_text_files_are_read_by_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    """Each small file costs a scan so much that few make a task; tasks of very many files are joined, with the same rows."""
    for k in range(1, 60):
        (tmp_path / f"{k}.txt").write_text(" " if k == 1 else "x" * k)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert R.read_text_documents(spark, str(tmp_path)).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
        monkeypatch.setattr(R, "FILE_TASKS_PER_CORE", 2)
        few = R.read_text_documents(spark, str(tmp_path), max_bytes=50)
        assert few.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
        rows = [(r["size"], r["extraction_error"]) for r in few.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == [(k, D.ERR_FILE_SIZE if k > 50 else D.ERR_EMPTY_FILE if k == 1 else None) for k in range(1, 60)]
