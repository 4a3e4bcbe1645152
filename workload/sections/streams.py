"""File round trips (A1, A3, A4, A9, A10), model (E18, E19) and stream (H1-H4) queries.

Files and streams are written below the session's shared checkpoint folder.
"""

from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.functions.text import round_half_up
from pactlens.operators import blocks as B
from pactlens.operators import clauses as OC
from pactlens.operators import fairness as OF
from pactlens.operators import learning as ML
from pactlens.operators.rows import spread
from pactlens.plans import evaluate as E
from pactlens.session import materialize, scratch_path
from pactlens.sources import readers as R
from pactlens.sources import schemas as SC
from pactlens.sources import writers as WR
from pactlens.streaming import streams as ST
from workload import derived as W
from workload.sections.cleaning import clean_sql, filtered_sql
from workload.sections.metrics import ISSUE_NUMBERS, _ISSUE_SQL, audit_sql, rounded
from workload.sql import STAGES, q, rnd, span_stages, statement, strip

QUERIES, ORACLE = {}, {}


def read_text_documents(spark, sf_dir):
    """Documents written as one text file each, every ninth one blank, and read back."""
    docs = W.read(spark, sf_dir, "documents", "doc_id", "text")
    path = scratch_path(spark, "texts")
    body = F.when(F.col("doc_id") % 9 == 0, F.lit("  ")).otherwise(F.col("text"))
    dealt = spread(docs, "doc_id", W.TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    WR.write_text_files(dealt.select(body.alias("text")), path)
    return R.read_text_documents(spark, path).select("size", "text", "extraction_error")


QUERIES["read_text_documents"] = read_text_documents
ORACLE["read_text_documents"] = f"""SELECT strlen(t) AS size, CASE WHEN {strip('t')} = '' THEN NULL ELSE t END AS text,
    CASE WHEN {strip('t')} = '' THEN {q(D.ERR_EMPTY_FILE)} END AS extraction_error
    FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END || chr(10) AS t FROM documents)"""


def read_predictions(spark, sf_dir):
    """Predictions written as CSV with the columns in another order, and read back."""
    path = scratch_path(spark, "predictions")
    p = W.predictions(spark, sf_dir)
    text = F.concat(F.lit('Clause "'), F.col("ord").cast("string"), F.lit('", line\nend'))
    p.select("contract_type", "true_label", text.alias("clause_text"), "predicted_label").write.options(header=True, escape='"').csv(path)
    return R.read_predictions(spark, path)


QUERIES["read_predictions"] = read_predictions
ORACLE["read_predictions"] = statement(
    """SELECT 'Clause "' || ord::VARCHAR || '", line' || chr(10) || 'end' AS clause_text, predicted_label, true_label, contract_type FROM predictions""", "predictions")


def read_json_documents(spark, sf_dir):
    """Arrays of up to ten {id, text} items, every eleventh text missing, one array per line."""
    docs = W.read(spark, sf_dir, "documents", "doc_id", "text")
    i = F.col("doc_id")
    item = F.struct(i.alias("k"), F.struct(i.cast("string").alias("id"), F.when(i % 11 != 0, F.col("text")).alias("text")).alias("v"))
    arrays = docs.groupBy(F.floor(i / 10).alias("bundle")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    path = scratch_path(spark, "json")
    arrays.select(F.to_json(F.transform("items", lambda x: x["v"]))).write.text(path)
    return R.read_json_documents(spark, path, whole_file=False).drop("source")


QUERIES["read_json_documents"] = read_json_documents
ORACLE["read_json_documents"] = """SELECT (row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1)::INT AS batch_index, doc_id::VARCHAR AS id,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text FROM documents"""


def write_feedback_csv(spark, sf_dir):
    path = scratch_path(spark, "feedback")
    result = WR.write_feedback_csv(W.feedback(spark, sf_dir).withColumn("meta", F.create_map(F.lit("k"), F.col("clause_id"))), path, W.FEEDBACK_END, days=10)
    assert result["success"], result
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.select("feedback_id", "clause_id", "model_prediction", "user_correction", "feedback_type", "meta")


QUERIES["write_feedback_csv"] = write_feedback_csv
ORACLE["write_feedback_csv"] = statement(
    f"""SELECT feedback_id::VARCHAR AS feedback_id, clause_id, model_prediction, user_correction, feedback_type, '{{"k":"' || clause_id || '"}}' AS meta
        FROM feedback WHERE timestamp >= TIMESTAMP '{W.FEEDBACK_END}' - INTERVAL 10 DAY AND timestamp <= TIMESTAMP '{W.FEEDBACK_END}'""", "feedback")


def write_report_json(spark, sf_dir):
    issues = rounded(OF.bias_issues(OF.group_metrics(W.predictions(spark, sf_dir))), *ISSUE_NUMBERS)
    path = scratch_path(spark, "report")
    WR.write_report_json(issues, path)
    return spark.read.schema(issues.schema).json(path)


QUERIES["write_report_json"] = write_report_json
ORACLE["write_report_json"] = audit_sql(_ISSUE_SQL)


# ---- model

def labelled_clauses(spark, sf_dir):
    rows = OC.clause_rows(W.contracts(spark, sf_dir))
    return rows.select((F.col("doc_id") * 100 + F.col("clause_no")).alias("ord"), F.col("content").alias("text"), F.col("type").alias("label"))


def _parts(spark, sf_dir):
    rows = materialize(labelled_clauses(spark, sf_dir), "labelled")
    return B.ordered_split(rows, "ord", 0.8)


#: The path of the model of a session and table folder; it is trained once a session.
_MODELS: dict[tuple[str, str], str] = {}


def _model(spark, sf_dir, parts=None):
    """The stored model.  A query that needs the labelled clauses itself hands them over, so that they are extracted and written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        rows = _parts(spark, sf_dir) if parts is None else parts
        path = scratch_path(spark, "clause-model")
        ML.save_word_model(ML.train_word_model(rows.filter("part = 'train'")), path)
        _MODELS[key] = path
    return ML.load_word_model(spark, _MODELS[key])


def train_clause_classifier(spark, sf_dir):
    """The stored model: its words and their weights under each label."""
    model = _model(spark, sf_dir)
    labels = F.array(*[F.lit(x) for x in model.labels])
    rows = model.table.select("word", F.posexplode("weights").alias("k", "weight"))
    return rows.select("word", F.get(labels, F.col("k")).alias("label"), round_half_up(F.col("weight"), 6).alias("weight"))


def score_clauses(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    scored = ML.score_words(_model(spark, sf_dir, parts), parts, ["ord"])
    return scored.select("ord", "clause_type", round_half_up(F.col("confidence"), 6).alias("confidence"), F.size("all_scores").alias("labels"))


def evaluate_classifier(spark, sf_dir):
    """The evaluation record of the classifier on the clauses it hasn't seen, one row for each class that they hold."""
    parts = _parts(spark, sf_dir)
    scored = ML.score_words(_model(spark, sf_dir, parts), parts.filter("part = 'eval'"), ["ord"])
    predicted = scored.select(F.col("label").alias("true_label"), F.col("clause_type").alias("predicted_label"))
    report = E.evaluation_report(predicted, labels=list(C.CLAUSE_TYPES), model="words", evaluated_at="2024-02-01T00:00:00Z")
    rows = report.select("overall", "metadata", F.inline("per_class")).filter("support > 0")
    return rows.select(
        "label", *(round_half_up(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1_score")), "support",
        round_half_up(F.col("overall.accuracy"), 6).alias("accuracy"), F.col("metadata.model").alias("model"))


STAGES["w_rows"] = (["c_clauses"], """SELECT ord, text, label, rn <= floor(0.8 * n) AS train FROM (
    SELECT doc_id * 100 + clause_no AS ord, content AS text, type AS label, row_number() OVER (ORDER BY doc_id * 100 + clause_no) AS rn, count(*) OVER () AS n FROM c_clauses)""")
STAGES["w_words"] = (["w_rows"], f"SELECT ord, label, train, lower(unnest(regexp_extract_all(text, '{ML.WORD}'))) AS word FROM w_rows")
STAGES["w_model"] = (["w_rows", "w_words"], """
    WITH labels AS (SELECT label, count(*) AS n FROM w_rows WHERE train GROUP BY label),
    totals AS (SELECT label, count(*) AS n FROM w_words WHERE train GROUP BY label),
    words AS (SELECT DISTINCT word FROM w_words WHERE train),
    counts AS (SELECT label, word, count(*) AS n FROM w_words WHERE train GROUP BY ALL)
    SELECT word, label, ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(t.n, 0) + 1.0::DOUBLE * (SELECT count(*) FROM words))) AS weight
    FROM words CROSS JOIN labels l LEFT JOIN counts c USING (word, label) LEFT JOIN totals t USING (label)
    UNION ALL SELECT NULL, label, ln(n / (SELECT sum(n) FROM labels)::DOUBLE) FROM labels""")
STAGES["w_scored"] = (["w_rows", "w_words", "w_model"], """
    WITH counts AS (SELECT ord, word, count(*) AS n FROM w_words GROUP BY ALL),
    sums AS (SELECT ord, m.label, sum(c.n * m.weight) AS s FROM counts c JOIN w_model m USING (word) GROUP BY ALL),
    logs AS (SELECT r.ord, r.label AS true_label, r.train, p.label, coalesce(s, 0) + p.weight AS l
        FROM w_rows r CROSS JOIN (SELECT * FROM w_model WHERE word IS NULL) p LEFT JOIN sums s ON s.ord = r.ord AND s.label = p.label)
    SELECT ord, any_value(true_label) AS true_label, any_value(train) AS train, first(label ORDER BY l DESC, label) AS clause_type,
        1 / sum(exp(l - top)) AS confidence, count(*)::INT AS labels FROM (SELECT *, max(l) OVER (PARTITION BY ord) AS top FROM logs) GROUP BY ord""")
QUERIES["train_clause_classifier"] = train_clause_classifier
ORACLE["train_clause_classifier"] = statement(f"SELECT word, label, {rnd('weight', 6)} AS weight FROM w_model", "w_model")
QUERIES["score_clauses"] = score_clauses
ORACLE["score_clauses"] = statement(f"SELECT ord, clause_type, {rnd('confidence', 6)} AS confidence, labels FROM w_scored", "w_scored")
QUERIES["evaluate_classifier"] = evaluate_classifier
ORACLE["evaluate_classifier"] = statement(
    f"""SELECT label, {rnd('coalesce(tp / nullif(pred, 0), 0)', 6)} AS precision, {rnd('tp / support', 6)} AS recall,
        {rnd('2 * tp / (support + pred)', 6)} AS f1_score, support::BIGINT AS support,
        {rnd('(SELECT avg((true_label = clause_type)::INT) FROM w_scored WHERE NOT train)', 6)} AS accuracy, 'words' AS model
        FROM (SELECT label, sum(hit)::DOUBLE AS tp, sum(t)::DOUBLE AS support, sum(g)::DOUBLE AS pred FROM (
            SELECT true_label AS label, (true_label = clause_type)::INT AS hit, 1 AS t, 0 AS g FROM w_scored WHERE NOT train
            UNION ALL SELECT clause_type, 0, 0, 1 FROM w_scored WHERE NOT train) GROUP BY 1) WHERE support > 0""", "w_scored")


# ---- streams

def _document_stream(spark, sf_dir):
    """The contracts as a file stream."""
    path = scratch_path(spark, "incoming")
    docs = W.contracts_pii(spark, sf_dir)
    docs.write.parquet(path)
    return spark.readStream.schema(docs.schema).parquet(path)


def stream_clean_and_redact(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "cleaned"), scratch_path(spark, "cp")
    result = ST.clean_and_redact(_document_stream(spark, sf_dir))
    ST.run_available(result, out, checkpoint)
    return spark.read.schema(result.schema).parquet(out)


STAGES["h_clean"] = (["contracts_pii"], f"SELECT doc_id, {clean_sql('cleaned')} AS text FROM ({filtered_sql('contracts_pii')})")
STAGES |= span_stages("h_", "h_clean")
CLEANED_SQL = statement(
    "SELECT doc_id, r.text AS redacted_text, s.n AS entities_redacted FROM h_redacted r JOIN h_scores s USING (doc_id)", "h_redacted", "h_scores")
QUERIES["stream_clean_and_redact"] = stream_clean_and_redact
ORACLE["stream_clean_and_redact"] = CLEANED_SQL


def clean_and_redact(spark, sf_dir):
    return ST.clean_and_redact(W.contracts_pii(spark, sf_dir))


QUERIES["clean_and_redact"] = clean_and_redact
ORACLE["clean_and_redact"] = CLEANED_SQL


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(SC.EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _feedback_stream(spark, sf_dir):
    return W.feedback_of(_event_stream(spark, sf_dir))


def _shown(df):
    return df.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "total_feedback", "corrections", "unique_users",
        round_half_up(F.col("avg_confidence"), 6).alias("avg_confidence"), round_half_up(F.col("prediction_accuracy"), 6).alias("prediction_accuracy"))


def _window_sql(source):
    return f"""SELECT strftime(d, '%Y-%m-%d') AS window_start, count(*) AS total_feedback, count(*) FILTER (feedback_type = 'correction') AS corrections,
        count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS unique_users,
        {rnd('avg(model_confidence::DECIMAL(18,6))', 6)} AS avg_confidence,
        {rnd('avg((model_prediction IS NOT DISTINCT FROM user_correction)::INT)', 6)} AS prediction_accuracy
        FROM {source} GROUP BY d"""


DAYS = "(SELECT *, date_trunc('day', timestamp) AS d FROM feedback)"
MONTHS = "(SELECT *, date_trunc('day', timestamp) - INTERVAL 1 DAY * unnest(range(0, 30)) AS d FROM feedback)"


def feedback_windows(spark, sf_dir):
    return _shown(ST.feedback_windows(W.feedback(spark, sf_dir)))


QUERIES["feedback_windows"] = feedback_windows
ORACLE["feedback_windows"] = statement(_window_sql(DAYS), "feedback")


def feedback_windows_sliding(spark, sf_dir):
    return _shown(ST.feedback_windows(W.feedback(spark, sf_dir), "30 days", "1 day"))


QUERIES["feedback_windows_sliding"] = feedback_windows_sliding
ORACLE["feedback_windows_sliding"] = statement(_window_sql(MONTHS), "feedback")


def _stream_windows(spark, sf_dir, **frame):
    """Each window as the watermark closes it; an event far behind the last one closes them all."""
    source, out, checkpoint = scratch_path(spark, "events"), scratch_path(spark, "windows"), scratch_path(spark, "cp")
    feedback = W.feedback(spark, sf_dir)
    feedback.unionByName(ST.closing_event(feedback, "90 days")).write.parquet(source)
    result = ST.feedback_windows(spark.readStream.schema(feedback.schema).parquet(source), **frame)
    ST.run_available(result, out, checkpoint)
    return _shown(spark.read.schema(result.schema).parquet(out))


def stream_feedback_windows(spark, sf_dir):
    return _stream_windows(spark, sf_dir)


QUERIES["stream_feedback_windows"] = stream_feedback_windows
ORACLE["stream_feedback_windows"] = statement(_window_sql(DAYS), "feedback")


def stream_feedback_windows_sliding(spark, sf_dir):
    return _stream_windows(spark, sf_dir, width="30 days", slide="1 day")


QUERIES["stream_feedback_windows_sliding"] = stream_feedback_windows_sliding
ORACLE["stream_feedback_windows_sliding"] = statement(_window_sql(MONTHS), "feedback")


def stream_review_queue(spark, sf_dir):
    """Doubtful feedback clauses, each once, from a stream that delivers every event twice."""
    out, checkpoint = scratch_path(spark, "queue"), scratch_path(spark, "cp")
    fb = _feedback_stream(spark, sf_dir)
    rows = fb.select(
        F.col("feedback_id").alias("clause_id"), F.col("timestamp").alias("ts"), "model_prediction",
        (F.col("model_confidence") < 0.1).alias("requires_review"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    result = ST.review_stream(twice)
    ST.run_available(result, out, checkpoint)
    return spark.read.schema(result.schema).parquet(out).select("clause_id", "model_prediction")


QUERIES["stream_review_queue"] = stream_review_queue
ORACLE["stream_review_queue"] = statement("SELECT feedback_id AS clause_id, model_prediction FROM feedback WHERE model_confidence < 0.1", "feedback")


def stream_latest_status(spark, sf_dir):
    ev = _event_stream(spark, sf_dir)
    status = F.lit("processing")
    for event, name in {"view": "uploaded", "click": "extracting", "error": "error", "purchase": "completed"}.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    events = ev.select(F.col("user_id").alias("doc_id"), F.expr("cast(ts as timestamp)").alias("ts"), "event_id", status.alias("status"))
    out, checkpoint = scratch_path(spark, "status"), scratch_path(spark, "cp")
    ST.maintain_status(events, out, checkpoint)
    return ST.current_status(spark, out).select("doc_id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id")


QUERIES["stream_latest_status"] = stream_latest_status
ORACLE["stream_latest_status"] = statement(
    """SELECT doc_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn FROM status_events) WHERE rn = 1""", "status_events")
