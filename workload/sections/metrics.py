"""Evaluation, fairness, feedback and catalogue queries (G1-G16, G20-G23, H4) and their SQL."""

from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.functions import confidence as CF
from pactlens.functions import validation as V
from pactlens.functions.text import round_half_up
from pactlens.operators import catalog as OG
from pactlens.operators import clauses as OC
from pactlens.operators import documents as OD
from pactlens.operators import evaluation as OE
from pactlens.operators import fairness as OF
from pactlens.operators import feedback as OB
from pactlens.operators.privacy import audit_privacy
from pactlens.plans import evaluate as E
from workload import derived as W
from workload.sections.clauses import LINES, FIRST, clause_lines
from workload.sql import lst, mapped, msg, q, rnd, rule_confidence, rules, scale, statement

QUERIES, ORACLE = {}, {}


def rounded(df, *columns, digits=6):
    return df.select(*[round_half_up(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- evaluation

GRID = f"(SELECT t.l AS true_label, p.l AS predicted_label FROM (SELECT unnest({lst(C.LABELS)}) AS l) t, (SELECT unnest({lst(C.LABELS)}) AS l) p)"
MATRIX = f"""(SELECT g.true_label, g.predicted_label, count(x.true_label) AS n FROM {GRID} g LEFT JOIN predictions x
    ON x.true_label = g.true_label AND x.predicted_label = g.predicted_label GROUP BY 1, 2)"""
PER_CLASS = f"""(SELECT label, tp / nullif(pred, 0)::DOUBLE AS p, tp / nullif(support, 0)::DOUBLE AS r, 2 * tp / nullif(support + pred, 0)::DOUBLE AS f, tp, support, pred
    FROM (SELECT l AS label, count(*) FILTER (true_label = l AND predicted_label = l) AS tp, count(*) FILTER (true_label = l) AS support,
                 count(*) FILTER (predicted_label = l) AS pred FROM predictions, (SELECT unnest({lst(C.LABELS)}) AS l) GROUP BY 1))"""


def confusion_matrix(spark, sf_dir):
    return OE.confusion_matrix(W.predictions(spark, sf_dir))


QUERIES["confusion_matrix"] = confusion_matrix
ORACLE["confusion_matrix"] = statement(f"SELECT * FROM {MATRIX}", "predictions")


def per_class_metrics(spark, sf_dir):
    return rounded(OE.per_class_metrics(W.predictions(spark, sf_dir)), "precision", "recall", "f1_score")


QUERIES["per_class_metrics"] = per_class_metrics
ORACLE["per_class_metrics"] = statement(
    f"""SELECT label, {rnd('coalesce(p, 0)', 6)} AS precision, {rnd('coalesce(r, 0)', 6)} AS recall, {rnd('coalesce(f, 0)', 6)} AS f1_score, support
        FROM {PER_CLASS}""", "predictions")

OVERALL = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


def overall_metrics(spark, sf_dir):
    return rounded(OE.overall_metrics(W.predictions(spark, sf_dir)), *OVERALL)


QUERIES["overall_metrics"] = overall_metrics
ORACLE["overall_metrics"] = statement(
    f"""SELECT {rnd('sum(tp) / sum(support)::DOUBLE', 6)} AS accuracy, {rnd('avg(coalesce(p, 0))', 6)} AS macro_precision,
        {rnd('avg(coalesce(r, 0))', 6)} AS macro_recall, {rnd('avg(coalesce(f, 0))', 6)} AS macro_f1,
        {rnd('sum(coalesce(p, 0) * support) / sum(support)', 6)} AS weighted_precision, {rnd('sum(coalesce(r, 0) * support) / sum(support)', 6)} AS weighted_recall,
        {rnd('sum(coalesce(f, 0) * support) / sum(support)', 6)} AS weighted_f1, sum(support)::BIGINT AS total_samples
        FROM {PER_CLASS} WHERE support + pred > 0""", "predictions")


def toxic_predictions(spark, sf_dir):
    """Two-class predictions from the quality labels, grouped by document language."""
    labels = W.read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = W.read(spark, sf_dir, "documents", "doc_id", "lang")
    names = [F.when(F.col(c) == 1, "positive").otherwise("negative") for c in ("quality", "toxic")]
    return labels.join(docs, "doc_id").select(F.col("lang").alias("contract_type"), names[0].alias("true_label"), names[1].alias("predicted_label"))


TOXIC = """toxic AS (SELECT lang AS contract_type, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS true_label,
    CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS predicted_label FROM labels JOIN documents USING (doc_id))"""


def low_f1_classes(spark, sf_dir):
    return OE.low_f1_classes(OE.per_class_metrics(W.predictions(spark, sf_dir)))


_LOW = msg(D.MSG_LOW_F1, "label", "printf('%.3f', floor(coalesce(f, 0) * 1000 + 0.5) / 1000)")
QUERIES["low_f1_classes"] = low_f1_classes
ORACLE["low_f1_classes"] = statement(
    f"""SELECT 'warning' AS type, label AS class_name, {_LOW} AS message FROM {PER_CLASS} WHERE coalesce(f, 0) < 0.85
        UNION ALL SELECT 'success', NULL, {q(D.MSG_F1_OK)} WHERE NOT EXISTS (SELECT 1 FROM {PER_CLASS} WHERE coalesce(f, 0) < 0.85)""", "predictions")


def matrix_intensity(spark, sf_dir):
    return rounded(OE.matrix_intensity(OE.confusion_matrix(W.predictions(spark, sf_dir))), "intensity")


QUERIES["matrix_intensity"] = matrix_intensity
ORACLE["matrix_intensity"] = statement(
    f"""SELECT true_label, predicted_label, n, {rnd('i', 6)} AS intensity,
        CASE WHEN i = 0 THEN 0 WHEN i < 0.2 THEN 1 WHEN i < 0.4 THEN 2 WHEN i < 0.6 THEN 3 WHEN i < 0.8 THEN 4 ELSE 5 END AS band
        FROM (SELECT *, n / (max(n) OVER ())::DOUBLE AS i FROM {MATRIX})""", "predictions")


def metric_band(spark, sf_dir):
    m = OE.per_class_metrics(W.predictions(spark, sf_dir))
    return m.select("label", V.metric_band(F.col("f1_score")).alias("band"), V.audit_band(F.col("f1_score")).alias("audit_band"))


QUERIES["metric_band"] = metric_band
ORACLE["metric_band"] = statement(
    f"""SELECT label, CASE WHEN f >= 0.9 THEN 'excellent' WHEN f >= 0.8 THEN 'good' WHEN f >= 0.7 THEN 'fair' ELSE 'poor' END AS band,
        CASE WHEN f >= 0.95 THEN 'excellent' WHEN f >= 0.9 THEN 'good' WHEN f >= 0.85 THEN 'fair' ELSE 'poor' END AS audit_band
        FROM {PER_CLASS}""", "predictions")

# ---- fairness


def _group_sql(source):
    return f"""SELECT grp, is_overall, sum(tp) / sum(support)::DOUBLE AS accuracy, sum(coalesce(tp / nullif(pred, 0)::DOUBLE, 0) * support) / sum(support) AS precision,
            sum(coalesce(tp / nullif(support, 0)::DOUBLE, 0) * support) / sum(support) AS recall,
            sum(coalesce(2 * tp / nullif(support + pred, 0)::DOUBLE, 0) * support) / sum(support) AS f1_score, sum(support)::BIGINT AS sample_size
        FROM (SELECT grp, is_overall, label, sum(hit) AS tp, sum(t) AS support, sum(p) AS pred FROM (
            SELECT grp, is_overall, true_label AS label, (true_label = predicted_label)::INT AS hit, 1 AS t, 0 AS p FROM both_levels
            UNION ALL SELECT grp, is_overall, predicted_label, 0, 0, 1 FROM both_levels) GROUP BY ALL) GROUP BY ALL"""


def _levels(source):
    return f"""both_levels AS (SELECT contract_type AS grp, 0 AS is_overall, true_label, predicted_label FROM {source} WHERE contract_type IS NOT NULL
        UNION ALL SELECT NULL, 1, true_label, predicted_label FROM {source})"""


METRICS = f"metrics AS ({_group_sql('both_levels')})"
_TITLE = {"accuracy": "Accuracy", "f1_score": "F1_Score", "precision": "Precision", "recall": "Recall"}
ISSUES = f"""issues AS (SELECT 'performance_disparity' AS type, metric, CASE WHEN gap > 0.2 THEN 'high' ELSE 'medium' END AS severity, gap AS disparity,
        best AS best_performing, worst AS worst_performing, hi AS best_score, lo AS worst_score, worst_n AS worst_sample_size,
        {mapped('metric', _TITLE, 'metric')} || ' disparity of ' || printf('%.3f', gap) || ' between ' || best || ' and ' || worst || ' contracts' AS description
    FROM (SELECT metric, max(score) AS hi, min(score) AS lo, max(score) - min(score) AS gap, count(*) AS groups,
                 first(grp ORDER BY score DESC, grp) AS best, first(grp ORDER BY score, grp) AS worst, first(sample_size ORDER BY score, grp) AS worst_n
          FROM (SELECT grp, sample_size, unnest(['accuracy', 'f1_score', 'precision', 'recall']) AS metric,
                       unnest([accuracy, f1_score, precision, recall]) AS score FROM metrics WHERE is_overall = 0) GROUP BY metric)
    WHERE groups >= 2 AND gap > 0.1)"""
_K, _P, _T, _DS, _A = D.REC_DATA
RECS = f"""recs AS (
    SELECT {', '.join(f'{q(v)} AS {n}' for v, n in zip(D.REC_POSITIVE, ['type', 'priority', 'title', 'description', 'action']))} WHERE NOT EXISTS (SELECT 1 FROM issues)
    UNION ALL SELECT {q(D.REC_CRITICAL[0])}, {q(D.REC_CRITICAL[1])}, {q(D.REC_CRITICAL[2])}, {msg(D.REC_CRITICAL[3], 'n')}, {q(D.REC_CRITICAL[4])}
      FROM (SELECT count(*) AS n FROM issues WHERE severity = 'high') WHERE n > 0
    UNION ALL SELECT {q(D.REC_WARNING[0])}, {q(D.REC_WARNING[1])}, {q(D.REC_WARNING[2])}, {msg(D.REC_WARNING[3], 'n')}, {q(D.REC_WARNING[4])}
      FROM (SELECT count(*) AS n FROM issues WHERE severity = 'medium') WHERE n > 0
    UNION ALL SELECT DISTINCT {q(_K)}, {q(_P)}, {msg(_T, 'worst_performing')}, {msg(_DS, 'worst_sample_size', 'worst_performing')}, {msg(_A, 'worst_performing')}
      FROM issues WHERE worst_sample_size < 50)"""


def audit_sql(body, source="predictions", extra=""):
    ctes = f"{extra}{_levels(source)}, {METRICS}, {ISSUES}, {RECS}"
    if source == "predictions":
        return statement(f"SELECT * FROM (WITH {ctes} {body})", "predictions")
    return f"WITH {ctes} {body}"


SCORES = ["accuracy", "precision", "recall", "f1_score"]


def group_metrics(spark, sf_dir):
    m = OF.group_metrics(W.predictions(spark, sf_dir))
    return rounded(m.withColumn("is_overall", F.col("is_overall").cast("int")), *SCORES)


QUERIES["group_metrics"] = group_metrics
ORACLE["group_metrics"] = audit_sql(
    "SELECT grp AS contract_type, is_overall, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in SCORES) + ", sample_size FROM metrics")


def group_metrics_by_language(spark, sf_dir):
    m = OF.group_metrics(toxic_predictions(spark, sf_dir))
    return rounded(m.withColumn("is_overall", F.col("is_overall").cast("int")), *SCORES)


QUERIES["group_metrics_by_language"] = group_metrics_by_language
ORACLE["group_metrics_by_language"] = audit_sql(
    "SELECT grp AS contract_type, is_overall, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in SCORES) + ", sample_size FROM metrics", "toxic", TOXIC + ", ")
ISSUE_NUMBERS = ["disparity", "best_score", "worst_score"]


def _issues(predictions):
    return OF.bias_issues(OF.group_metrics(predictions))


def bias_issues(spark, sf_dir):
    return rounded(_issues(W.predictions(spark, sf_dir)), *ISSUE_NUMBERS)


_ISSUE_SQL = "SELECT type, metric, severity, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in ISSUE_NUMBERS) + ", best_performing, worst_performing, worst_sample_size, description FROM issues"
QUERIES["bias_issues"] = bias_issues
ORACLE["bias_issues"] = audit_sql(_ISSUE_SQL)


def fairness_recommendations(spark, sf_dir):
    return OF.fairness_recommendations(_issues(W.predictions(spark, sf_dir)))


QUERIES["fairness_recommendations"] = fairness_recommendations
ORACLE["fairness_recommendations"] = audit_sql("SELECT * FROM recs")


def fairness_recommendations_by_language(spark, sf_dir):
    return OF.fairness_recommendations(_issues(toxic_predictions(spark, sf_dir)))


QUERIES["fairness_recommendations_by_language"] = fairness_recommendations_by_language
ORACLE["fairness_recommendations_by_language"] = audit_sql("SELECT * FROM recs", "toxic", TOXIC + ", ")


def audit_summary(spark, sf_dir):
    metrics = OF.group_metrics(W.predictions(spark, sf_dir))
    issues = OF.bias_issues(metrics)
    return OF.audit_summary(metrics, issues, OF.fairness_recommendations(issues))


QUERIES["audit_summary"] = audit_summary
ORACLE["audit_summary"] = audit_sql(
    """SELECT (SELECT count(*) FROM issues) AS total_bias_issues, (SELECT count(*) FROM issues WHERE severity = 'high') AS high_severity_issues,
        (SELECT count(*) FROM issues WHERE severity = 'medium') AS medium_severity_issues, (SELECT count(*) FROM metrics WHERE is_overall = 0) AS contract_types_analyzed,
        (SELECT count(*) FROM recs) AS total_recommendations""")


def issue_distribution(spark, sf_dir):
    return OF.issue_distribution(_issues(W.predictions(spark, sf_dir)))


QUERIES["issue_distribution"] = issue_distribution
ORACLE["issue_distribution"] = audit_sql(
    "SELECT 'severity' AS dim, severity AS value, count(*) AS n FROM issues GROUP BY 2 UNION ALL SELECT 'metric', metric, count(*) FROM issues GROUP BY 2")


# ---- whole reports

def evaluation_report(spark, sf_dir):
    """The record, one row for each class of it."""
    report = E.evaluation_report(W.predictions(spark, sf_dir), evaluated_at="2024-02-01T00:00:00Z")
    rows = report.select("overall", "confusion", "metadata", F.inline("per_class"))
    cells = F.aggregate("confusion", F.lit(0).cast("bigint"), lambda a, c: a + F.when(c["true_label"] == F.col("label"), c["n"]).otherwise(0))
    return rounded(rows.select("label", "precision", "recall", "f1_score", "support", F.col("overall.accuracy").alias("accuracy"),
                               F.col("overall.total_samples").alias("total_samples"), cells.alias("matrix_row"), F.col("metadata.model").alias("model")),
                   "precision", "recall", "f1_score", "accuracy")


QUERIES["evaluation_report"] = evaluation_report
ORACLE["evaluation_report"] = statement(
    f"""SELECT label, {rnd('coalesce(p, 0)', 6)} AS precision, {rnd('coalesce(r, 0)', 6)} AS recall, {rnd('coalesce(f, 0)', 6)} AS f1_score, support,
        {rnd('(SELECT avg((true_label = predicted_label)::INT) FROM predictions)', 6)} AS accuracy, (SELECT count(*) FROM predictions) AS total_samples,
        support AS matrix_row, 'rules' AS model FROM {PER_CLASS}""", "predictions")


def evaluate_rules(spark, sf_dir):
    """The rule classifier on the clauses, whose types are the labels."""
    labelled = OC.clause_rows(W.contracts(spark, sf_dir)).select(F.col("content").alias("text"), F.col("type").alias("label"))
    return rounded(OE.overall_metrics(E.predicted_rows(labelled, CF.classify_rules_13)), *OVERALL)


_RULED = f"(SELECT type AS true_label, {rules('lower(content)', C.EVALUATION_RULES, 'other')} AS predicted_label FROM c_clauses)"
QUERIES["evaluate_rules"] = evaluate_rules
ORACLE["evaluate_rules"] = statement(
    f"""SELECT {rnd('sum(tp) / sum(support)::DOUBLE', 6)} AS accuracy, {rnd('avg(coalesce(p, 0))', 6)} AS macro_precision,
        {rnd('avg(coalesce(r, 0))', 6)} AS macro_recall, {rnd('avg(coalesce(f, 0))', 6)} AS macro_f1,
        {rnd('sum(coalesce(p, 0) * support) / sum(support)', 6)} AS weighted_precision, {rnd('sum(coalesce(r, 0) * support) / sum(support)', 6)} AS weighted_recall,
        {rnd('sum(coalesce(f, 0) * support) / sum(support)', 6)} AS weighted_f1, sum(support)::BIGINT AS total_samples
        FROM (SELECT label, tp, support, pred, tp / nullif(pred, 0)::DOUBLE AS p, tp / nullif(support, 0)::DOUBLE AS r, 2 * tp / nullif(support + pred, 0)::DOUBLE AS f
              FROM (SELECT label, sum(hit) AS tp, sum(t) AS support, sum(g) AS pred FROM (
                  SELECT true_label AS label, (true_label = predicted_label)::INT AS hit, 1 AS t, 0 AS g FROM {_RULED}
                  UNION ALL SELECT predicted_label, 0, 0, 1 FROM {_RULED}) GROUP BY 1))""", "c_clauses")


def fairness_audit(spark, sf_dir):
    """The record's parts side by side."""
    audit = E.fairness_audit(W.predictions(spark, sf_dir))
    return audit.select(
        round_half_up(F.col("overall.accuracy"), 6).alias("accuracy"), F.col("overall.sample_size").alias("sample_size"),
        F.array_join(F.transform("groups", lambda g: g["name"]), ",").alias("group_names"),
        F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["metric"], i["severity"], i["worst_performing"])), ",").alias("found"),
        F.array_join(F.array_sort(F.transform("recommendations", lambda r: r["title"])), ",").alias("titles"), "summary.*")


QUERIES["fairness_audit"] = fairness_audit
ORACLE["fairness_audit"] = audit_sql(
    f"""SELECT {rnd('(SELECT accuracy FROM metrics WHERE is_overall = 1)', 6)} AS accuracy, (SELECT sample_size FROM metrics WHERE is_overall = 1) AS sample_size,
        (SELECT string_agg(grp, ',' ORDER BY grp) FROM metrics WHERE is_overall = 0) AS group_names,
        (SELECT string_agg(metric || ':' || severity || ':' || worst_performing, ',' ORDER BY metric) FROM issues) AS found,
        (SELECT string_agg(title, ',' ORDER BY title) FROM recs) AS titles,
        (SELECT count(*) FROM issues) AS total_bias_issues, (SELECT count(*) FROM issues WHERE severity = 'high') AS high_severity_issues,
        (SELECT count(*) FROM issues WHERE severity = 'medium') AS medium_severity_issues, (SELECT count(*) FROM metrics WHERE is_overall = 0) AS contract_types_analyzed,
        (SELECT count(*) FROM recs) AS total_recommendations""")

# ---- feedback

RANGE = f"timestamp >= TIMESTAMP '{W.FEEDBACK_START}' AND timestamp <= TIMESTAMP '{W.FEEDBACK_END}'"


def feedback_summary(spark, sf_dir):
    summary = OB.feedback_summary(W.feedback(spark, sf_dir), W.FEEDBACK_START, W.FEEDBACK_END)
    for edge in ("range_start", "range_end"):
        summary = summary.withColumn(edge, F.date_format(edge, "yyyy-MM-dd HH:mm:ss"))
    return rounded(summary, "avg_confidence", "prediction_accuracy")


QUERIES["feedback_summary"] = feedback_summary
ORACLE["feedback_summary"] = statement(
    f"""SELECT count(*) AS total_feedback, count(*) FILTER (feedback_type = 'correction') AS corrections,
        {rnd('avg(model_confidence::DECIMAL(18,6))', 6)} AS avg_confidence, count(DISTINCT user_id) + max((user_id IS NULL)::INT) AS unique_users_count,
        {rnd('avg((model_prediction IS NOT DISTINCT FROM user_correction)::INT)', 6)} AS prediction_accuracy,
        '{W.FEEDBACK_START}' AS range_start, '{W.FEEDBACK_END}' AS range_end FROM feedback WHERE {RANGE}""", "feedback")


def feedback_by_clause(spark, sf_dir):
    rows = OB.feedback_by_clause(W.feedback(spark, sf_dir), "payment", 100)
    return rows.select("feedback_id", "clause_id", "model_confidence", "user_correction", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


QUERIES["feedback_by_clause"] = feedback_by_clause
ORACLE["feedback_by_clause"] = statement(
    """SELECT feedback_id, clause_id, model_confidence, user_correction, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM (
        SELECT * FROM feedback WHERE model_prediction = 'payment' ORDER BY timestamp DESC, feedback_id DESC LIMIT 100)""", "feedback")


def dashboard_rollup(spark, sf_dir):
    scores = clause_lines(spark, sf_dir).select(CF.score_prediction(F.col("text")).alias("p")).select("p.*")
    roll = OB.dashboard_rollup(
        audit_privacy(W.contracts_pii(spark, sf_dir)), OF.group_metrics(W.predictions(spark, sf_dir)), W.feedback(spark, sf_dir), scores)
    return rounded(roll, "average_privacy_score", "average_accuracy", "average_feedback_confidence", "improvement_rate", "average_confidence")


QUERIES["dashboard_rollup"] = dashboard_rollup
ORACLE["dashboard_rollup"] = statement(
    f"""SELECT * FROM (WITH {_levels('predictions')}, {METRICS}
        SELECT a.*, b.*, c.*, d.* FROM
        (SELECT sum(n)::BIGINT AS entities_redacted, count(*) AS documents_processed, {rnd('avg(privacy_score::DECIMAL(20,10))', 6)} AS average_privacy_score FROM scores) a,
        (SELECT count(*) AS groups_audited, {rnd('avg(accuracy)', 6)} AS average_accuracy FROM metrics WHERE is_overall = 0) b,
        (SELECT count(*) AS feedback_entries, {rnd('avg(model_confidence::DECIMAL(20,10))', 6)} AS average_feedback_confidence,
                {rnd('avg((model_prediction IS DISTINCT FROM user_correction)::INT)', 6)} AS improvement_rate FROM feedback) c,
        (SELECT count(*) AS documents_scored, {rnd('avg(s::DECIMAL(20,10))', 6)} AS average_confidence, count(*) FILTER (s < 0.7) AS low_confidence_count
         FROM (SELECT {rule_confidence('text', 'label')} AS s FROM (SELECT *, {FIRST} AS label FROM {LINES}))) d)""",
    "scores", "predictions", "feedback")

# ---- registry

REGISTRY_COLUMNS = ["id", "batch_name", "original_name", "mime", "status", "risk_level", "file_size"]
def _stamp():
    return F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded_at")


STAMP_SQL = "strftime(uploaded_at, '%Y-%m-%d') AS uploaded_at"


def list_documents(spark, sf_dir):
    rows = OG.list_documents(W.registry(spark, sf_dir), page=3, limit=20, status="completed", risk_level="high")
    return rows.select(*REGISTRY_COLUMNS, _stamp())


def list_documents_deep(spark, sf_dir):
    """A page far behind: a tenth of all rows lies before it."""
    registry = W.registry(spark, sf_dir)
    page = registry.count() // 200 + 1
    return OG.list_documents(registry, page=page, limit=20, ascending=True, deep=100).select(*REGISTRY_COLUMNS, _stamp())


QUERIES["list_documents_deep"] = list_documents_deep
ORACLE["list_documents_deep"] = statement(
    f"""SELECT {', '.join(REGISTRY_COLUMNS)}, {STAMP_SQL} FROM (SELECT * FROM registry
        ORDER BY uploaded_at, id LIMIT 20 OFFSET (SELECT count(*) // 200 * 20 FROM registry))""", "registry")


def list_documents_after(spark, sf_dir):
    """The page behind the last row of the first one."""
    registry = W.registry(spark, sf_dir)
    last = OG.list_documents(registry, limit=20).agg(F.min_by(F.struct("uploaded_at", "id"), F.struct("uploaded_at", -F.col("id"))).alias("r")).first()["r"]
    return OG.list_documents_after(registry, last["uploaded_at"], last["id"], limit=20).select(*REGISTRY_COLUMNS, _stamp())


QUERIES["list_documents_after"] = list_documents_after
ORACLE["list_documents_after"] = statement(
    f"SELECT {', '.join(REGISTRY_COLUMNS)}, {STAMP_SQL} FROM (SELECT * FROM registry ORDER BY uploaded_at DESC, id LIMIT 20 OFFSET 20)", "registry")


QUERIES["list_documents"] = list_documents
ORACLE["list_documents"] = statement(
    f"""SELECT {', '.join(REGISTRY_COLUMNS)}, {STAMP_SQL} FROM (SELECT * FROM registry WHERE status = 'completed' AND risk_level = 'high'
        ORDER BY uploaded_at DESC, id LIMIT 20 OFFSET 40)""", "registry")


def list_documents_pagination(spark, sf_dir):
    return OG.pagination(W.registry(spark, sf_dir), page=3, limit=20, status="completed", risk_level="high")


QUERIES["list_documents_pagination"] = list_documents_pagination
ORACLE["list_documents_pagination"] = statement(
    """SELECT 3::BIGINT AS current_page, ceil(n / 20.0)::BIGINT AS total_pages, n AS total_documents, 3 < ceil(n / 20.0) AS has_next, true AS has_prev
       FROM (SELECT count(*) AS n FROM registry WHERE status = 'completed' AND risk_level = 'high')""", "registry")


def stats_overview(spark, sf_dir):
    return OG.stats_overview(W.registry(spark, sf_dir))


QUERIES["stats_overview"] = stats_overview
ORACLE["stats_overview"] = statement(
    f"""SELECT total_documents, completed_analyses, high_risk_documents, {rnd('completed_analyses / total_documents::DOUBLE * 100', 1)} AS analysis_rate
        FROM (SELECT count(*) AS total_documents, count(*) FILTER (status = 'completed') AS completed_analyses,
              count(*) FILTER (risk_level = 'high') AS high_risk_documents FROM registry)""", "registry")


def status_risk_distribution(spark, sf_dir):
    return OG.status_risk_distribution(W.registry(spark, sf_dir))


QUERIES["status_risk_distribution"] = status_risk_distribution
ORACLE["status_risk_distribution"] = statement(
    """SELECT 'status' AS dim, status AS value, count(*) AS n FROM registry GROUP BY 2
       UNION ALL SELECT 'risk', risk_level, count(*) FROM registry WHERE risk_level IS NOT NULL GROUP BY 2""", "registry")


def recent_documents(spark, sf_dir):
    return OG.recent_documents(W.registry(spark, sf_dir), 10).select(*REGISTRY_COLUMNS, _stamp())


QUERIES["recent_documents"] = recent_documents
ORACLE["recent_documents"] = statement(
    f"SELECT {', '.join(REGISTRY_COLUMNS)}, {STAMP_SQL} FROM (SELECT * FROM registry ORDER BY uploaded_at DESC, id LIMIT 10)", "registry")


def documents_by_risk(spark, sf_dir):
    return OG.documents_by_risk(W.registry(spark, sf_dir), "high").select(*REGISTRY_COLUMNS, _stamp())


QUERIES["documents_by_risk"] = documents_by_risk
ORACLE["documents_by_risk"] = statement(f"SELECT {', '.join(REGISTRY_COLUMNS)}, {STAMP_SQL} FROM registry WHERE risk_level = 'high'", "registry")


def latest_status(spark, sf_dir):
    return OG.latest_status(W.status_events(spark, sf_dir)).select(
        "doc_id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id")


QUERIES["latest_status"] = latest_status
ORACLE["latest_status"] = statement(
    """SELECT doc_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS rn FROM status_events) WHERE rn = 1""", "status_events")


def display_fields(spark, sf_dir):
    header = OD.batch_header(W.uploads(spark, sf_dir), limit=None)
    risk = W.pick(list(C.CLAUSE_TYPES), F.col("batch_id") % 12)
    names = F.transform("files", lambda f: f["original_name"])
    batch = F.when(F.col("batch_id") % 3 != 0, F.concat(F.lit("Batch "), F.col("batch_id").cast("string")))
    return header.select(
        "batch_id", V.type_display_name(risk).alias("type_name"), V.file_size_display(F.col("file_size")).alias("size_text"),
        V.document_display_name(F.col("mime"), batch, F.col("original_name")).alias("display_name"),
        V.file_type_display(F.col("mime"), F.col("file_count")).alias("file_type"), V.first_files(names).alias("first_files"))


def _size(unit, i):
    return f"regexp_replace((floor(file_size / {float(1024 ** i)} * 100 + 0.5) / 100.0)::VARCHAR, '\\.0$', '') || ' {unit}'"


_ORD = "ord, filename, original_name, size, mime"
QUERIES["display_fields"] = display_fields
ORACLE["display_fields"] = statement(
    f"""SELECT batch_id, array_to_string(list_transform(string_split(({lst(C.CLAUSE_TYPES)})[batch_id % 12 + 1], '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS type_name,
        CASE WHEN file_size = 0 THEN '0 Bytes' WHEN file_size < 1024 THEN {_size('Bytes', 0)} WHEN file_size < 1048576 THEN {_size('KB', 1)}
             WHEN file_size < 1073741824 THEN {_size('MB', 2)} ELSE {_size('GB', 3)} END AS size_text,
        CASE WHEN batch_id % 3 <> 0 THEN 'Batch ' || batch_id::VARCHAR ELSE array_to_string(names, ', ') END AS display_name,
        'Batch (' || len(names)::VARCHAR || ' files)' AS file_type,
        array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' +' || (len(names) - 3)::VARCHAR || ' more' ELSE '' END AS first_files
        FROM (SELECT batch_id, sum(size)::BIGINT AS file_size, list(original_name ORDER BY {_ORD}) AS names FROM uploads GROUP BY 1 )""", "uploads")
