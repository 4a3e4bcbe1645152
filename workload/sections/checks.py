"""Source, validation and gate queries (A2, A5-A8, A11, B1-B8, C20-C22) and their SQL."""

from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import documents as D
from pactlens.functions import cleaning as CL
from pactlens.functions import validation as V
from pactlens.operators import documents as OD
from pactlens.plans import evaluate as E
from pactlens.session import scratch_path
from pactlens.sources.readers import route_files
from pactlens.sources.writers import append_feedback as append_to_log
from pactlens.sources.writers import read_feedback
from workload import derived as W
from workload.sql import mapped, msg, pick, q, replaced, squeeze, statement, strip

QUERIES, ORACLE = {}, {}


ROUTE_SQL = mapped("mime", D.MIME_ROUTES, "'unsupported'")
MIME_OK = "mime IN (" + ", ".join(q(m) for m in D.MIME_ROUTES) + ")"
FILE_ERROR = f"""CASE WHEN NOT {MIME_OK} THEN original_name || ': ' || {q(D.ERR_MIME)}
    WHEN size > {D.MAX_FILE_BYTES} THEN original_name || ': ' || {q(D.ERR_FILE_SIZE)} END"""


def route_by_mime(spark, sf_dir):
    routed = route_files(W.uploads(spark, sf_dir))
    return routed.groupBy("mime", "route", "extraction_error").agg(F.count("*").alias("files"))


QUERIES["route_by_mime"] = route_by_mime
ORACLE["route_by_mime"] = statement(
    f"""SELECT mime, route, CASE WHEN route = 'unsupported' THEN {q(D.ERR_UNSUPPORTED + ': ')} || mime
          WHEN route <> 'txt' THEN 'No decoder for ' || route END AS extraction_error, count(*) AS files
        FROM (SELECT mime, {ROUTE_SQL} AS route FROM uploads) GROUP BY 1, 2, 3""", "uploads")

NAMES = [f"Label Report - {part}.xlsx" for part, _ in C.FILE_NAME_LABELS] + ["Label Report - Warranty.xlsx", "notes.xlsx"]


def annotation_rows(spark, sf_dir):
    docs = W.contracts(spark, sf_dir)
    line = F.explode(F.split("text", "\n", -1)).alias("text")
    return docs.select(W.pick(NAMES, F.col("doc_id") % len(NAMES)).alias("file_name"), line)


ANNOTATION_SQL = f"SELECT {pick(NAMES, f'doc_id % {len(NAMES)}')} AS file_name, unnest(string_split(text, chr(10))) AS text FROM contracts"
LABEL_SQL = "CASE " + " ".join(f"WHEN contains(file_name, {q(p)}) THEN {q(l)}" for p, l in C.FILE_NAME_LABELS) + " ELSE 'other' END"


def label_from_filename(spark, sf_dir):
    rows = annotation_rows(spark, sf_dir)
    return rows.select("file_name", V.label_from_filename(F.col("file_name")).alias("label")).groupBy("file_name", "label").agg(
        F.count("*").alias("n"))


QUERIES["label_from_filename"] = label_from_filename
ORACLE["label_from_filename"] = statement(
    f"SELECT file_name, {LABEL_SQL} AS label, count(*) AS n FROM ({ANNOTATION_SQL}) GROUP BY 1, 2", "contracts")


def labeled_rows_from_files(spark, sf_dir):
    return E.labeled_rows_from_files(annotation_rows(spark, sf_dir))


QUERIES["labeled_rows_from_files"] = labeled_rows_from_files
ORACLE["labeled_rows_from_files"] = statement(
    f"""SELECT t[1:512] AS text, label FROM (SELECT {strip('text')} AS t, {LABEL_SQL} AS label FROM ({ANNOTATION_SQL}))
        WHERE length(t) > 20""", "contracts")


def wide_records(spark, sf_dir):
    """One column per annotation from the lines of each contract: arrays for even columns, strings for odd ones."""
    docs = W.contracts(spark, sf_dir).select("doc_id", "text", F.split("text", "\n", -1).alias("l"))
    columns = []
    for i, (name, _) in enumerate(C.WIDE_COLUMN_LABELS):
        value = F.slice("l", i + 1, 2) if i % 2 == 0 else F.try_element_at("l", F.lit(i + 1))
        columns.append(F.when((F.col("doc_id") + i) % 3 != 0, value).alias(name))
    return docs.select("text", *columns)


def labeled_rows_from_wide(spark, sf_dir):
    return E.labeled_rows_from_wide(wide_records(spark, sf_dir))


_WIDE = " UNION ALL ".join(
    f"SELECT unnest({f'l[{i + 1}:{i + 2}]' if i % 2 == 0 else f'[l[{i + 1}]]'}) AS t, {q(label)} AS label FROM w WHERE (doc_id + {i}) % 3 <> 0 AND length(text) > 50"
    for i, (_, label) in enumerate(C.WIDE_COLUMN_LABELS))
QUERIES["labeled_rows_from_wide"] = labeled_rows_from_wide
ORACLE["labeled_rows_from_wide"] = statement(
    f"""SELECT {strip('t')}[1:512] AS text, label FROM (WITH w AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM contracts) {_WIDE})
        WHERE length({strip('t')}) > 20""", "contracts")


def append_feedback(spark, sf_dir):
    """Sparse events: some fields are missing and take their defaults.  Both batches come twice, as after a failure."""
    fb = W.feedback(spark, sf_dir)
    i = F.col("feedback_id")
    sparse = fb.select(
        "clause_id", F.when(i % 5 != 0, F.col("model_prediction")).alias("model_prediction"),
        F.when(i % 3 != 0, F.col("model_confidence")).alias("model_confidence"),
        F.when(i % 2 != 0, F.col("feedback_type")).alias("feedback_type"), F.col("user_id"), "timestamp", "user_correction")
    path = scratch_path(spark, "feedback-log")
    for missing in (False, True, True, False):
        append_to_log(sparse.filter(F.col("feedback_type").isNull() == missing), path)
    return read_feedback(spark, path).select(
        "clause_id", "original_text", "model_prediction", "model_confidence", "user_correction", "feedback_type", "user_id",
        "session_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.size("additional_metadata").alias("metadata_size"), "is_processed")


QUERIES["append_feedback"] = append_feedback
ORACLE["append_feedback"] = statement(
    """SELECT clause_id, '' AS original_text, CASE WHEN feedback_id % 5 <> 0 THEN coalesce(model_prediction, '') ELSE '' END AS model_prediction,
        CASE WHEN feedback_id % 3 <> 0 THEN model_confidence ELSE 0.0::DOUBLE END AS model_confidence, coalesce(user_correction, '') AS user_correction,
        CASE WHEN feedback_id % 2 <> 0 THEN feedback_type ELSE 'correction' END AS feedback_type, user_id::VARCHAR AS user_id,
        NULL::VARCHAR AS session_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, 0 AS metadata_size, false AS is_processed
        FROM feedback""", "feedback")


def _check(column_of):
    def run(spark, sf_dir):
        files = W.uploads(spark, sf_dir)
        return files.select("batch_id", "ord", "mime", "size", column_of().alias("c")).select(
            "batch_id", "ord", "mime", "size", "c.is_valid", "c.error")
    return run


QUERIES["validate_mime"] = _check(lambda: V.validate_mime(F.col("mime")))
ORACLE["validate_mime"] = statement(
    f"SELECT batch_id, ord, mime, size, {MIME_OK} AS is_valid, CASE WHEN NOT {MIME_OK} THEN {q(D.ERR_MIME)} END AS error FROM uploads", "uploads")
QUERIES["validate_file_size"] = _check(lambda: V.validate_file_size(F.col("size")))
ORACLE["validate_file_size"] = statement(
    f"""SELECT batch_id, ord, mime, size, size <= {D.MAX_FILE_BYTES} AS is_valid,
        CASE WHEN size > {D.MAX_FILE_BYTES} THEN {q(D.ERR_FILE_SIZE)} END AS error FROM uploads""", "uploads")


def validate_batch_size(spark, sf_dir):
    return OD.batch_sizes(W.uploads(spark, sf_dir))


QUERIES["validate_batch_size"] = validate_batch_size
ORACLE["validate_batch_size"] = statement(
    f"""SELECT batch_id, total_size, total_size <= {D.MAX_BATCH_BYTES} AS is_valid,
          CASE WHEN total_size > {D.MAX_BATCH_BYTES} THEN {q(D.ERR_BATCH_SIZE)} END AS error
        FROM (SELECT batch_id, coalesce(sum(size) FILTER ({FILE_ERROR} IS NULL), 0)::BIGINT AS total_size FROM uploads GROUP BY 1)""", "uploads")


def admitted_files(spark, sf_dir):
    return OD.admitted_files(W.uploads(spark, sf_dir)).select("batch_id", "ord", "filename", "size", "mime")


QUERIES["admitted_files"] = admitted_files
ORACLE["admitted_files"] = statement(
    f"""SELECT batch_id, ord, filename, size, mime FROM uploads WHERE {FILE_ERROR} IS NULL AND batch_id IN (
          SELECT batch_id FROM uploads GROUP BY 1 HAVING coalesce(sum(size) FILTER ({FILE_ERROR} IS NULL), 0) <= {D.MAX_BATCH_BYTES})""", "uploads")


def validate_batch_name(spark, sf_dir):
    reg = W.registry(spark, sf_dir)
    i = F.col("id")
    name = (
        F.when(i % 5 == 0, F.concat("batch_name", F.lit(" a/b"))).when(i % 5 == 1, F.repeat("batch_name", 40))
        .when(i % 5 == 2, F.lit("")).otherwise(F.col("batch_name"))
    )
    return reg.select("id", name.alias("name")).select("id", "name", V.validate_batch_name(F.col("name")).alias("c")).select(
        "id", "c.is_valid", "c.error")


QUERIES["validate_batch_name"] = validate_batch_name
ORACLE["validate_batch_name"] = statement(
    f"""SELECT id, error IS NULL AS is_valid, error FROM (SELECT id, CASE WHEN name = '' THEN NULL WHEN length(name) > 255 THEN {q(D.ERR_BATCH_NAME_LENGTH)}
          WHEN regexp_matches(name, {q(D.BATCH_NAME_FORBIDDEN)}) THEN {q(D.ERR_BATCH_NAME_CHARS)} END AS error
        FROM (SELECT id, CASE id % 5 WHEN 0 THEN batch_name || ' a/b' WHEN 1 THEN repeat(batch_name, 40) WHEN 2 THEN '' ELSE batch_name END AS name FROM registry))""",
    "registry")


def partition_valid_files(spark, sf_dir):
    return OD.with_file_errors(W.uploads(spark, sf_dir)).select("batch_id", "ord", "filename", "size", "mime", "error")


QUERIES["partition_valid_files"] = partition_valid_files
ORACLE["partition_valid_files"] = statement(f"SELECT batch_id, ord, filename, size, mime, {FILE_ERROR} AS error FROM uploads", "uploads")


def check_document_constraints(spark, sf_dir):
    reg = W.registry(spark, sf_dir)
    i = F.col("id")
    docs = reg.select(
        F.repeat("batch_name", F.when(i % 9 == 0, 60).otherwise(1)).alias("batch_name"),
        F.when(i % 11 != 0, F.col("original_name")).alias("original_name"), "mime",
        F.when(i % 13 == 0, "archived").otherwise(F.col("status")).alias("status"),
        F.when(i % 17 == 0, "severe").otherwise(F.col("risk_level")).alias("risk_level"),
        (F.col("file_size") * F.when(i % 19 == 0, -1).otherwise(10)).alias("file_size"),
        (i % 12).alias("risk_score"))
    return OD.constraint_violations(docs)


_BAD = [
    ("batch_name.length", "length(repeat(batch_name, CASE WHEN id % 9 = 0 THEN 60 ELSE 1 END)) > 255"),
    ("original_name.required", "id % 11 = 0"),
    ("mime.enum", f"NOT {MIME_OK}"),
    ("status.enum", "id % 13 = 0"),
    ("risk_level.enum", "id % 17 = 0"),
    ("file_size.range", f"id % 19 = 0 AND file_size > 0 OR id % 19 <> 0 AND file_size * 10 > {D.MAX_BATCH_BYTES}"),
    ("risk_score.range", "id % 12 < 1 OR id % 12 > 10"),
]
QUERIES["check_document_constraints"] = check_document_constraints
ORACLE["check_document_constraints"] = statement(
    "SELECT rule, n FROM (" + " UNION ALL ".join(f"SELECT {q(r)} AS rule, count(*) AS n FROM registry WHERE {t}" for r, t in _BAD) + ") WHERE n > 0",
    "registry")


def analysis_gate(spark, sf_dir):
    docs = W.read(spark, sf_dir, "documents", "doc_id", "text")
    i = F.col("doc_id")
    text = (
        F.when(i % 10 == 0, F.lit(" \n\t ")).when(i % 10 == 1, F.substring("text", 1, 40)).when(i % 10 == 3, F.lit("")).otherwise(F.col("text"))
    )
    status = F.when(i % 20 < 3, "processing").otherwise("uploaded")
    return docs.select("doc_id", text.alias("text"), status.alias("status")).select(
        "doc_id", V.analysis_gate(F.col("text"), F.col("status")).alias("error"))


QUERIES["analysis_gate"] = analysis_gate
ORACLE["analysis_gate"] = statement(
    f"""SELECT doc_id, CASE WHEN t = '' THEN {q(D.ERR_NOT_EXTRACTED)} WHEN doc_id % 20 < 3 THEN {q(D.ERR_PROCESSING)}
          WHEN {strip('t')} = '' THEN {q(D.ERR_NO_TEXT)} WHEN length(t) < 50 THEN {q(D.ERR_SHORT_TEXT)} END AS error
        FROM (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN ' ' || chr(10) || chr(9) || ' ' WHEN 1 THEN text[1:40] WHEN 3 THEN '' ELSE text END AS t
              FROM documents)""")


def truncate_text(spark, sf_dir):
    docs = W.contracts(spark, sf_dir)
    return docs.select(
        "doc_id", CL.truncate_text(F.col("text"), D.MODEL_INPUT_CHARS).alias("model_input"),
        CL.truncate_text(F.col("text"), 2000, D.BATCH_MARKER).alias("marked"), CL.truncate_text(F.col("text"), D.PREVIEW_CHARS).alias("preview"))


QUERIES["truncate_text"] = truncate_text
ORACLE["truncate_text"] = statement(
    f"""SELECT doc_id, text[1:512] AS model_input, CASE WHEN length(text) > 2000 THEN text[1:2000] || {q(D.BATCH_MARKER)} ELSE text END AS marked,
        text[1:10000] AS preview FROM contracts""", "contracts")


def merge_batch(spark, sf_dir):
    return OD.merge_batch(W.batch_files(spark, sf_dir))


_PIECE = f"""CASE WHEN error IS NOT NULL THEN {msg(D.SEPARATOR_FAILED, 'original_name')} || {msg(D.PLACEHOLDER_FAILED, 'error')}
    WHEN {strip('text')} = '' THEN {msg(D.SEPARATOR, 'original_name')} || {msg(D.PLACEHOLDER_EMPTY, 'original_name')}
    ELSE {msg(D.SEPARATOR, 'original_name')} || text END"""
MERGED_SQL = """SELECT batch_id, CASE WHEN length(t) > {cap} THEN t[1:{cap}] || {marker} ELSE t END AS text
    FROM (SELECT batch_id, string_agg({piece}, chr(10) || chr(10) ORDER BY ord) AS t FROM {source} GROUP BY 1)"""
QUERIES["merge_batch"] = merge_batch
ORACLE["merge_batch"] = statement(
    MERGED_SQL.format(cap=D.BATCH_TEXT_CHARS, marker=q(D.BATCH_MARKER), piece=_PIECE, source="batch_files"), "batch_files")


def detect_batch_content(spark, sf_dir):
    merged = OD.merge_batch(W.batch_files(spark, sf_dir))
    plain = W.read(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("batch_id"), "text")
    both = merged.withColumn("kind", F.lit("batch")).unionByName(plain.withColumn("kind", F.lit("single")))
    return both.select("kind", "batch_id", CL.detect_batch_content(F.col("text")).alias("is_batch"))


QUERIES["detect_batch_content"] = detect_batch_content
ORACLE["detect_batch_content"] = statement(
    f"""SELECT 'batch' AS kind, batch_id, contains(text, '--- Content from') AS is_batch FROM (
          {MERGED_SQL.format(cap=D.BATCH_TEXT_CHARS, marker=q(D.BATCH_MARKER), piece=_PIECE, source='batch_files')})
        UNION ALL SELECT 'single', doc_id, contains(text, '--- Content from') AND contains(text, '---') FROM documents""", "batch_files")


def batch_header(spark, sf_dir):
    header = OD.batch_header(W.uploads(spark, sf_dir))
    return header.select("batch_id", "filename", "original_name", "file_size", "mime", "status", "file_count", "error")


QUERIES["batch_header"] = batch_header
ORACLE["batch_header"] = statement(
    """SELECT batch_id, CASE WHEN n <= 50 THEN filename END AS filename, CASE WHEN n <= 50 THEN original_name END AS original_name,
        CASE WHEN n <= 50 THEN file_size END AS file_size, 'batch/multiple' AS mime, CASE WHEN n <= 50 THEN 'uploaded' ELSE 'error' END AS status, n AS file_count,
        CASE WHEN n > 50 THEN 'Too many files: ' || n::VARCHAR || ', at most 50 are accepted' END AS error FROM (
        SELECT batch_id, string_agg(filename, ', ' ORDER BY ord, filename, original_name, size, mime) AS filename,
        string_agg(original_name, ', ' ORDER BY ord, filename, original_name, size, mime) AS original_name, sum(size)::BIGINT AS file_size,
        count(*) AS n FROM uploads GROUP BY 1)""", "uploads")
