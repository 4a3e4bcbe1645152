"""Clause extraction, classification and confidence queries (E1-E17) and their SQL."""

from pyspark.sql import functions as F

from pactlens.fixed import clauses as C
from pactlens.fixed import risk as R
from pactlens.functions import confidence as CF
from pactlens.operators import blocks as B
from pactlens.operators import clauses as OC
from pactlens.operators import learning as ML
from pactlens.operators import phrases as OP
from workload import derived as W
from workload.sql import any_word, count_words, lst, q, rnd, rule_confidence, rules, scale, statement

QUERIES, ORACLE = {}, {}



def clause_candidates(spark, sf_dir):
    rows = OC.candidate_rows(W.contracts(spark, sf_dir))
    return rows.select("doc_id", F.col("ord").alias("keyword_no"), "type", "keyword", F.col("at").alias("match_start"), F.col("hit").alias("match"))


QUERIES["clause_candidates"] = clause_candidates
ORACLE["clause_candidates"] = statement(
    "SELECT doc_id, ord AS keyword_no, type, keyword, pos AS match_start, hit AS match FROM c_candidates", "c_candidates")


def clause_context(spark, sf_dir):
    rows = OC.candidate_rows(W.contracts(spark, sf_dir)).filter(F.length("content") > C.MIN_CLAUSE_CHARS)
    return rows.select("doc_id", F.col("ord").alias("keyword_no"), F.col("at").alias("match_start"), "start", "end", "content")


QUERIES["clause_context"] = clause_context
ORACLE["clause_context"] = statement(
    'SELECT doc_id, ord AS keyword_no, pos AS match_start, start, "end", content FROM c_candidates WHERE length(content) > 30', "c_candidates")


def dedupe_clauses(spark, sf_dir):
    rows = OC.deduped_rows(W.contracts(spark, sf_dir))
    return rows.select("doc_id", "type", "keyword", F.col("at").alias("match_start"), "start", "end")


QUERIES["dedupe_clauses"] = dedupe_clauses
ORACLE["dedupe_clauses"] = statement('SELECT doc_id, type, keyword, pos AS match_start, start, "end" FROM c_kept', "c_kept")


def top_clauses(spark, sf_dir):
    return OC.clause_rows(W.contracts(spark, sf_dir))


QUERIES["top_clauses"] = top_clauses
ORACLE["top_clauses"] = statement("SELECT * FROM c_clauses", "c_clauses")


def clause_lines(spark, sf_dir):
    """Every line of every contract: short and long texts of all kinds."""
    docs = W.contracts(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.select("doc_id", (F.col("no") + 1).alias("no"), F.col("line").alias("text"))


LINES = "(SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM contracts))"


def _label_query(name, function, sql):
    def run(spark, sf_dir):
        return clause_lines(spark, sf_dir).select("doc_id", "no", function(F.col("text")).alias("label"))

    QUERIES[name] = run
    ORACLE[name] = statement(f"SELECT doc_id, no, {sql} AS label FROM {LINES}", "contracts")


FIRST = rules("lower(text)", C.FIRST_MATCH_RULES, "other")
_label_query("classify_first_match", CF.classify_first_match, FIRST)
_label_query("classify_rules_13", CF.classify_rules_13, rules("lower(text)", C.EVALUATION_RULES, "other"))
_D = {k: count_words("lower(text)", ws) for k, ws in C.DOMINANT_KEYWORDS.items()}
_BEST = "greatest(" + ", ".join(_D.values()) + ")"
_label_query("classify_dominant", CF.classify_dominant,
             f"CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN {v} = {_BEST} THEN {q(k)}" for k, v in _D.items()) + " END")


def legal_term_density(spark, sf_dir):
    return clause_lines(spark, sf_dir).select("doc_id", "no", CF.legal_term_density(F.col("text")).alias("d")).select(
        "doc_id", "no", F.col("d.score").alias("confidence_score"), F.col("d.level").alias("confidence_level"), F.col("d.review").alias("requires_review"))


QUERIES["legal_term_density"] = legal_term_density
ORACLE["legal_term_density"] = statement(
    f"""SELECT doc_id, no, s AS confidence_score, {scale('s', C.DENSITY_SCALE, 'VERY_LOW')} AS confidence_level, s < 0.6 AS requires_review
        FROM (SELECT doc_id, no, least({count_words('lower(text)', C.LEGAL_TERMS)}::DOUBLE / 16.0::DOUBLE, 1.0::DOUBLE) AS s FROM {LINES})""", "contracts")


def rule_confidence_query(spark, sf_dir):
    lines = clause_lines(spark, sf_dir)
    label = W.pick(C.LABELS, (F.col("doc_id") + F.col("no")) % 13)
    return lines.select("doc_id", "no", label.alias("label"), "text").select(
        "doc_id", "no", "label", CF.rule_confidence(F.col("text"), F.col("label")).alias("confidence"))


QUERIES["rule_confidence"] = rule_confidence_query
ORACLE["rule_confidence"] = statement(
    f"""SELECT doc_id, no, label, {rule_confidence('text', 'label')} AS confidence
        FROM (SELECT *, ({lst(C.LABELS)})[(doc_id + no) % 13 + 1] AS label FROM {LINES})""", "contracts")


def softmax_confidence(spark, sf_dir):
    li = W.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    logits = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 30, F.col("l_tax") * 40, F.lit(1.0))
    return li.select("l_orderkey", "l_linenumber", CF.softmax_confidence(logits).alias("confidence"))


QUERIES["softmax_confidence"] = softmax_confidence
ORACLE["softmax_confidence"] = f"""SELECT l_orderkey, l_linenumber, {rnd("1.0::DOUBLE / (exp(a - m) + exp(b - m) + exp(c - m) + exp(1.0::DOUBLE - m))", 3)} AS confidence
    FROM (SELECT *, greatest(a, b, c, 1.0::DOUBLE) AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 30 AS b, l_tax * 40 AS c FROM lineitem))"""


def _level_query(name, column, sql):
    def run(spark, sf_dir):
        return W.feedback(spark, sf_dir).select("feedback_id", F.col("model_confidence").alias("score")).select("feedback_id", "score", *column())

    QUERIES[name] = run
    ORACLE[name] = statement(f"SELECT feedback_id, score, {sql} FROM (SELECT feedback_id, model_confidence AS score FROM feedback)", "feedback")


_level_query("confidence_level",
             lambda: [CF.confidence_level(F.col("score")).alias("level"), CF.clause_confidence_level(F.col("score")).alias("clause_level")],
             f"{scale('score', C.CONFIDENCE_THRESHOLDS, 'VERY_LOW')} AS level, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'medium' ELSE 'low' END AS clause_level")
_level_query("confidence_level_5",
             lambda: [CF.confidence_level_5(F.col("score"))["level"].alias("level"), CF.confidence_level_5(F.col("score"))["review"].alias("review")],
             f"{scale('score', C.CONFIDENCE_SCALE_5, 'VERY_LOW')} AS level, score < 0.7 AS review")


def classify_with_confidence(spark, sf_dir):
    return clause_lines(spark, sf_dir).select("doc_id", "no", CF.score_prediction(F.col("text")).alias("p")).select("doc_id", "no", "p.*")


def _scored(label):
    level = scale("s", C.CONFIDENCE_THRESHOLDS, "VERY_LOW")
    return statement(
        f"""SELECT doc_id, no, label AS prediction, s AS confidence_score, {level} AS confidence_level, s < 0.7 AS requires_review
            FROM (SELECT doc_id, no, label, {rule_confidence('text', 'label')} AS s FROM (SELECT *, {label} AS label FROM {LINES}))""", "contracts")


QUERIES["classify_with_confidence"] = classify_with_confidence
ORACLE["classify_with_confidence"] = _scored(FIRST)


def score_given_prediction(spark, sf_dir):
    lines = clause_lines(spark, sf_dir)
    given = F.when(F.col("no") % 3 == 0, W.pick(C.LABELS, F.col("doc_id") % 13))
    return lines.select("doc_id", "no", "text", given.alias("given")).select(
        "doc_id", "no", CF.score_prediction(F.col("text"), F.col("given")).alias("p")).select("doc_id", "no", "p.*")


QUERIES["score_given_prediction"] = score_given_prediction
ORACLE["score_given_prediction"] = _scored(f"coalesce(CASE WHEN no % 3 = 0 THEN ({lst(C.LABELS)})[doc_id % 13 + 1] END, {FIRST})")


def route_for_review(spark, sf_dir):
    rows = OC.review_queue(OC.clause_rows(W.contracts(spark, sf_dir)))
    return rows.select("doc_id", "clause_no", "type", "confidence", "queue")


QUERIES["route_for_review"] = route_for_review
ORACLE["route_for_review"] = statement(
    "SELECT doc_id, clause_no, type, confidence, CASE WHEN requires_review THEN 'human_review' ELSE 'automatic' END AS queue FROM c_clauses", "c_clauses")


def taxonomy_phrases():
    """Keywords, risk phrases and triggers as one table of phrases."""
    words = {k for _, words, _ in C.CLAUSE_TYPES.values() for k in words} | {w for w, *_ in R.RISK_TRIGGERS + R.MITIGATORS}
    return sorted(words)


def phrase_hits(spark, sf_dir):
    phrases = spark.createDataFrame([(w,) for w in taxonomy_phrases()], "phrase string")
    hits = OP.phrase_hits(W.contracts(spark, sf_dir), phrases)
    return hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))


QUERIES["phrase_hits"] = phrase_hits
ORACLE["phrase_hits"] = statement(
    f"""SELECT doc_id, phrase, len(hits) AS n, length(pieces[1]) AS first_start, length(text) - length(pieces[-1]) AS last_end FROM (
        SELECT doc_id, text, phrase, regexp_extract_all(text, '(?i)\\b' || phrase || '\\b') AS hits, string_split_regex(text, '(?i)\\b' || phrase || '\\b') AS pieces
        FROM contracts CROSS JOIN (SELECT unnest({lst(taxonomy_phrases())}) AS phrase) WHERE contains(lower(text), phrase)) WHERE len(hits) > 0""",
    "contracts")


def encode_labels(spark, sf_dir):
    p = W.predictions(spark, sf_dir).select("true_label", ML.encode_label(F.col("true_label")).alias("idx"))
    return p.groupBy("true_label", "idx").agg(F.count("*").alias("n")).select(
        "true_label", "idx", ML.decode_label(F.col("idx")).alias("decoded"), "n")


QUERIES["encode_labels"] = encode_labels
ORACLE["encode_labels"] = statement(
    f"""SELECT true_label, (list_position(list_sort({lst(C.LABELS)}), true_label) - 1)::INT AS idx, true_label AS decoded, count(*) AS n
        FROM predictions GROUP BY 1""", "predictions")


def ordered_split(spark, sf_dir):
    reg = W.registry(spark, sf_dir).select("id", "status")
    return B.ordered_split(reg, "id", 0.8, block=4096)


QUERIES["ordered_split"] = ordered_split
ORACLE["ordered_split"] = statement(
    """SELECT id, status, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'eval' END AS part
       FROM (SELECT id, status, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () AS n FROM registry)""", "registry")
