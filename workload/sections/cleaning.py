"""Cleaning and layout queries (C1-C19) and their SQL."""

import string

from pyspark.sql import functions as F

from pactlens.fixed import noise as N
from pactlens.functions import cleaning as CL
from pactlens.functions import layout as L
from pactlens.functions.text import normalize_whitespace
from pactlens.operators import documents as OD
from pactlens.operators.rows import item_rows
from pactlens.plans.ingest import batch_file_results, batch_outcomes, ingest_batches
from pactlens.fixed import documents as D
from workload import derived as W
from workload.sections.checks import MERGED_SQL, _PIECE
from workload.sql import STAGES, any_re2, count_words, q, re2, replaced, squeeze, statement, strip

QUERIES, ORACLE = {}, {}



def _text_query(name, function, sql):
    def run(spark, sf_dir):
        return W.contracts(spark, sf_dir).select("doc_id", function(F.col("text")).alias("cleaned"))

    QUERIES[name] = run
    ORACLE[name] = statement(f"SELECT doc_id, {sql} AS cleaned FROM contracts", "contracts")


def clean_sql(t):
    t = replaced(t, [(r"[^\w\s.,;:!?()-]", "")])
    t = replaced(t, [(r"\s+", "")])
    t = f"regexp_replace({t}, '\\.{{4,}}', '...', 'g')"
    # the engine has no backreference: one replacement per word character
    for ch in string.ascii_letters + string.digits + "_":
        t = f"regexp_replace({t}, '\\b{ch}{{4,}}\\b', '{ch}', 'g')"
    t = f"regexp_replace({t}, '-{{3,}}', '---', 'g')"
    return strip(replaced(t, [("_{3,}", "")]))


NP = N.NOISE_PATTERNS


def stamp_sql(t):
    return replaced(t, NP["eStamp"] + [(p.replace(" ", r"\s+"), "i") for p in N.STAMP_PHRASES])


def metadata_sql(t):
    return replaced(replaced(t, NP["metadata"]), NP["government"])


def page_sql(t):
    return replaced(t, NP["pageNumbers"])


def ocr_sql(t):
    for s, f in NP["ocrArtifacts"]:
        t = replaced(t, [(s, f)], " " if "{3,}" in s else "")
    return t


def boilerplate_sql(t):
    return replaced(replaced(t, NP["boilerplate"]), NP["watermarks"])


def noise_sql(text):
    full = squeeze(boilerplate_sql(ocr_sql(page_sql(metadata_sql(stamp_sql(text))))))
    safe = squeeze(replaced(text, N.CONSERVATIVE_PATTERNS))
    return full, safe


def filtered_sql(source, columns="doc_id"):
    full, safe = noise_sql("text")
    return f"""SELECT {columns}, CASE WHEN text = '' THEN '' WHEN length(f) < length(text) * 0.3 OR {count_words('lower(f)', N.CONTRACT_KEYWORDS)} < 3
        OR length(f) < 100 THEN {safe} ELSE f END AS cleaned FROM (SELECT *, {full} AS f FROM {source})"""


_text_query("clean_text", CL.clean_text, clean_sql("text"))
_text_query("remove_stamp_noise", CL.remove_stamp_noise, stamp_sql("text"))
_text_query("remove_metadata_noise", CL.remove_metadata_noise, metadata_sql("text"))
_text_query("remove_page_noise", CL.remove_page_noise, page_sql("text"))
_text_query("remove_ocr_artifacts", CL.remove_ocr_artifacts, ocr_sql("text"))
_text_query("remove_boilerplate", CL.remove_boilerplate, boilerplate_sql("text"))
_text_query("normalize_whitespace", normalize_whitespace, squeeze("text"))


def filter_document_noise(spark, sf_dir):
    both = W.contracts(spark, sf_dir).withColumn("kind", F.lit("contract")).unionByName(
        W.documents(spark, sf_dir).withColumn("kind", F.lit("document")))
    return both.select("kind", "doc_id", CL.filter_document_noise(F.col("text")).alias("cleaned"))


QUERIES["filter_document_noise"] = filter_document_noise
ORACLE["filter_document_noise"] = statement(
    filtered_sql("(SELECT 'contract' AS kind, doc_id, text FROM contracts UNION ALL SELECT 'document', doc_id, text FROM documents)", "kind, doc_id"),
    "contracts")


#: A text without noise, which every fifth document brings along as a further document.
NO_NOISE, FURTHER = "The tenant pays the rent.", 1_000_000_000


def analyze_noise(spark, sf_dir):
    docs = W.contracts(spark, sf_dir)
    clean = docs.filter(F.col("doc_id") % 5 == 0).select((F.col("doc_id") + FURTHER).alias("doc_id"), F.lit(NO_NOISE).alias("text"))
    return OD.analyze_noise(docs.unionByName(clean))


_NOISE = " UNION ALL ".join(
    f"""SELECT doc_id, {q(cat)} AS category, {q(s)} AS pattern, length(text) AS n, regexp_extract_all(text, {q(re2(s, f))}) AS m FROM noisy"""
    for cat, ps in NP.items() for s, f in ps)
STAGES["noisy"] = (["contracts"], f"SELECT doc_id, text FROM contracts UNION ALL SELECT doc_id + {FURTHER}, {q(NO_NOISE)} FROM contracts WHERE doc_id % 5 = 0")
QUERIES["analyze_noise"] = analyze_noise
ORACLE["analyze_noise"] = statement(
    f"""SELECT doc_id, (sum(chars) OVER (PARTITION BY doc_id))::BIGINT AS noise_chars,
          floor((sum(chars) OVER (PARTITION BY doc_id))::DOUBLE * 100.0 / n * 100 + 0.5) / 100.0 AS noise_percentage, category, pattern, len(m) AS matches,
          array_to_string(m[1:3], ' | ') AS examples
        FROM (SELECT *, length(array_to_string(m, '')) AS chars FROM ({_NOISE}) WHERE len(m) > 0)
        UNION ALL SELECT doc_id, 0, CASE WHEN text <> '' THEN 0.0 END, NULL, NULL, NULL, NULL FROM noisy
        WHERE doc_id NOT IN (SELECT doc_id FROM ({_NOISE}) WHERE len(m) > 0)""", "noisy")


def extract_contract_sections(spark, sf_dir):
    docs = W.contracts(spark, sf_dir)
    return item_rows(docs, CL.contract_sections(F.col("text")), "doc_id", position="i", item="section").select(
        "doc_id", (F.col("i") + 1).alias("section_no"), "section")


_ANY_NOISE = any_re2([p for g in NP.values() for p in g])
_KEYWORD = "(?i)" + "|".join(N.CONTRACT_KEYWORDS)
QUERIES["extract_contract_sections"] = extract_contract_sections
ORACLE["extract_contract_sections"] = statement(
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS section_no, section FROM (
          SELECT doc_id, island, string_agg(line, chr(10) ORDER BY no) AS section FROM (
            SELECT *, min(no) FILTER (NOT broken AND keyword) OVER (PARTITION BY doc_id, island) AS first_no FROM (
              SELECT *, sum(broken::INT) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM (
                SELECT doc_id, no, line, {strip('line')} = '' OR regexp_matches(line, {q(_ANY_NOISE)}) AS broken, regexp_matches(line, {q(_KEYWORD)}) AS keyword
                FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM contracts)))))
          WHERE NOT broken AND no >= first_no GROUP BY doc_id, island)""", "contracts")


def document_structure(spark, sf_dir):
    return W.contracts(spark, sf_dir).select("doc_id", L.document_structure(F.col("text")).alias("s")).select("doc_id", "s.*")


QUERIES["document_structure"] = document_structure
ORACLE["document_structure"] = statement(
    """SELECT doc_id, header AS has_header, footer AS has_footer, tabular AS has_table, first AS contract_start, body_start, end_line AS body_end
       FROM c_structure""", "c_structure")


def _layout(name, function, sql, *needs):
    def run(spark, sf_dir):
        return W.contracts(spark, sf_dir).select("doc_id", function(F.col("text")).alias("cleaned"))

    QUERIES[name] = run
    ORACLE[name] = statement(sql, *needs)


from workload.sql import LINE_PATTERNS, body_noise  # noqa: E402

_layout("filter_body_noise", L.filter_body_noise, f"SELECT doc_id, {body_noise('text')} AS cleaned FROM contracts", "contracts")
_layout("filter_region_noise", L.filter_region_noise, f"SELECT doc_id, {squeeze(replaced('text', LINE_PATTERNS, ' '))} AS cleaned FROM contracts", "contracts")
_layout("conservative_body", L.conservative_body, "SELECT doc_id, text AS cleaned FROM c_conservative", "c_conservative")
_layout("filter_layout_noise", L.filter_layout_noise, "SELECT doc_id, text AS cleaned FROM c_layout", "c_layout")


def validate_layout_result(spark, sf_dir):
    """The check on texts that were cut to a growing share of the original."""
    docs = W.contracts(spark, sf_dir)
    kept = F.substring("text", F.lit(1), (F.length("text") * (F.col("doc_id") % 10) / 10).cast("int"))
    return docs.select("doc_id", "text", kept.alias("f")).select(
        "doc_id", L.validate_layout_result(F.col("f"), F.col("text")).alias("cleaned"))


QUERIES["validate_layout_result"] = validate_layout_result
ORACLE["validate_layout_result"] = statement(
    f"""SELECT doc_id, CASE WHEN (length(o) - length(f))::DOUBLE / length(o) > 0.8 OR ({count_words('lower(f)', N.LAYOUT_INDICATORS)} < 3 AND length(f) < 500)
          THEN c ELSE {strip(replaced('f', [(r'\s{3,}', '')]))} END AS cleaned
        FROM (SELECT t.doc_id, t.text AS o, k.text AS c, t.text[1:floor(length(t.text) * (t.doc_id % 10) / 10)::INT] AS f
              FROM contracts t JOIN c_conservative k USING (doc_id))""", "c_conservative")


def analyze_layout(spark, sf_dir):
    return item_rows(W.contracts(spark, sf_dir), L.layout_findings(F.col("text")), "doc_id", item="f").select(
        "doc_id", F.col("f.kind").alias("kind"), F.col("f.region").alias("region"), F.col("f.pattern").alias("pattern"),
        F.col("f.matches").alias("matches"), F.array_join("f.examples", " | ").alias("examples"))


_LAYOUT = " UNION ALL ".join(
    [f"SELECT doc_id, 'region' AS kind, {q(r)} AS region, {q(s)} AS pattern, 1 AS matches, regexp_extract(text, {q(re2(s, f))}, 0) AS examples FROM contracts WHERE regexp_matches(text, {q(re2(s, f))})"
     for r, ps in N.LAYOUT_REGIONS.items() for s, f in ps]
    + [f"SELECT doc_id, 'noise', {q(r)}, {q(s)}, len(m), array_to_string(m[1:2], ' | ') FROM (SELECT doc_id, regexp_extract_all(text, {q(re2(N.LINE_NOISE_FAST.get(s, s), f))}) AS m FROM contracts) WHERE len(m) > 0"
       for r, ps in N.LINE_NOISE.items() for s, f in ps])
QUERIES["analyze_layout"] = analyze_layout
ORACLE["analyze_layout"] = statement(f"SELECT * FROM ({_LAYOUT})", "contracts")

_OCR = strip("(" + squeeze("text") + ")")
for _lit in N.OCR_LITERALS:
    _OCR = f"replace({_OCR}, {q(_lit)}, ' ')"
_text_query("postprocess_ocr_text", CL.postprocess_ocr_text,
            f"CASE WHEN length({strip(_OCR)}) > 3 THEN {strip(_OCR)} ELSE '' END")


def document_stats(spark, sf_dir):
    return W.contracts(spark, sf_dir).select(
        "doc_id", CL.character_count(F.col("text")).alias("characters"), CL.word_count(F.col("text")).alias("words"))


QUERIES["document_stats"] = document_stats
ORACLE["document_stats"] = statement(
    f"SELECT doc_id, length(text) AS characters, len(string_split_regex(text, {q(re2(chr(92) + 's+'))})) AS words FROM contracts", "contracts")


def ingest(spark, sf_dir):
    return ingest_batches(W.batch_files(spark, sf_dir))


_FILES = filtered_sql("(SELECT batch_id, ord, original_name, error, text FROM batch_files)", "batch_id, ord, original_name, error")
_CLEANED = f"""(SELECT batch_id, ord, original_name, error, CASE WHEN error IS NULL THEN {clean_sql('cleaned')} ELSE '' END AS text FROM ({_FILES}))"""
def _with_unreadable(files):
    """Every seventh batch holds blank files only."""
    return files.withColumn("text", F.when(F.col("batch_id") % 7 == 0, F.lit(" \n")).otherwise(F.col("text")))


QUERIES["batch_file_results"] = lambda spark, sf_dir: batch_file_results(W.batch_files(spark, sf_dir))
ORACLE["batch_file_results"] = statement(
    f"""SELECT batch_id, ord, original_name, text[1:{D.PREVIEW_CHARS}] AS preview, length(text) AS characters, error FROM {_CLEANED}""", "batch_files")
QUERIES["batch_outcomes"] = lambda spark, sf_dir: batch_outcomes(_with_unreadable(W.batch_files(spark, sf_dir)))
ORACLE["batch_outcomes"] = statement(
    f"""SELECT batch_id, files, readable, failed, CASE WHEN readable = 0 THEN 'error' ELSE 'uploaded' END AS status,
        CASE WHEN readable = 0 THEN {q(D.ERR_NO_TEXT_IN_BATCH)} END AS error FROM (
          SELECT batch_id, count(*) AS files, count(*) FILTER (error IS NULL AND text <> '' AND batch_id % 7 <> 0) AS readable,
                 count(*) FILTER (error IS NOT NULL) AS failed FROM {_CLEANED} GROUP BY batch_id)""", "batch_files")
QUERIES["ingest_batches"] = ingest
ORACLE["ingest_batches"] = statement(
    f"""SELECT batch_id, text, length(text) AS characters, len(string_split_regex(text, {q(re2(chr(92) + 's+'))})) AS words
        FROM ({MERGED_SQL.format(cap=D.BATCH_TEXT_CHARS, marker=q(D.BATCH_MARKER), piece=_PIECE, source=_CLEANED)})""", "batch_files")
