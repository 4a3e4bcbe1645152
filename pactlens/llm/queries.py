"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pactlens.llm import bpe, byte_dedup, exact_dedup, host_trust, licenses, mixing, periodic_runs, prefix_trie, quality_model, quality_rules, simhash, token_counts, toxicity
from pactlens.llm.common import materialize, scratch_path, table
from pactlens.llm.sql import EXACT_DEDUP, HOST_TRUST, MIXING, PREFIX_TRIE, QUALITY_RULES, TOKEN_COUNTS

VOCABULARY = "word_bpe_49k.json"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(mixing.sized_documents(table(spark, sf_dir, "documents")), "sized")
    return mixing.mix(sized)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed is delivered twice, as after a failure; the second delivery changes nothing."""
    feed = materialize(token_counts.document_changes(table(spark, sf_dir, "documents")), "changes")
    return token_counts.rollup_of([feed, feed], spark, scratch_path(spark, "rollup"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_period)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), prefix_trie.shared_beginnings)


def op13_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_trust.judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_model": op8_quality_model,
    "op9_byte_dedup": op9_byte_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_host_trust": op13_host_trust,
}
ORACLE = {
    "op2_mixing": MIXING,
    "op3_token_counts": TOKEN_COUNTS,
    "op7_exact_dedup": EXACT_DEDUP,
    "op10_quality_rules": QUALITY_RULES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_host_trust": HOST_TRUST,
}
