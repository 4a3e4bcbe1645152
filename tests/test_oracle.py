"""Every registered query against its SQL on whole tables; the others must return rows."""

import pytest

from workload.compare import compare, connect
from workload.registry import ORACLE, QUERIES


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        problem, rows, _, _ = compare(df, con, ORACLE[name])
        assert problem is None
    else:
        rows = df.count()
    assert rows > 0


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_no_shuffle_besides_the_spread(spark):
    import __spark_entry__

    plan = __spark_entry__.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_branches_are_reached(spark, sf_dir):
    """The derived tables reach every clause type, trigger, level, message and fallback."""
    from pyspark.sql import functions as F

    from pactlens.fixed import clauses as C
    from pactlens.fixed import risk as R

    types = {r["type"] for r in QUERIES["top_clauses"](spark, sf_dir).select("type").distinct().collect()}
    assert types == set(C.CLAUSE_TYPES)
    words = {r["word"] for r in QUERIES["risk_triggers"](spark, sf_dir).select("word").distinct().collect()}
    assert words == {t[0] for t in R.RISK_TRIGGERS + R.MITIGATORS}
    factors = QUERIES["risk_factors"](spark, sf_dir).select(F.explode(F.split("factors", " \\| ")).alias("f")).distinct()
    found = {r["f"] for r in factors.collect()}
    assert {f[2] for f in R.CONTEXT_FACTORS} <= found
    levels = {r["risk_level"] for r in QUERIES["risk_level"](spark, sf_dir).select("risk_level").distinct().collect()}
    assert levels == {"LOW", "MEDIUM", "HIGH"}
    priorities = {r["priority"] for r in QUERIES["clause_priority"](spark, sf_dir).select("priority").distinct().collect()}
    assert priorities == {"low", "medium", "high", "critical"}
    labels = {r["label"] for r in QUERIES["detect_pii_configured"](spark, sf_dir).select("label").distinct().collect()}
    assert {"EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS"} == labels
    structure = QUERIES["document_structure"](spark, sf_dir)
    counts = structure.agg(
        F.count_if("has_header").alias("h"), F.count_if("has_footer").alias("f"), F.count_if("has_table").alias("t"), F.count("*").alias("n")
    ).first()
    assert 0 < counts["h"] < counts["n"] and 0 < counts["f"] < counts["n"] and counts["t"] > 0
