"""Quality classifier: a sparse rule ensemble.

Shallow trees of a random forest over text statistics are taken apart into conjunctive rules, one for each path from a root.  A logistic
regression with lasso weights keeps few of them.  The rules that are left become one Spark column expression, so that scoring is a
projection without user functions.

Learning reads a bounded sample of labelled rows (TRAIN_ROWS); the score looks at every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import materialize
from pactlens.llm.text_stats import with_stats
from pactlens.llm.training import TRAIN_ROWS, held_out, training_rows

THRESHOLD = 0.7
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 7
#: Shares of one statistic in another.
SHARES = {
    "symbols": ("n_symbols", "n_words"), "exclamations": ("n_exclaim", "n_words"), "capitals": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"),
    "distinct_words": ("n_distinct", "n_words"), "stop_words": ("n_stop", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}
STATISTICS = ("n_words", *SHARES)


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_most: bool
    limit: float

    def column(self, stat) -> Column:
        return stat(self.statistic) <= self.limit if self.at_most else stat(self.statistic) > self.limit


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    constant: float

    def score(self, stat) -> Column:
        total = F.lit(self.constant)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(compiled(rule, stat), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def compiled(rule: Rule, stat) -> Column:
    return reduce(and_, (c.column(stat) for c in rule))


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Adds q_<name> for each of STATISTICS; a share of nothing is 0."""
    rows = with_stats(docs, text, "s_")
    named = {"q_n_words": F.col("s_n_words").cast("double")}
    for name, (part, whole) in SHARES.items():
        named[f"q_{name}"] = F.when(F.col(f"s_{whole}") > 0, F.col(f"s_{part}") / F.col(f"s_{whole}")).otherwise(F.lit(0.0))
    return rows.withColumns(named)


def _stat(name: str) -> Column:
    return F.col(f"q_{name}")


def paths(node, above: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to the nodes below a node of a fitted tree."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    name, limit = STATISTICS[split.featureIndex()], float(split.threshold())
    out = []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        rule = (*above, Condition(name, at_most, limit))
        out += [rule, *paths(child, rule)]
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """Without labelled rows the score is 0.5; with rows of one kind only it is theirs."""
    known = training_rows(docs, labels, "quality", rows)
    stats = with_statistics(known, "text").select("doc_id", F.col("y").cast("double").alias("y"), *(f"q_{n}" for n in STATISTICS))
    # one sorted partition of a bounded number of rows: the forest's samples are then the same in every run
    sample = materialize(materialize(stats, "quality-statistics").repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id"), "quality-sample")
    seen = sample.agg(F.count("*").alias("n"), F.avg("y").alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        return RuleModel((), (), {None: 0.0, 0.0: -30.0, 1.0: 30.0}[seen["share"]])
    vectors = sample.select("y", *(f"q_{n}" for n in STATISTICS), array_to_vector(F.array(*(_stat(n) for n in STATISTICS))).alias("x"))
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = list(dict.fromkeys(r for tree in forest._java_obj.trees() for r in paths(tree.rootNode())))
    if not rules:
        return RuleModel((), (), 0.0)
    hits = vectors.select("y", array_to_vector(F.array(*(compiled(r, _stat).cast("double") for r in rules))).alias("x"))
    hits = materialize(hits, "quality-rules")
    lasso = LogisticRegression(labelCol="y", featuresCol="x", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(hits)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A missing or empty text has statistics of 0 and is scored like any other.  Rows are scored one by one: ties and repeated rows have
    equal scores, a missing doc_id stays missing and isn't held out, further columns don't matter, and an empty table gives an empty
    result.
    """
    model = train(docs, labels)
    rows = with_statistics(docs.select(docs["doc_id"], docs["text"].alias("text")), "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(_stat).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
