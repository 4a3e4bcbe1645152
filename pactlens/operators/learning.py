"""Clause classifiers (E16, E18, E19): word counts in closed form, and a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.fixed.clauses import LABELS
from pactlens.operators.rows import item_rows
from pactlens.session import materialize
from pactlens.sources.commits import Snapshot, Snapshots


def encode_label(label: Column, labels=LABELS) -> Column:
    """Index of a label in sorted label order, NULL for an unknown one."""
    known = F.array(*[F.lit(x) for x in sorted(labels)])
    at = F.array_position(known, label).cast("int")
    return F.when(at > 0, at - 1)


def decode_label(index: Column, labels=LABELS) -> Column:
    """Label of a sorted-order index."""
    return F.try_element_at(F.array(*[F.lit(x) for x in sorted(labels)]), (index + 1).cast("int"))


def train_clause_classifier(train: DataFrame, features: int = 1 << 12, max_iter: int = 20) -> PipelineModel:
    """Multinomial logistic regression on hashed, weighted words (E18).  Input: text, label."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
            RegexTokenizer(inputCol="text", outputCol="words", pattern="[^A-Za-z0-9]+", minTokenLength=2),
            HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features", minDocFreq=2),
            LogisticRegression(
                featuresCol="features", labelCol="label_index", family="multinomial", maxIter=max_iter, regParam=0.01
            ),
        ]
    ).fit(train)


def score_clauses(model: PipelineModel, clauses: DataFrame) -> DataFrame:
    """Adds clause_type, confidence and all_scores (probability per label)."""
    labels = model.stages[0].labels
    names = F.array(*[F.lit(x) for x in labels])
    # the indexer needs no label when scoring
    scored = clauses
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    scores = scored.withColumn("_p", vector_to_array("probability"))
    return scores.select(
        *clauses.columns,
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("clause_type"),
        F.array_max("_p").alias("confidence"),
        F.map_from_arrays(names, "_p").alias("all_scores"),
    )


#: Words of a clause: runs of two or more ASCII letters and digits, in lower case.
WORD = "[A-Za-z0-9]{2,}"


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


@dataclass(frozen=True)
class WordModel:
    """labels, sorted, and a table word, weights: log-probabilities of the word under each label; those of the missing word are priors."""

    labels: tuple[str, ...]
    table: DataFrame


def train_word_model(train: DataFrame, smoothing: float = 1.0) -> WordModel:
    """Multinomial model of the words of each label, from (text, label) rows.

    Sums over words and labels, so it is trained in two grouped counts without iterations and gives the same weights on every run
    and engine.  Rows without a label are left out.  Only the labels reach the driver.
    """
    known = train.filter(F.col("label").isNotNull()).select("text", "label")
    sizes = known.groupBy("label").count().orderBy("label").collect()
    labels, total = tuple(r["label"] for r in sizes), sum(r["count"] for r in sizes)
    rows = item_rows(known, words_of(F.col("text")), "label", item="word").groupBy("label", "word").agg(F.count("*").alias("n"))
    rows = materialize(rows, "word-counts")
    of_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    vocabulary = rows.select("word").distinct().count()
    counts = [F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)) for label in labels]
    weights = [
        F.log((c + F.lit(smoothing)) / F.lit(of_label.get(label, 0) + smoothing * vocabulary)) for label, c in zip(labels, counts, strict=True)
    ]
    table = rows.groupBy("word").agg(F.array(*weights).cast("array<double>").alias("weights"))
    priors = [F.log(F.lit(r["count"] / total)) for r in sizes]
    prior = train.sparkSession.range(1).select(F.lit(None).cast("string").alias("word"), F.array(*priors).cast("array<double>").alias("weights"))
    return WordModel(labels, table.unionByName(prior))


def save_word_model(model: WordModel, path: str) -> int:
    """Write a model as the next version of those at the path, and its number; readers see it as a whole or not at all."""
    store = Snapshots(model.table.sparkSession, path)
    before = store.current()
    version = before.batch + 1 if before else 1
    labelled = model.table.withColumn("labels", F.array(*[F.lit(x) for x in model.labels]).cast("array<string>"))
    name, n = store.write(labelled, f"model-{version:06d}")
    store.point_to(Snapshot(version, {name: n}))
    return version


def load_word_model(spark: SparkSession, path: str) -> WordModel:
    """The last version at the path; nothing is trained."""
    table = Snapshots(spark, path).read()
    if table is None:
        raise FileNotFoundError(f"no model at {path}")
    return WordModel(tuple(table.filter(F.col("word").isNull()).first()["labels"]), table.drop("labels"))


def score_words(model: WordModel, clauses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The clauses with clause_type, confidence and all_scores (probability per label) under a word model.

    `keys` name a row.  Words are counted per clause and joined with their weights; words that the model hasn't seen don't count, and a
    clause without known words has the priors.  Of equally probable labels the first by name is taken.
    """
    keys, count = list(keys), len(model.labels)
    prior = model.table.filter(F.col("word").isNull()).first()["weights"]  # one number a label
    words = item_rows(clauses.select(*keys, F.col("text")), words_of(F.col("text")), *keys, item="word").groupBy(*keys, "word").agg(F.count("*").alias("n"))
    found = words.join(model.table.filter(F.col("word").isNotNull()), "word")
    sums = found.groupBy(*keys).agg(F.array(*(F.sum(F.col("n") * F.get("weights", F.lit(k))) for k in range(count))).alias("s"))
    joined = clauses.join(sums, keys, "left")
    logs = F.array(*(F.coalesce(F.get("s", F.lit(k)), F.lit(0.0)) + F.lit(prior[k]) for k in range(count)))
    shares = joined.withColumn("l", logs).withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    names = F.array(*[F.lit(x) for x in model.labels])
    shares = shares.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)))
    return shares.select(
        *clauses.columns, F.get(names, (F.array_position("l", F.array_max("l")) - 1).cast("int")).alias("clause_type"),
        F.array_max("p").alias("confidence"), F.map_from_arrays(names, "p").alias("all_scores"),
    )
