"""Tables derived from the supplied ones by integer arithmetic (Spark form).

`workload.sql` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.fixed.clauses import LABELS
from pactlens.functions.text import literal_array
from pactlens.operators.rows import spread
from workload.bank import BANK

CONTRACT_TYPES = ["service", "rental", "employment", "nda", "sales", "partnership"]
MIMES = [
    "application/pdf", "text/plain", "image/png", "application/msword", "image/jpeg",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip",
]
#: Tasks for each core of the session over which a table of few row groups is dealt.
TASKS_PER_CORE = 4
FEEDBACK_START, FEEDBACK_END = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def pick(values: list[str], index: Column) -> Column:
    """values[index], zero-based."""
    return F.element_at(literal_array(values), (index + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text; a table of fewer splits than TASKS_PER_CORE for each core is dealt over so many tasks, any other is left as it is.

    A scan makes about one split a core of whatever fits, some without a row group, and one more than there are cores takes a second round
    of tasks; that costs far more than to move the text of so small a table.
    """
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return spread(docs, "doc_id", tasks) if docs.rdd.getNumPartitions() < tasks else docs


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bank entries, the document text, and a footer line on every fourth document."""
    docs = documents(spark, sf_dir)
    slots = [pick(BANK, (F.col("doc_id") * 31 + k * 17) % len(BANK)) for k in range(8)]
    footer = F.when(F.col("doc_id") % 4 == 0, F.lit("Signature page, PAGE 9"))
    return docs.select("doc_id", F.concat_ws("\n", *slots, F.col("text"), footer).alias("text"))


def contracts_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`contracts` plus one line of invented personal data per document."""
    i = F.col("doc_id")
    number = F.lpad((i % 10000).cast("string"), 4, "0")
    line = F.concat(
        F.lit("Contact: user"), i.cast("string"), F.lit("@mail.example.com, phone 555-123-"), number,
        F.when(i % 3 == 0, F.concat(F.lit(", ssn 123-45-"), number)).otherwise(F.lit("")),
        F.when(i % 5 == 0, F.concat(F.lit(", card 4111-1111-1111-"), number)).otherwise(F.lit("")),
        F.when(i % 7 == 0, F.lit(", host 10.0.0.12, signed John Smith")).otherwise(F.lit("")),
        F.lit("."),
    )
    return contracts(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.col("text"), line).alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, true_label, predicted_label, contract_type and clause text from lineitem."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    wrong = ((o + n) % 7 == 0) | ((s % 6 == 3) & (p % 3 == 0))
    return li.select(
        (o * 10 + n).alias("ord"),
        pick(LABELS, p % 13).alias("true_label"),
        F.when(wrong, pick(LABELS, (p + 5) % 13)).otherwise(pick(LABELS, p % 13)).alias("predicted_label"),
        F.when((o + n) % 11 != 5, pick(CONTRACT_TYPES, s % 6)).alias("contract_type"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer feedback events from the event table."""
    return feedback_of(read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"))


def feedback_of(events: DataFrame) -> DataFrame:
    """The same for a stream of events."""
    e = F.col("event_id")
    return events.select(
        e.alias("feedback_id"),
        F.concat(F.lit("clause_"), (e % 97).cast("string")).alias("clause_id"),
        F.expr("cast(ts as timestamp)").alias("timestamp"),
        F.nullif(F.col("user_id"), F.lit(7)).alias("user_id"),
        (F.floor(F.col("value") * 2 + 0.5) / 1000.0).alias("model_confidence"),
        F.when(F.col("event_type") == "view", F.lit("confirmation")).otherwise(F.lit("correction")).alias("feedback_type"),
        F.when(e % 19 != 3, pick(LABELS, e % 13)).alias("model_prediction"),
        F.when(e % 23 == 3, F.lit(None)).when(e % 4 != 0, pick(LABELS, e % 13)).otherwise(pick(LABELS, (e + 1) % 13)).alias("user_correction"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored-document registry from orders."""
    od = read(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey")
    k = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("processing")
    )
    return od.select(
        k.alias("id"),
        F.concat(F.lit("Batch "), (F.col("o_custkey") % 50).cast("string")).alias("batch_name"),
        F.concat(F.lit("contract_"), k.cast("string"), F.lit(".txt")).alias("original_name"),
        pick(MIMES, k % 7).alias("mime"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", pick(["low", "medium", "high"], k % 3)).alias("risk_level"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("file_size"),
        F.expr("cast(o_orderdate as timestamp)").alias("uploaded_at"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of upload batches from lineitem: batch = order, ord = line number; every 97th order goes into one large upload."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        F.when(o % 97 == 3, F.lit(3)).otherwise(o).alias("batch_id"),
        F.when(o % 97 == 3, o * 10 + n).otherwise(n).cast("bigint").alias("ord"),
        F.concat(F.lit("file_"), (o * 10 + n).cast("string"), F.lit(".bin")).alias("filename"),
        F.concat(F.lit("Lease "), n.cast("string"), F.lit(" of "), o.cast("string")).alias("original_name"),
        F.floor(F.col("l_extendedprice") * 1000 + 0.5).cast("bigint").alias("size"),
        pick(MIMES, (F.col("l_partkey") + n) % 7).alias("mime"),
    )


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted files of batches from conversations; every 11th turn failed, every 13th is blank."""
    cv = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    n = F.col("conv_id") + F.col("turn")
    return cv.select(
        F.col("conv_id").alias("batch_id"),
        F.col("turn").alias("ord"),
        F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string"), F.lit(".txt")).alias("original_name"),
        F.when(n % 13 == 5, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(n % 11 == 3, F.lit("unreadable file")).alias("error"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of documents from the event table; the event id breaks ties."""
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    names = {"view": "uploaded", "click": "extracting", "error": "error", "purchase": "completed"}
    status = F.lit("processing")
    for event, name in names.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    return ev.select(
        F.col("user_id").alias("doc_id"), F.expr("cast(ts as timestamp)").alias("ts"), F.col("event_id"), status.alias("status")
    )
