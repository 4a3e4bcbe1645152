"""Explicit schemas of all inputs; nothing is inferred."""

from pyspark.sql import types as T

PREDICTIONS = T.StructType([
    T.StructField("clause_text", T.StringType()),
    T.StructField("predicted_label", T.StringType()),
    T.StructField("true_label", T.StringType()),
    T.StructField("contract_type", T.StringType()),
])
DOCUMENT_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
FEEDBACK = T.StructType([
    T.StructField("clause_id", T.StringType()),
    T.StructField("original_text", T.StringType()),
    T.StructField("model_prediction", T.StringType()),
    T.StructField("model_confidence", T.DoubleType()),
    T.StructField("user_correction", T.StringType()),
    T.StructField("feedback_type", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("additional_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("is_processed", T.BooleanType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
