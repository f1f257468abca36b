"""Schemas of the tables that the operators work on; times are UTC, park-local times are derived."""

from pyspark.sql import types as T

QUEUE = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("entity_id", T.LongType()), T.StructField("park_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("wait", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("queue_type", T.StringType()),
])
SCHEDULE = T.StructType([
    T.StructField("park_id", T.LongType()), T.StructField("entity_id", T.LongType()), T.StructField("date", T.DateType()), T.StructField("type", T.StringType()),
    T.StructField("opens", T.TimestampType()), T.StructField("closes", T.TimestampType()), T.StructField("updated", T.TimestampType()),
])
PREDICTION = T.StructType([
    T.StructField("entity_id", T.LongType()), T.StructField("target", T.TimestampType()), T.StructField("made", T.TimestampType()), T.StructField("predicted", T.DoubleType()),
])
