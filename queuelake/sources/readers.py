"""Readers: live data, schedules, weather and holidays, each with its schema; several sources as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelake.plans.adaptor import queue_log, read
from queuelake.registry import query

LIVE = T.StructType([
    T.StructField("external_id", T.StringType()), T.StructField("park_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("queue_type", T.StringType()),
    T.StructField("wait", T.IntegerType()), T.StructField("ts", T.TimestampType()),
])
WEATHER = T.StructType([
    T.StructField("park_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("temperature", T.DoubleType()), T.StructField("precipitation", T.DoubleType()), T.StructField("gust", T.DoubleType()), T.StructField("code", T.IntegerType()),
])
HOLIDAY = T.StructType([T.StructField("country", T.StringType()), T.StructField("region", T.StringType()), T.StructField("date", T.DateType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("nationwide", T.BooleanType())])
SCHEMAS = {"live": LIVE, "weather": WEATHER, "holiday": HOLIDAY}


def load(spark: SparkSession, kind: str, path: str, form: str = "json") -> DataFrame:
    """A drop folder of one source; the schema is given, never inferred."""
    return spark.read.schema(SCHEMAS[kind]).format(form).load(path)


def load_stream(spark: SparkSession, kind: str, path: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).format(form).load(path)


def combined(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one table, with a column that names each row's; columns that a source lacks are null."""
    out = None
    for name, rows in sorted(sources.items()):
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


@query("src2_combined_sources", "SELECT 'a' AS source, event_id, NULL AS value FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', event_id, value FROM events WHERE event_type = 'click'")
def src2(spark, sf):
    log = queue_log(spark, sf)
    return combined({"a": log.filter("event_type = 'view'").select("event_id"), "b": log.filter("event_type = 'click'").select("event_id", "value")}).select("source", "event_id", "value")


@query("src6_optional_lookup", "SELECT n_nationkey, max(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END) AS height, max(CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END) AS speed FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey WHERE n_nationkey IN (1, 3, 5, 24) GROUP BY 1")
def src6(spark, sf):
    """A list of ids with what is known of each: left joins."""
    ids = read(spark, sf, "nation").filter(F.col("n_nationkey").isin(1, 3, 5, 24)).select("n_nationkey")
    s = read(spark, sf, "supplier")
    of = lambda k, name: s.filter(F.col("s_suppkey") % 2 == k).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_acctbal").alias(name))
    return ids.join(of(0, "height"), "n_nationkey", "left").join(of(1, "speed"), "n_nationkey", "left")
