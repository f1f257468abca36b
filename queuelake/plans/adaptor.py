"""The driver's event table seen as a queue log: users are rides, user_id % 8 their parks; the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Tokyo")
#: Their offsets in hours throughout the table, which is of one January.
OFFSETS = (0, 1, -5, 9)

Q = """q AS (SELECT event_id, user_id AS entity_id, user_id % 8 AS park_id, ts, ts + (CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -5 ELSE 9 END) * INTERVAL 1 HOUR AS lts,
  CAST(floor(value) AS INT) AS wait, value, props, event_type, CASE event_type WHEN 'error' THEN 'DOWN' WHEN 'signup' THEN 'CLOSED' ELSE 'OPERATING' END AS status,
  CASE WHEN event_type = 'purchase' THEN 'PAID' ELSE 'STANDBY' END AS queue_type FROM events),
op AS (SELECT * FROM q WHERE queue_type = 'STANDBY' AND status = 'OPERATING' AND wait IS NOT NULL)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zone_of(park: Column) -> Column:
    return F.element_at(F.array(*(F.lit(z) for z in ZONES)), (park % len(ZONES)).cast("int") + 1)


def queue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> queue rows with local time ``lts`` of the ride's park."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    park = F.col("user_id") % 8
    return e.select(
        "event_id", F.col("user_id").alias("entity_id"), park.alias("park_id"), ts.alias("ts"), F.from_utc_timestamp(ts, zone_of(park)).alias("lts"), F.floor("value").cast("int").alias("wait"), "value", "props", "event_type",
        F.when(kind == "error", "DOWN").when(kind == "signup", "CLOSED").otherwise("OPERATING").alias("status"), F.when(kind == "purchase", "PAID").otherwise("STANDBY").alias("queue_type"),
    )


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def r4(c: Column) -> Column:
    return F.round(c.cast("double"), 4)
