"""Latest-per-key selection, deduplication and compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.operators.rollup import SCHED, schedules, standby_operating
from queuelake.plans.adaptor import Q, queue_log, read
from queuelake.registry import query


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in this order: a window with a rank limit, which Spark applies before the shuffle as well."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def latest_per(df: DataFrame, keys: list[str], *first: Column) -> DataFrame:
    """The newest row of each key; ``first`` comes before newness."""
    return first_per(df, keys, *first, F.desc("ts"), F.desc("event_id"))


_TOP = "QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {first}ts DESC, event_id DESC) = 1"


@query("dd1_latest_wait", f"WITH {Q} SELECT entity_id, wait, event_id FROM op {_TOP.format(keys='entity_id', first='')}")
def dd1(spark, sf):
    return latest_per(standby_operating(queue_log(spark, sf)), ["entity_id"]).select("entity_id", "wait", "event_id")


@query("dd2_latest_standby_first", f"WITH {Q} SELECT entity_id, queue_type, wait, event_id FROM q {_TOP.format(keys='entity_id', first='(queue_type <> $$STANDBY$$), ')}")
def dd2(spark, sf):
    return latest_per(queue_log(spark, sf), ["entity_id"], F.col("queue_type") != "STANDBY").select("entity_id", "queue_type", "wait", "event_id")


@query("dd3_latest_by_queue", f"WITH {Q} SELECT entity_id, queue_type, status, event_id FROM q {_TOP.format(keys='entity_id, queue_type', first='')}")
def dd3(spark, sf):
    return latest_per(queue_log(spark, sf), ["entity_id", "queue_type"]).select("entity_id", "queue_type", "status", "event_id")


def latest_recent(log: DataFrame, end: Column, days: int = 7) -> DataFrame:
    return latest_per(log.filter((F.col("ts") < end) & (F.col("ts") >= end - F.expr(f"INTERVAL {days} DAYS"))), ["entity_id"])


@query("dd4_latest_recent", f"WITH {Q} SELECT entity_id, event_id FROM q WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-18' {_TOP.format(keys='entity_id', first='')}")
def dd4(spark, sf):
    return latest_recent(queue_log(spark, sf), F.lit("2024-01-20").cast("timestamp"), 2).select("entity_id", "event_id")


@query("dd4_latest_today", f"WITH {Q} SELECT entity_id, event_id FROM q WHERE CAST(lts AS DATE) = DATE '2024-01-15' {_TOP.format(keys='entity_id', first='')}")
def dd4b(spark, sf):
    return latest_per(queue_log(spark, sf).filter(F.to_date("lts") == F.lit("2024-01-15").cast("date")), ["entity_id"]).select("entity_id", "event_id")


@query("dd5_duplicate_schedules", "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def dd5(spark, sf):
    return first_per(read(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey")


def schedule_priority(kind: Column, gap: Column) -> Column:
    """Which of several rows of a park's day holds: open, really shut, shut by a filled gap, unknown."""
    return F.when(kind == "OPERATING", 0).when((kind == "CLOSED") & ~gap, 1).when(kind == "CLOSED", 2).otherwise(3)


@query("dd6_conflicting_schedules", f"WITH {Q} SELECT park_id, strftime(lts, '%Y-%m-%d') AS date, status, event_id FROM q QUALIFY row_number() OVER (PARTITION BY park_id, CAST(lts AS DATE) ORDER BY CASE WHEN status = 'OPERATING' AND wait > 300 THEN 0 WHEN status = 'CLOSED' AND wait % 2 = 0 THEN 1 WHEN status = 'CLOSED' THEN 2 ELSE 3 END, event_id) = 1")
def dd6(spark, sf):
    log = queue_log(spark, sf).withColumn("date", F.date_format("lts", "yyyy-MM-dd"))
    kind = F.when((F.col("status") == "OPERATING") & (F.col("wait") > 300), "OPERATING").when(F.col("status") == "CLOSED", "CLOSED").otherwise("UNKNOWN")
    return first_per(log, ["park_id", "date"], schedule_priority(kind, F.col("wait") % 2 != 0), "event_id").select("park_id", "date", "status", "event_id")


@query("dd7_rollup_duplicates", f"WITH {Q} SELECT entity_id, strftime(ts, '%Y-%m-%d %H') AS hour, event_id FROM q QUALIFY row_number() OVER (PARTITION BY entity_id, date_trunc('hour', ts) ORDER BY CASE WHEN status = 'DOWN' THEN NULL ELSE ts END DESC NULLS LAST, event_id) = 1")
def dd7(spark, sf):
    log = queue_log(spark, sf).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")).withColumn("updated", F.when(F.col("status") != "DOWN", F.col("ts")))
    return first_per(log, ["entity_id", "hour"], F.desc_nulls_last("updated"), "event_id").select("entity_id", "hour", "event_id")


def last_of_poll(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows of one poll the last of each key: an aggregation, so copies are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


@query("dd8_last_of_poll", f"WITH {Q} SELECT entity_id, queue_type, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM q GROUP BY 1, 2")
def dd8(spark, sf):
    return last_of_poll(queue_log(spark, sf).select("entity_id", "queue_type", "status", "event_id"), ["entity_id", "queue_type"], "event_id")


@query("dd9_first_of_duplicates", f"WITH {Q} SELECT entity_id, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM q GROUP BY 1, 2")
def dd9(spark, sf):
    return first_per(queue_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["entity_id", "day"], "event_id").select("entity_id", "day", "event_id")


def changes_only(log: DataFrame, value: Column) -> DataFrame:
    """Rows whose value differs from that of the row before, and the first of each ride."""
    before = F.lag("_v").over(Window.partitionBy("entity_id").orderBy("ts", "event_id"))
    return log.withColumn("_v", value).withColumn("_b", before).filter(~F.col("_v").eqNullSafe(F.col("_b"))).drop("_b")


@query("dd10_sparkline", f"WITH {Q}, v AS (SELECT *, CAST(floor((wait + 2.5) / 5) * 5 AS INT) AS w5 FROM op) SELECT entity_id, event_id, w5 FROM v QUALIFY w5 IS DISTINCT FROM lag(w5) OVER (PARTITION BY entity_id ORDER BY ts, event_id)")
def dd10(spark, sf):
    from queuelake.operators.rollup import round5

    return changes_only(standby_operating(queue_log(spark, sf)), round5(F.col("wait"))).select("entity_id", "event_id", F.col("_v").alias("w5"))


def replace_window(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held without the rows whose key new has, and new."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


@query("dd11_replace_overlapping", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders a WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderstatus = 'F' AND a.o_custkey = b.o_custkey)")
def dd11(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return replace_window(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), ["o_custkey"]).drop("o_orderstatus")


@query("dd13_duplicate_keys", f"WITH {Q} SELECT entity_id, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM q GROUP BY 1, 2 HAVING count(*) > 1")
def dd13(spark, sf):
    return queue_log(spark, sf).groupBy("entity_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def listing(log: DataFrame, least: int) -> DataFrame:
    """The latest row of each ride, the regular queue first, of running rides with a wait of at least ``least``, longest first."""
    now = latest_per(log, ["entity_id"], F.col("queue_type") != "STANDBY")
    return now.filter((F.col("status") == "OPERATING") & (F.col("wait") >= least)).orderBy(F.desc("wait"), "entity_id")


@query("dd14_listing", f"WITH {Q}, l AS (SELECT * FROM q {_TOP.format(keys='entity_id', first='(queue_type <> $$STANDBY$$), ')}) SELECT entity_id, park_id, wait FROM l WHERE status = 'OPERATING' AND wait >= 100")
def dd14(spark, sf):
    return listing(queue_log(spark, sf), 100).select("entity_id", "park_id", "wait")


def survivor(rows: DataFrame, group: list[str], *rank: str) -> DataFrame:
    """Of duplicates the one that ranks highest, lexicographically."""
    return rows.groupBy(*group).agg(F.max(F.struct(*rank)).alias("best")).select(*group, "best.*")


@query("dd16_survivor", "SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1")
def dd16(spark, sf):
    return survivor(read(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")


@query("flt4_open_days", f"WITH {Q}, {SCHED} SELECT o.event_id FROM op o LEFT JOIN sched s ON o.park_id = s.park_id AND CAST(o.lts AS DATE) = s.date WHERE type IS NULL OR type IN ('OPERATING', 'UNKNOWN')")
def flt4(spark, sf):
    s = schedules(spark, sf).select("park_id", F.col("date").alias("day"), "type")
    rows = standby_operating(queue_log(spark, sf)).withColumn("day", F.to_date("lts")).join(s, ["park_id", "day"], "left")
    return rows.filter(F.col("type").isNull() | F.col("type").isin("OPERATING", "UNKNOWN")).select("event_id")
