"""Sinks: append with quarantine, keyed writes, updates, deletes by day, logs. Tables are folders of Parquet.

A keyed write makes a new version of the table beside the old one and then moves the pointer (current.txt, a text file of the version's name), so readers
and a writer that fails half-way see a whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelake.plans.adaptor import Q, queue_log, read
from queuelake.registry import query


def split_bad(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be inserted, and those for the quarantine; a condition that is null is not met."""
    ok = F.coalesce(good, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def append(rows: DataFrame, good: Column, path: str, quarantine: str) -> None:
    ok, bad = split_bad(rows, good)
    ok.write.mode("append").parquet(path)
    bad.write.mode("append").parquet(quarantine)


def upserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held with the rows of new in place of those of the same keys."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").select(held.columns).unionByName(new.select(held.columns))


def inserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held and those rows of new whose keys it lacks."""
    return held.unionByName(new.join(held.select(*keys).distinct(), keys, "left_anti").select(held.columns))


def updated(held: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """held with non-null changes of some columns."""
    c = changes.select(key, *(F.col(x).alias(f"_{x}") for x in columns))
    out = held.join(c, key, "left")
    return out.withColumns({x: F.coalesce(f"_{x}", x) for x in columns}).select(held.columns)


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> DataFrame | None:
    fs, at = _pointer(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.parquet(f"{path}/{spark.read.text(at.toString()).first().value}")


def replace(spark: SparkSession, path: str, rows: DataFrame) -> None:
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    fs, at = _pointer(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(version.encode()))
    out.close()


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    held = current(spark, path)
    replace(spark, path, new if held is None else upserted(held, new, keys))


def purge_before(spark: SparkSession, path: str, day_column: str, day: str) -> int:
    """Delete rows of days before ``day``; their number."""
    held = current(spark, path)
    old = F.col(day_column) < day
    n = held.filter(old).count()
    if n:
        replace(spark, path, held.filter(~old | F.col(day_column).isNull()))
    return n


def save_tensor(spark: SparkSession, path: str, cells: DataFrame, axes: tuple[str, ...] = ("entity_id", "slot")) -> None:
    """A tensor in long form, a row a cell and a column a channel; cells sorted by the axes within files, so a range of an axis reads few row groups."""
    replace(spark, path, cells.repartitionByRange(*axes).sortWithinPartitions(*axes))


def load_tensor(spark: SparkSession, path: str, channels: list[str] | None = None, axes: tuple[str, ...] = ("entity_id", "slot")) -> DataFrame:
    """The cells of ``save_tensor``, of some channels alone if they are named: the others aren't read."""
    held = current(spark, path)
    if held is None:
        raise FileNotFoundError(path)
    return held.select(*axes, *channels) if channels else held


def log_lines(rows: DataFrame, path: str) -> None:
    """Append as JSON lines."""
    rows.write.mode("append").json(path)


@query("snk1_quarantine", f"WITH {Q} SELECT event_id, coalesce(wait < 400 AND status <> 'DOWN', false) AS inserted FROM q")
def snk1(spark, sf):
    ok, bad = split_bad(queue_log(spark, sf), (F.col("wait") < 400) & (F.col("status") != "DOWN"))
    return ok.select("event_id", F.lit(True).alias("inserted")).unionByName(bad.select("event_id", F.lit(False).alias("inserted")))


@query("snk2_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def snk2(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return upserted(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("snk3_insert_ignore", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def snk3(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return inserted(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), ["o_orderkey"])


@query("snk6_update_from_arrays", "SELECT s_suppkey, CASE s_suppkey WHEN 1 THEN 10.5 WHEN 5 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def snk6(spark, sf):
    changes = spark.range(1).select(F.inline(F.arrays_zip(F.array(F.lit(1), F.lit(5), F.lit(7)).alias("s_suppkey"), F.array(F.lit(10.5), F.lit(0.0), F.lit(None)).alias("s_acctbal"))))
    held = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return updated(held, changes.withColumn("s_suppkey", F.col("s_suppkey").cast("long")), "s_suppkey", ["s_acctbal"])


@query("upd1_past_rows", f"WITH {Q} SELECT event_id, CAST(lts AS DATE) < DATE '2024-01-20' AS historical FROM q")
def upd1(spark, sf):
    return queue_log(spark, sf).select("event_id", (F.to_date("lts") < F.lit("2024-01-20").cast("date")).alias("historical"))
