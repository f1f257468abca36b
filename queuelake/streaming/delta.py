"""Delta compression and heartbeats, in batch and as a stream.

A row is kept if its ride has none before, or its status, wait or local date changed, or the last *kept* row is over an hour old. As that depends on
what was kept, it is a fold, not a window function. In batch, rows are sorted by ride and time inside partitions and folded in one pass that carries
one row, so a ride with a third of all rows needs no more memory than any other. As a stream, the last kept row is the state of the ride.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from queuelake.plans.adaptor import queue_log
from queuelake.registry import query

MOST_MINUTES, CLIP = 60, 360
COLS = ["event_id", "entity_id", "queue_type", "ts", "day", "status", "wait"]
SCHEMA = "event_id long, entity_id long, queue_type string, ts timestamp, day string, status string, wait int"


def plain(log: DataFrame, clip: int = CLIP) -> DataFrame:
    """The columns of the fold; implausible waits are clipped."""
    return log.select("event_id", "entity_id", "queue_type", F.col("ts").cast("timestamp").alias("ts"), F.date_format("lts", "yyyy-MM-dd").alias("day"), "status", F.least("wait", F.lit(clip)).alias("wait"))


def significant(last: tuple | None, now: tuple) -> bool:
    """last and now: (ts, day, status, wait)."""
    if last is None or last[1:] != now[1:]:
        return True
    return (now[0] - last[0]).total_seconds() > MOST_MINUTES * 60


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, last = None, None
    for rows in batches:
        keep = []
        for i, (ride, kind, ts, day, status, wait) in enumerate(zip(rows.entity_id, rows.queue_type, rows.ts, rows.day, rows.status, rows.wait)):
            if (ride, kind) != key:
                key, last = (ride, kind), None
            now = (ts, day, status, None if pd.isna(wait) else int(wait))
            if significant(last, now):
                keep.append(i)
                last = now
        yield rows.iloc[keep]


def compressed(log: DataFrame) -> DataFrame:
    """The rows that are kept."""
    dealt = plain(log).repartition("entity_id", "queue_type").sortWithinPartitions("entity_id", "queue_type", "ts", "event_id")
    return dealt.mapInPandas(_fold, SCHEMA)


STATE = "ts timestamp, day string, status string, wait int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = None
    if state.exists:
        ts, day, status, wait = state.get
        last = (pd.Timestamp(ts), day, status, None if wait is None or pd.isna(wait) else int(wait))
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    keep = []
    for i, (ts, day, status, wait) in enumerate(zip(rows.ts, rows.day, rows.status, rows.wait)):
        now = (ts, day, status, None if pd.isna(wait) else int(wait))
        if significant(last, now):
            keep.append(i)
            last = now
    if last is not None:
        state.update((last[0].to_pydatetime(), *last[1:]))
    yield rows.iloc[keep][COLS]


def compressed_stream(stream: DataFrame) -> DataFrame:
    """stream: rows as of ``plain``, in order of time from batch to batch -> the rows that are kept."""
    return stream.groupBy("entity_id", "queue_type").applyInPandasWithState(_advance, SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)


def heartbeats(latest: DataFrame, open_parks: DataFrame, now, most_minutes: int = 60, seen_hours: int = 24) -> DataFrame:
    """The last row of each ride of an open park again, at ``now``, if it is over an hour old but of the last day."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 60
    due = latest.join(open_parks, "park_id", "left_semi").filter((age > most_minutes) & (age <= seen_hours * 60))
    return due.withColumn("ts", now)


def rollup_stream(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly mean and count of each ride from a stream of rows, final once the watermark has passed."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "entity_id").agg(F.avg("wait").alias("mean"), F.count(F.lit(1)).alias("n"))


def upsert_batches(path: str, keys: list[str]):
    """A foreachBatch function that writes each batch over the rows of the same keys: a batch that comes twice changes nothing."""
    from queuelake.sources.sinks import upsert

    def put(batch: DataFrame, epoch: int) -> None:
        upsert(batch.sparkSession, path, batch, keys)

    return put


@query("st1_delta_compression")
def st1(spark, sf):
    return compressed(queue_log(spark, sf))


from queuelake.operators.latest import latest_per  # noqa: E402
from queuelake.operators.rollup import SCHED  # noqa: E402
from queuelake.operators.stats import OPEN, _open  # noqa: E402
from queuelake.plans.adaptor import Q  # noqa: E402


@query("st3_heartbeats", f"WITH {Q}, {SCHED}, {OPEN}, l AS (SELECT * FROM q WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1) SELECT entity_id, status, wait, '2024-01-20 12:00' AS at FROM l WHERE park_id IN (SELECT park_id FROM open) AND floor(epoch(TIMESTAMP '2024-01-20 12:00:00') - floor(epoch(ts))) / 60 > 60 AND floor(epoch(TIMESTAMP '2024-01-20 12:00:00') - floor(epoch(ts))) / 60 <= 1440")
def st3(spark, sf):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    last = latest_per(queue_log(spark, sf).filter(F.col("ts") <= now), ["entity_id"])
    return heartbeats(last, _open(spark, sf), now).select("entity_id", "status", "wait", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


@query("st6_clipped_waits", f"WITH {Q} SELECT event_id, least(wait, 360) AS wait FROM q")
def st6(spark, sf):
    return plain(queue_log(spark, sf)).select("event_id", "wait")


@query("st8_daily_decay", "SELECT user_id, round(sum(pow(0.9, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31'))), 4) AS score, count(*) AS hits FROM events GROUP BY 1")
def st8(spark, sf):
    """Day by day: yesterday's score times the rate, plus today's hits; as one sum, since decay is linear."""
    from queuelake.plans.adaptor import r4, read

    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return read(spark, sf, "events").groupBy("user_id").agg(r4(F.sum(F.pow(F.lit(0.9), days))).alias("score"), F.count(F.lit(1)).alias("hits"))


def changed_rows(log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Delta rule of shows and restaurants: rows of which any field differs from the row before, arrays included."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    now = F.struct(*fields)
    return log.withColumn("_b", F.lag(now).over(w)).filter(F.col("_b").isNull() | (F.to_json(now) != F.to_json("_b"))).drop("_b")


@query("st9_show_changes", f"WITH {Q}, b AS (SELECT event_id, entity_id, ts, status, [wait // 200, entity_id % 3] AS times, strftime(lts, '%Y-%m-%d') AS day FROM q), l AS (SELECT *, lag(status || times::VARCHAR || day) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS p FROM b) SELECT event_id FROM l WHERE p IS NULL OR p <> status || times::VARCHAR || day")
def st9(spark, sf):
    log = queue_log(spark, sf).withColumns({"times": F.array(F.floor(F.col("wait") / 200), F.col("entity_id") % 3), "day": F.date_format("lts", "yyyy-MM-dd")})
    return changed_rows(log, ["entity_id"], ["status", "times", "day"]).select("event_id")
