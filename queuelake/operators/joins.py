"""Joins: dimensions, derived dates, intervals, and the nearest in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.operators.latest import first_per, latest_per
from queuelake.operators.rollup import SCHED, schedules, standby_operating
from queuelake.plans.adaptor import AS_OF, Q, queue_log, r4, read, zone_of
from queuelake.registry import query


@query("jn1_fact_dimensions", "SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def jn1(spark, sf):
    o, c, n, r = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def with_default(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    return rows.join(lookup.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


@query("jn2_left_default", "SELECT c_custkey, coalesce(s, 0) AS spent FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def jn2(spark, sf):
    spent = read(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return with_default(read(spark, sf, "customer").select("c_custkey"), spent, ["c_custkey"], "spent", 0.0)


def on_local_day(rows: DataFrame, schedule: DataFrame, zone: Column) -> DataFrame:
    """The park's schedule row of each row's local day: the day is derived first, so the join is an equi-join."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    return rows.withColumn("day", day).join(schedule.withColumnRenamed("date", "day"), ["park_id", "day"], "left")


@query("jn3_schedule_of_local_day", f"WITH {Q}, {SCHED} SELECT event_id, type, n FROM q LEFT JOIN sched s ON q.park_id = s.park_id AND CAST(lts AS DATE) = s.date AND s.type <> 'INFO'")
def jn3(spark, sf):
    return on_local_day(queue_log(spark, sf), schedules(spark, sf).filter("type <> 'INFO'"), zone_of(F.col("park_id"))).select("event_id", "type", "n")


@query("jn4_latest_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey")
def jn4(spark, sf):
    last = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return read(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("jn5_one_row_rule", "SELECT p_partkey, p_retailprice FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part) WHERE p_retailprice > m + 1.5 * s")
def jn5(spark, sf):
    p = read(spark, sf, "part")
    rule = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return p.crossJoin(F.broadcast(rule)).filter("p_retailprice > m + 1.5 * s").select("p_partkey", "p_retailprice")


@query("jn6_unnest_slots", f"WITH {Q}, d AS (SELECT entity_id, list({{'h': hour(lts), 'w': wait}} ORDER BY event_id) AS slots FROM op GROUP BY 1), u AS (SELECT entity_id, unnest(slots) AS s FROM d) SELECT entity_id, CAST(s.h AS INT) AS hour, max(s.w) AS top, count(*) AS n FROM u GROUP BY 1, 2")
def jn6(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.hour("lts").alias("h"), F.col("wait").alias("w")))).alias("slots"))
    return rows.select("entity_id", F.inline("slots")).groupBy("entity_id", F.col("h").alias("hour")).agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("n"))


def by_segment(rows: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """A row for each segment that it is in: an explosion of an array, not a join."""
    inside = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in segments.items())), lambda s: s.isNotNull())
    return rows.withColumn("segment", F.explode(inside))


@query("jn7_segments", f"WITH {Q} SELECT seg AS segment, count(*) AS n, round(avg(wait), 4) AS mean FROM op, (VALUES ('all'), ('busy'), ('even')) s(seg) WHERE seg = 'all' OR (seg = 'busy' AND wait >= 300) OR (seg = 'even' AND entity_id % 2 = 0) GROUP BY 1")
def jn7(spark, sf):
    rows = by_segment(standby_operating(queue_log(spark, sf)), {"all": F.lit(True), "busy": F.col("wait") >= 300, "even": F.col("entity_id") % 2 == 0})
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("wait")).alias("mean"))


@query("jn8_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn8(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("jn9_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def jn9(spark, sf):
    keys = read(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    return read(spark, sf, "orders").join(keys, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


def stale_days(rides: DataFrame, open_days: DataFrame) -> DataFrame:
    """rides (park_id, entity_id, last_day): its park's open days after the last day it was seen."""
    rows = rides.join(open_days.select("park_id", "day"), "park_id", "left").groupBy("park_id", "entity_id")
    return rows.agg(F.count_if(F.col("day") > F.col("last_day")).alias("stale"))


@query("jn10_stale_days", f"WITH {Q}, l AS (SELECT park_id, entity_id, max(CAST(lts AS DATE)) AS last_day FROM op WHERE wait > 300 GROUP BY 1, 2), d AS (SELECT DISTINCT park_id, CAST(lts AS DATE) AS day FROM op) SELECT l.park_id, entity_id, count(*) FILTER (day > last_day) AS stale FROM l LEFT JOIN d ON l.park_id = d.park_id GROUP BY 1, 2")
def jn10(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    rides = rows.filter("wait > 300").groupBy("park_id", "entity_id").agg(F.max(F.to_date("lts")).alias("last_day"))
    return stale_days(rides, rows.select("park_id", F.to_date("lts").alias("day")).distinct())


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, seconds: int, value: list[str], tie: str = "ts") -> DataFrame:
    """The row of ``right`` that is nearest in time to ``at``, within a tolerance; the earlier one on ties.

    Time is cut into buckets as wide as the tolerance: a left row looks into its own and the two beside it, which is an equi-join on key and
    bucket, so no row meets more of the other side than lies within three buckets, and a hot key is spread over its buckets.
    left needs a unique ``left_id``.
    """
    sec = lambda c: F.unix_micros(c) / 1e6
    a = left.withColumn("_at", sec(F.col(at))).withColumn("_b", F.explode(F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda k: F.floor(F.col("_at") / seconds) + k)))
    b = right.select(*keys, F.col("ts").alias("_ts"), *value, F.floor(sec(F.col("ts")) / seconds).alias("_b")).withColumn("_t", sec(F.col("_ts")))
    met = a.join(b, [*keys, "_b"]).withColumn("gap", F.abs(F.col("_t") - F.col("_at"))).filter(F.col("gap") <= seconds)
    best = met.groupBy("left_id").agg(F.min_by(F.struct("gap", "_ts", *value), F.struct("gap", "_t", *value)).alias("m"))
    return left.join(best, "left_id", "left").select(*left.columns, "m.gap", F.col("m._ts").alias("matched"), *(f"m.{v}" for v in value))


PRED = f"""pred AS (SELECT event_id, entity_id, ts, value FROM q WHERE event_type = 'view'), act AS (SELECT event_id AS a_id, entity_id, ts AS a_ts, value AS a_value FROM q WHERE event_type = 'click'),
near AS (SELECT p.event_id, p.entity_id, p.ts, p.value, a_id, a_value, a_ts FROM pred p JOIN act a ON p.entity_id = a.entity_id AND abs(epoch(a_ts) - epoch(ts)) <= {{tol}} QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch(a_ts) - epoch(ts)), a_ts, a_id) = 1)"""


def predictions(spark, sf) -> tuple[DataFrame, DataFrame]:
    log = queue_log(spark, sf)
    made = log.filter("event_type = 'view'").select(F.col("event_id").alias("left_id"), "entity_id", F.col("ts").alias("target"), F.col("value").alias("predicted"))
    return made, log.filter("event_type = 'click'").select("entity_id", "ts", F.col("event_id").alias("actual_id"), F.col("value").alias("actual"))


def compared(spark, sf, seconds: int = 7200) -> DataFrame:
    """Predictions with the nearest observation."""
    made, seen = predictions(spark, sf)
    return nearest(made, seen, ["entity_id"], "target", seconds, ["actual_id", "actual"])


@query("jn11_nearest_observation", f"WITH {Q}, {PRED.format(tol=7200)} SELECT p.event_id AS left_id, p.entity_id, p.value AS predicted, a_id AS actual_id, a_value AS actual FROM pred p LEFT JOIN near n ON p.event_id = n.event_id")
def jn11(spark, sf):
    return compared(spark, sf).select("left_id", "entity_id", "predicted", "actual_id", "actual")


def lagged(log: DataFrame, hours: int, tolerance: int) -> DataFrame:
    """The value of the same ride nearest to some hours before each row."""
    rows = log.select(F.col("event_id").alias("left_id"), "entity_id", (F.col("ts") - F.make_interval(hours=F.lit(hours))).alias("target"))
    return nearest(rows, log.select("entity_id", "ts", F.col("event_id").alias("lag_id"), F.col("wait").alias("lag_wait")), ["entity_id"], "target", tolerance, ["lag_id", "lag_wait"]).select("left_id", "lag_id", "lag_wait")


@query("jn12_lag_a_day", f"WITH {Q} SELECT a.event_id AS left_id, b.event_id AS lag_id, b.wait AS lag_wait FROM op a LEFT JOIN op b ON a.entity_id = b.entity_id AND abs(epoch(b.ts) - epoch(a.ts) + 86400) <= 3600 QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch(b.ts) - epoch(a.ts) + 86400), b.ts, b.event_id) = 1")
def jn12(spark, sf):
    return lagged(standby_operating(queue_log(spark, sf)), 24, 3600)


def days_to_and_since(days: DataFrame, events: DataFrame, keys: list[str], most: int = 7) -> DataFrame:
    """days (keys, day), events (keys, day): days until the next and since the last event, at most ``most``; windows over the union, no range join."""
    both = days.select(*keys, "day", F.lit(False).alias("e")).distinct().unionByName(events.select(*keys, "day", F.lit(True).alias("e")).distinct())
    w = Window.partitionBy(*keys).orderBy("day")
    on = F.when(F.col("e"), F.col("day"))
    back = F.max(on).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(on).over(w.rangeBetween(0, Window.unboundedFollowing))
    clip = lambda c: F.least(F.coalesce(c, F.lit(most)), F.lit(most))
    return both.withColumns({"since": clip(F.datediff("day", back)), "until": clip(F.datediff(ahead, "day"))}).filter(~F.col("e")).drop("e")


@query("jn13_days_to_holiday", f"WITH {Q}, d AS (SELECT DISTINCT park_id, CAST(lts AS DATE) AS day FROM op), h AS (SELECT DISTINCT park_id, CAST(lts AS DATE) AS hday FROM q WHERE status = 'DOWN' AND wait > 470) SELECT d.park_id, strftime(day, '%Y-%m-%d') AS day, CAST(least(coalesce(min(day - hday) FILTER (hday <= day), 7), 7) AS INT) AS since, CAST(least(coalesce(min(hday - day) FILTER (hday >= day), 7), 7) AS INT) AS until FROM d LEFT JOIN h ON d.park_id = h.park_id GROUP BY d.park_id, day")
def jn13(spark, sf):
    log = queue_log(spark, sf).withColumn("day", F.to_date("lts"))
    out = days_to_and_since(standby_operating(log).select("park_id", "day"), log.filter("status = 'DOWN' AND wait > 470"), ["park_id"])
    return out.select("park_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "since", "until")


def at_lead(forecasts: DataFrame, leads: list[float], tolerance: float = 0.5) -> DataFrame:
    """forecasts (key, target, lead_h, ...): of each key, target and wanted lead, the one made nearest to it."""
    rows = forecasts.withColumn("lead", F.explode(F.array(*(F.lit(x) for x in leads)))).withColumn("off", F.abs(F.col("lead_h") - F.col("lead"))).filter(F.col("off") <= tolerance)
    return first_per(rows, ["entity_id", "target_id", "lead"], "off", F.desc("lead_h"), "event_id")


_FC = "fc AS (SELECT a.event_id AS target_id, a.entity_id, a.ts AS target, a.value AS actual, b.event_id, b.value AS forecast, (epoch(a.ts) - epoch(b.ts)) / 3600 AS lead_h FROM q a JOIN q b ON a.entity_id = b.entity_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 48 HOUR WHERE a.event_type = 'click' AND b.event_type = 'view')"


def forecasts(spark, sf, hours: int = 48) -> DataFrame:
    """A ride's views of the last hours as forecasts of its clicks."""
    log = queue_log(spark, sf)
    a = log.filter("event_type = 'click'").select(F.col("event_id").alias("target_id"), "entity_id", F.col("ts").alias("target"), F.col("value").alias("actual"))
    b = log.filter("event_type = 'view'").select("event_id", "entity_id", F.col("ts").alias("made"), F.col("value").alias("forecast"))
    return made_before(a, b, ["entity_id"], hours)


def made_before(targets: DataFrame, made: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Pairs of targets (target) and rows made (made) up to some hours before, with their lead: an equi-join on key and time bucket."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (hours * 3_600_000_000))
    a = targets.withColumn("_b", F.explode(F.array(bucket(F.col("target")) - 1, bucket(F.col("target")))))
    lead = (F.unix_micros("target") - F.unix_micros("made")) / 3.6e9
    return a.join(made.withColumn("_b", bucket(F.col("made"))), [*keys, "_b"]).drop("_b").withColumn("lead_h", lead).filter((F.col("lead_h") > 0) & (F.col("lead_h") <= hours))


@query("jn14_forced_lead", f"WITH {Q}, {_FC} SELECT target_id, CAST(l AS DOUBLE) AS lead, event_id FROM fc, (VALUES (1), (3), (6)) t(l) WHERE abs(lead_h - l) <= 0.5 QUALIFY row_number() OVER (PARTITION BY target_id, l ORDER BY abs(lead_h - l), lead_h DESC, event_id) = 1")
def jn14(spark, sf):
    return at_lead(forecasts(spark, sf), [1.0, 3.0, 6.0]).select("target_id", "lead", "event_id")


@query("jn15_freshest_before", f"WITH {Q}, {_FC} SELECT target_id, event_id, forecast FROM fc QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY lead_h, event_id) = 1")
def jn15(spark, sf):
    return first_per(forecasts(spark, sf), ["target_id"], "lead_h", "event_id").select("target_id", "event_id", "forecast")


def matched_population(a: DataFrame, b: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that both models and the actuals have: n is the same for each."""
    return a.join(b, keys).join(actual, keys)


@query("jn16_matched_models", f"WITH {Q}, day AS (SELECT entity_id, CAST(ts AS DATE) AS d, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b, avg(value) FILTER (event_type = 'purchase') AS y FROM q GROUP BY 1, 2) SELECT count(*) AS n, round(avg(abs(a - y)), 4) AS mae_a, round(avg(abs(b - y)), 4) AS mae_b FROM day WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL")
def jn16(spark, sf):
    log = queue_log(spark, sf).withColumn("d", F.to_date("ts"))
    of = lambda kind, name: log.filter(F.col("event_type") == kind).groupBy("entity_id", "d").agg(F.avg("value").alias(name))
    rows = matched_population(of("view", "a"), of("click", "b"), of("purchase", "y"), ["entity_id", "d"])
    return rows.agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(F.col("a") - F.col("y")))).alias("mae_a"), r4(F.avg(F.abs(F.col("b") - F.col("y")))).alias("mae_b"))


def duplicate_pairs(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """Unordered pairs of rows that share a derived key."""
    a, b = rows.select(key, F.col(id_).alias("a")), rows.select(key, F.col(id_).alias("b"))
    return a.join(b, key).filter("a < b")


@query("jn17_duplicate_pairs", "WITH s AS (SELECT s_suppkey, regexp_replace(s_name, '[0-9]{1}$', '') || '|' || s_nationkey AS k FROM supplier) SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM s x JOIN s y ON x.k = y.k AND x.s_suppkey < y.s_suppkey")
def jn17(spark, sf):
    rows = read(spark, sf, "supplier").withColumn("k", F.concat_ws("|", F.regexp_replace("s_name", "[0-9]$", ""), "s_nationkey"))
    return duplicate_pairs(rows, "k", "s_suppkey").select("a", "b")


def regional_else_national(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows (nation, region, day), events (nation, region or null, day, name): the region's own event, else the nation's. Events are deduplicated first."""
    own = events.filter(F.col("region").isNotNull()).groupBy("nation", "region", "day").agg(F.min("name").alias("own"))
    whole = events.filter(F.col("region").isNull()).groupBy("nation", "day").agg(F.min("name").alias("whole"))
    return rows.join(own, ["nation", "region", "day"], "left").join(whole, ["nation", "day"], "left").withColumn("name", F.coalesce("own", "whole")).drop("own", "whole")


_HOL = "hol AS (SELECT user_id % 4 AS nation, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 8 END AS region, CAST(ts AS DATE) AS day, event_type AS name FROM events WHERE value > 460)"


@query("jn18_regional_holiday", f"WITH {_HOL}, r AS (SELECT DISTINCT user_id % 4 AS nation, user_id % 8 AS region, CAST(ts AS DATE) AS day FROM events), o AS (SELECT nation, region, day, min(name) AS name FROM hol WHERE region IS NOT NULL GROUP BY ALL), w AS (SELECT nation, day, min(name) AS name FROM hol WHERE region IS NULL GROUP BY ALL) SELECT r.nation, r.region, strftime(r.day, '%Y-%m-%d') AS day, coalesce(o.name, w.name) AS name FROM r LEFT JOIN o ON r.nation = o.nation AND r.region = o.region AND r.day = o.day LEFT JOIN w ON r.nation = w.nation AND r.day = w.day")
def jn18(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 4).alias("nation"), (F.col("user_id") % 8).alias("region"), F.to_date("ts").alias("day"), F.col("event_type").alias("name"), "value", "user_id")
    events = e.filter("value > 460").withColumn("region", F.when(F.col("user_id") % 3 != 0, F.col("region")))
    out = regional_else_national(e.select("nation", "region", "day").distinct(), events)
    return out.select("nation", "region", F.date_format("day", "yyyy-MM-dd").alias("day"), "name")


def neighbour_holidays(parks: DataFrame, events: DataFrame, flags: int = 3) -> DataFrame:
    """parks (park_id, neighbours array), events (region, day): how many distinct neighbours have one on a day, and whether the first few do."""
    near = parks.select("park_id", F.posexplode("neighbours").alias("pos", "region"))
    met = near.join(events.select("region", "day").distinct(), "region")
    first = [F.max((F.col("pos") == k).cast("int")).alias(f"neighbour_{k + 1}") for k in range(flags)]
    return met.groupBy("park_id", "day").agg(F.countDistinct("region").alias("n"), *first)


@query("jn19_neighbour_holidays", "WITH ev AS (SELECT DISTINCT user_id % 8 AS region, CAST(ts AS DATE) AS day FROM events WHERE value > 470), n AS (SELECT p AS park_id, k AS pos, (p + k + 1) % 8 AS region FROM range(8) a(p), range(4) b(k)) SELECT park_id, strftime(day, '%Y-%m-%d') AS day, count(DISTINCT region) AS n, max(CAST(pos = 0 AS INT)) AS neighbour_1, max(CAST(pos = 1 AS INT)) AS neighbour_2, max(CAST(pos = 2 AS INT)) AS neighbour_3 FROM n JOIN ev USING (region) GROUP BY 1, day")
def jn19(spark, sf):
    events = read(spark, sf, "events").filter("value > 470").select((F.col("user_id") % 8).alias("region"), F.to_date("ts").alias("day"))
    parks = spark.range(8).select(F.col("id").alias("park_id"), F.array(*((F.col("id") + k + 1) % 8 for k in range(4))).alias("neighbours"))
    return neighbour_holidays(parks, events).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def missing_in_poll(known: DataFrame, poll: DataFrame, now: Column, grace_hours: int) -> DataFrame:
    """Closed rows for rides that a poll lacks and that were last seen before the grace period."""
    gone = known.join(poll.select("entity_id").distinct(), "entity_id", "left_anti").filter(F.col("ts") < now - F.make_interval(hours=F.lit(grace_hours)))
    return gone.select("entity_id", F.lit("CLOSED").alias("status"), F.lit(None).cast("int").alias("wait"))


@query("jn25_missing_in_poll", f"WITH {Q}, l AS (SELECT entity_id, max(ts) AS ts FROM q WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT entity_id, 'CLOSED' AS status, CAST(NULL AS INT) AS wait FROM l WHERE ts < TIMESTAMP '2024-01-19 18:00:00' AND entity_id NOT IN (SELECT entity_id FROM q WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-20 03:00:00')")
def jn25(spark, sf):
    log = queue_log(spark, sf)
    now = F.lit("2024-01-20").cast("timestamp")
    known = latest_per(log.filter(F.col("ts") < now), ["entity_id"])
    return missing_in_poll(known, log.filter((F.col("ts") >= now) & (F.col("ts") < now + F.expr("INTERVAL 3 HOURS"))), now, 6)


def rewired(rows: DataFrame, merges: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """rows with ``key`` mapped from loser to winner; rows of losers whose unique key the winner already has go first."""
    to = rows.join(merges, F.col(key) == F.col("loser"), "left").withColumn("_new", F.coalesce("winner", key))
    rest = [c for c in unique if c != key]
    held = rows.select(F.col(key).alias("_new"), *rest).distinct().withColumn("_held", F.lit(True))
    out = to.join(held, ["_new", *rest], "left").filter(F.col("winner").isNull() | F.col("_held").isNull())
    return out.withColumn(key, F.col("_new")).select(rows.columns)


@query("jn26_rewire_keys", "WITH m AS (SELECT s_suppkey AS loser, s_suppkey - 1 AS winner FROM supplier WHERE s_suppkey % 10 = 9), l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT coalesce(winner, l_suppkey) AS l_suppkey, l_partkey FROM l LEFT JOIN m ON l_suppkey = loser WHERE winner IS NULL OR NOT EXISTS (SELECT 1 FROM l x WHERE x.l_suppkey = winner AND x.l_partkey = l.l_partkey)")
def jn26(spark, sf):
    merges = read(spark, sf, "supplier").filter("s_suppkey % 10 = 9").select(F.col("s_suppkey").alias("loser"), (F.col("s_suppkey") - 1).alias("winner"))
    return rewired(read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), merges, "l_suppkey", ["l_suppkey", "l_partkey"])


@query("flt6_interval_overlap", "SELECT o_custkey, min(o_orderdate) <= TIMESTAMP '1997-01-01' AND max(o_orderdate) >= TIMESTAMP '1996-06-01' AS overlaps FROM orders GROUP BY 1")
def flt6(spark, sf):
    spans = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.select("o_custkey", overlaps(F.col("a"), F.col("b"), F.lit("1996-06-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")).alias("overlaps"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start <= high) & (end >= low)


def covers(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (end >= at)


@query("flt7_point_in_interval", "WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT o_custkey FROM s WHERE a <= TIMESTAMP '1996-06-01' AND b >= TIMESTAMP '1996-06-01'")
def flt7(spark, sf):
    spans = read(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return spans.filter(covers(F.col("a"), F.col("b"), F.lit("1996-06-01").cast("timestamp_ntz"))).select("o_custkey")


@query("flt5_name_exclusion", "SELECT p_partkey FROM part WHERE p_name NOT ILIKE '%ring%' AND p_name NOT ILIKE '%gear%' AND p_name NOT ILIKE '%hot%'")
def flt5(spark, sf):
    return read(spark, sf, "part").filter(~F.lower("p_name").rlike("ring|gear|hot")).select("p_partkey")


@query("flt8_json_group", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def flt8(spark, sf):
    return read(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("flt9_null_safe", f"WITH {Q}, x AS (SELECT event_id, CASE WHEN entity_id % 3 = 0 THEN NULL ELSE wait % 4 END AS a, CASE WHEN entity_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS b FROM q) SELECT event_id FROM x WHERE a IS NOT DISTINCT FROM b")
def flt9(spark, sf):
    a, b = F.when(F.col("entity_id") % 3 != 0, F.col("wait") % 4), F.when(F.col("entity_id") % 5 != 0, F.col("event_id") % 4)
    return queue_log(spark, sf).filter(a.eqNullSafe(b)).select("event_id")


@query("flt12_excluded_entities", f"WITH {Q} SELECT event_id FROM q WHERE entity_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def flt12(spark, sf):
    gone = read(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("entity_id"))
    return queue_log(spark, sf).join(gone, "entity_id", "left_anti").select("event_id")


@query("flt11_active_parks", f"WITH {Q}, d AS (SELECT park_id, CAST(lts AS DATE) AS day, event_id, wait FROM op) SELECT event_id FROM d QUALIFY max(CAST(wait >= 480 AS INT)) OVER (PARTITION BY park_id, day) = 1")
def flt11(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).withColumn("day", F.to_date("lts"))
    return rows.withColumn("on", F.max(F.col("wait") >= 480).over(Window.partitionBy("park_id", "day"))).filter("on").select("event_id")


@query("scn1_range_scan", f"WITH {Q} SELECT event_id, entity_id, wait FROM op WHERE entity_id IN (3, 14, 15, 92) AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def scn1(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).filter(F.col("entity_id").isin(3, 14, 15, 92) & F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-19 23:59:59.999999").cast("timestamp")))
    return rows.orderBy("entity_id", "ts").select("event_id", "entity_id", "wait")


@query("scn2_paged_scan", f"WITH {Q} SELECT event_id, wait FROM q WHERE entity_id = 7 AND queue_type = 'STANDBY' AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 5")
def scn2(spark, sf):
    rows = queue_log(spark, sf).filter((F.col("entity_id") == 7) & (F.col("queue_type") == "STANDBY") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).offset(5).limit(10).select("event_id", "wait")


@query("scn3_rollup_lookup", f"WITH {Q} SELECT entity_id, CAST(hour(ts) AS INT) AS hour, count(*) AS n, round(avg(wait), 4) AS mean, CAST(date_diff('hour', date_trunc('hour', max(ts)), TIMESTAMP '{AS_OF}') AS BIGINT) AS hours_ago FROM op WHERE entity_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND hour(ts) IN (9, 12, 15) GROUP BY 1, 2")
def scn3(spark, sf):
    keys = read(spark, sf, "supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("entity_id"))
    rows = standby_operating(queue_log(spark, sf)).join(keys, "entity_id", "left_semi").withColumn("hour", F.hour("ts")).filter(F.col("hour").isin(9, 12, 15))
    ago = F.floor(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) / 3600) - F.floor(F.unix_timestamp(F.max("ts")) / 3600)
    return rows.groupBy("entity_id", "hour").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("wait")).alias("mean"), ago.cast("long").alias("hours_ago"))
