"""Live boards, seasons, openings and summaries by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.functions.ladders import crowd_level, crowd_score
from queuelake.operators.latest import first_per, latest_per
from queuelake.operators.rollup import SCHED, nearest_rank, percentile_of_percentiles, schedules, slot_profile, standby_operating  # noqa: F401
from queuelake.plans.adaptor import Q, queue_log, r4, read
from queuelake.registry import query

#: Fixed values of the open-park rule: hours of freshness and of movement, samples, share of rides with a queue, minutes of a queue.
FRESH_H, MOVE_H, SAMPLES, SHARE, QUEUE = 2, 4, 3, 0.25, 10


def at(ts: str) -> Column:
    return F.lit(ts).cast("timestamp")


def open_parks(log: DataFrame, schedule: DataFrame, now: Column, fresh_h: int = FRESH_H, move_h: int = MOVE_H, samples: int = SAMPLES, share: float = SHARE, queue: int = QUEUE) -> DataFrame:
    """Parks that are open now: their schedule says so; or, unless it says that they are shut, enough fresh rows have queues and the feed moves."""
    today = schedule.filter(F.col("date") == F.to_date(now))
    said = today.filter("type = 'OPERATING'").select("park_id")
    shut = today.filter("type = 'CLOSED'").select("park_id")
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600
    recent = log.withColumn("age", age).filter((F.col("age") >= 0) & (F.col("age") < move_h))
    fresh = (F.col("age") < fresh_h) & (F.col("status") == "OPERATING")
    act = recent.groupBy("park_id").agg(
        F.count_if(fresh).alias("n"), F.count_if(fresh & (F.col("wait") >= queue)).alias("busy"), F.countDistinct("entity_id", "wait", "status").alias("moves"), F.countDistinct("entity_id").alias("rides"),
    )
    lively = act.filter((F.col("n") >= samples) & (F.col("busy") >= share * F.col("n")) & (F.col("moves") > F.col("rides"))).select("park_id").join(shut, "park_id", "left_anti")
    return said.unionByName(lively).distinct()


_NOW = "TIMESTAMP '2024-01-20 12:00:00'"
OPEN = f"""today AS (SELECT * FROM sched WHERE date = DATE '2024-01-20'), act AS (SELECT park_id, count(*) FILTER (epoch({_NOW}) - epoch(ts) < 6 * 3600 AND status = 'OPERATING') AS n, count(*) FILTER (epoch({_NOW}) - epoch(ts) < 6 * 3600 AND status = 'OPERATING' AND wait >= 10) AS busy, count(DISTINCT (entity_id, wait, status)) AS moves, count(DISTINCT entity_id) AS rides
  FROM q WHERE ts <= {_NOW} AND epoch({_NOW}) - epoch(ts) < 24 * 3600 GROUP BY 1),
open AS (SELECT park_id FROM today WHERE type = 'OPERATING' UNION SELECT park_id FROM act WHERE n >= 3 AND busy >= 0.25 * n AND moves > rides AND park_id NOT IN (SELECT park_id FROM today WHERE type = 'CLOSED'))"""


def _open(spark, sf) -> DataFrame:
    return open_parks(queue_log(spark, sf), schedules(spark, sf), at("2024-01-20 12:00:00"), 6, 24)


@query("ag35_open_parks", f"WITH {Q}, {SCHED}, {OPEN} SELECT park_id FROM open")
def ag35(spark, sf):
    return _open(spark, sf)


def realtime(latest: DataFrame, open_: DataFrame) -> DataFrame:
    """One row for all open parks: rides, mean wait, the most crowded park, the longest and the shortest wait with their rides."""
    rows = latest.join(open_, "park_id", "left_semi").filter(F.col("status") == "OPERATING")
    parks = rows.groupBy("park_id").agg(F.round(F.avg("wait"), 6).alias("mean")).agg(F.count(F.lit(1)).alias("parks"), F.max_by("park_id", F.struct("mean", "park_id")).alias("fullest"))
    rides = rows.agg(F.count(F.lit(1)).alias("rides"), r4(F.avg("wait")).alias("mean"), F.max_by("entity_id", F.struct("wait", "entity_id")).alias("longest"), F.min_by("entity_id", F.struct("wait", "entity_id")).alias("shortest"))
    return rides.crossJoin(F.broadcast(parks))


_LAST = "last AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)"


@query("ag36_realtime", f"WITH {Q}, {SCHED}, {OPEN}, {_LAST}, r AS (SELECT * FROM last WHERE park_id IN (SELECT park_id FROM open) AND status = 'OPERATING'), p AS (SELECT park_id, round(avg(wait), 6) AS mean FROM r GROUP BY 1) SELECT count(*) AS rides, round(avg(wait), 4) AS mean, arg_max(entity_id, (wait, entity_id)) AS longest, arg_min(entity_id, (wait, entity_id)) AS shortest, (SELECT count(*) FROM p) AS parks, (SELECT arg_max(park_id, (mean, park_id)) FROM p) AS fullest FROM r")
def ag36(spark, sf):
    return realtime(latest_per(queue_log(spark, sf), ["entity_id"]), _open(spark, sf))


@query("ag37_geo_rollup", "SELECT r_name, n_name, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ag37(spark, sf):
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("c_acctbal")).alias("mean"))


@query("ag62_geo_tree", "WITH c AS (SELECT n_regionkey AS continent, n_nationkey AS country, avg(c_acctbal) AS m, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2) SELECT continent, CAST(sum(n) AS BIGINT) AS open, CAST(floor((sum(m) / count(*) + 2.5) / 5) * 5 AS INT) AS mean, string_agg(country || ':' || n, ',' ORDER BY country) AS countries FROM c GROUP BY 1")
def ag62(spark, sf):
    """Unweighted means of means, carried up as sums and counts, with the lower level nested."""
    rows = read(spark, sf, "customer").filter("c_acctbal > 0").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = rows.groupBy(F.col("n_regionkey").alias("continent"), F.col("n_nationkey").alias("country")).agg(F.avg("c_acctbal").alias("m"), F.count(F.lit(1)).alias("n"))
    nested = F.sort_array(F.collect_list(F.struct("country", "n")))
    mean = (F.floor((F.sum("m") / F.count(F.lit(1)) + 2.5) / 5) * 5).cast("int")
    return c.groupBy("continent").agg(F.sum("n").alias("open"), mean.alias("mean"), F.array_join(F.transform(nested, lambda s: F.concat_ws(":", s["country"], s["n"])), ",").alias("countries"))


@query("ag30_park_history", f"WITH {Q}, rd AS (SELECT park_id, entity_id, CAST(lts AS DATE) AS day, quantile_cont(wait, 0.9) AS p FROM op GROUP BY 1, 2, 3), d AS (SELECT park_id, day, avg(p) AS m FROM rd GROUP BY 1, 2), s AS (SELECT park_id, CAST(extract(dow FROM day) AS INT) AS dow, avg(m) AS m, count(*) AS days FROM d GROUP BY 1, 2) SELECT park_id, dow, round(m, 4) AS mean, days, round(least(greatest(m / 100, 1.0), 5.0), 1) AS score, CASE WHEN m / 2 <= 60 THEN 'very_low' WHEN m / 2 <= 89 THEN 'low' WHEN m / 2 <= 110 THEN 'moderate' WHEN m / 2 <= 150 THEN 'high' WHEN m / 2 <= 200 THEN 'very_high' ELSE 'extreme' END AS level FROM s")
def ag30(spark, sf):
    rd = standby_operating(queue_log(spark, sf)).groupBy("park_id", "entity_id", F.to_date("lts").alias("day")).agg(F.percentile("wait", F.lit(0.9)).alias("p"))
    s = rd.groupBy("park_id", "day").agg(F.avg("p").alias("m")).groupBy("park_id", (F.dayofweek("day") - 1).alias("dow")).agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("days"))
    return s.select("park_id", "dow", r4(F.col("m")).alias("mean"), "days", crowd_score(F.col("m") / 10).alias("score"), crowd_level(F.col("m") / 2).alias("level"))


_SOLD = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


@query("ag33_country_summary", f"""WITH m AS (SELECT n_regionkey, month(o_orderdate) AS month, round(avg(o_totalprice), 2) AS v {_SOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY v DESC, month) AS hi, row_number() OVER (PARTITION BY n_regionkey ORDER BY v, month) AS lo FROM m),
t AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY v DESC, c_custkey) AS k FROM (SELECT n_regionkey, c_custkey, max(o_totalprice) AS v {_SOLD})),
f AS (SELECT n_regionkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY k) AS top FROM t WHERE k <= 5 GROUP BY 1)
SELECT n_regionkey, string_agg(CAST(month AS VARCHAR), ',' ORDER BY hi) FILTER (hi <= 3) AS peak, string_agg(CAST(month AS VARCHAR), ',' ORDER BY lo) FILTER (lo <= 3) AS quiet, any_value(top) AS top
FROM r JOIN f USING (n_regionkey) GROUP BY 1 HAVING count(*) >= 6""")
def ag33(spark, sf):
    """The five customers of a region with the dearest orders, and its three peak and three quiet months if it has six. The window's rank is cut to five before the shuffle."""
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = rows.groupBy("n_regionkey", F.month("o_orderdate").alias("month")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    listed = lambda key, of, most: F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct(key.alias("k"), of))), 1, most), lambda s: s[of].cast("string")), ",")
    months = m.groupBy("n_regionkey").agg(listed(-F.col("v"), "month", 3).alias("peak"), listed(F.col("v"), "month", 3).alias("quiet"), F.count(F.lit(1)).alias("n")).filter("n >= 6").drop("n")
    best = rows.groupBy("n_regionkey", "c_custkey").agg(F.max("o_totalprice").alias("v"))
    five = best.withColumn("rank", F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("v"), "c_custkey"))).filter("rank <= 5")
    return months.join(five.groupBy("n_regionkey").agg(listed(F.col("rank"), "c_custkey", 5).alias("top")), "n_regionkey")


@query("ag39_crowd_level_of_day", f"WITH {Q}, d AS (SELECT park_id, CAST(lts AS DATE) AS day, quantile_cont(wait, 0.9) AS p FROM op GROUP BY 1, 2), b AS (SELECT park_id, quantile_cont(p, 0.5) AS base FROM d GROUP BY 1) SELECT d.park_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN x <= 60 THEN 'very_low' WHEN x <= 89 THEN 'low' WHEN x <= 110 THEN 'moderate' WHEN x <= 150 THEN 'high' WHEN x <= 200 THEN 'very_high' ELSE 'extreme' END AS level FROM (SELECT d.*, p / base * 100 AS x FROM d JOIN b USING (park_id)) d")
def ag39(spark, sf):
    d = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.to_date("lts").alias("day")).agg(F.percentile("wait", F.lit(0.9)).alias("p"))
    base = d.groupBy("park_id").agg(F.percentile("p", F.lit(0.5)).alias("base"))
    return d.join(base, "park_id").select("park_id", F.date_format("day", "yyyy-MM-dd").alias("day"), crowd_level(F.col("p") / F.col("base") * 100).alias("level"))


@query("ag41_operating_days", f"WITH {Q} SELECT park_id, strftime(lts, '%Y-%m-%d') AS day FROM op GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (wait >= 100) >= 0.3 * count(*)")
def ag41(spark, sf):
    d = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wait") >= 100).alias("busy"))
    return d.filter((F.col("n") >= 3) & (F.col("busy") >= 0.3 * F.col("n"))).select("park_id", "day")


@query("ag42_training_hours", f"WITH {Q}, {SCHED} SELECT o.entity_id, strftime(date_trunc('hour', lts), '%Y-%m-%d %H') AS hour, round(quantile_cont(wait, 0.5), 4) AS y, count(*) AS n, CAST(hour(min(lts)) AS INT) AS h, CAST(extract(dow FROM min(lts)) AS INT) AS dow, max(type) AS type FROM op o JOIN sched s ON o.park_id = s.park_id AND CAST(lts AS DATE) = s.date GROUP BY 1, 2")
def ag42(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).withColumn("date", F.to_date("lts")).join(schedules(spark, sf).select("park_id", "date", "type"), ["park_id", "date"])
    return rows.groupBy("entity_id", F.date_format("lts", "yyyy-MM-dd HH").alias("hour")).agg(r4(F.percentile("wait", F.lit(0.5))).alias("y"), F.count(F.lit(1)).alias("n"), F.hour(F.min("lts")).alias("h"), (F.dayofweek(F.min("lts")) - 1).alias("dow"), F.max("type").alias("type"))


@query("ag43_occupancy", f"WITH {Q}, b AS (SELECT park_id, avg(wait) AS base FROM op GROUP BY 1), h AS (SELECT park_id, CAST(lts AS DATE) AS day, hour(lts) AS h, avg(wait) AS m FROM op GROUP BY 1, 2, 3) SELECT h.park_id, CAST(extract(dow FROM day) AS INT) AS dow, CAST(h AS INT) AS hour, round(avg(least(greatest(m / base * 100, 0), 200)), 4) AS occupancy FROM h JOIN b USING (park_id) GROUP BY 1, 2, 3")
def ag43(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    base = rows.groupBy("park_id").agg(F.avg("wait").alias("base"))
    h = rows.groupBy("park_id", F.to_date("lts").alias("day"), F.hour("lts").alias("hour")).agg(F.avg("wait").alias("m")).join(base, "park_id")
    occ = F.least(F.greatest(F.col("m") / F.col("base") * 100, F.lit(0.0)), F.lit(200.0))
    return h.groupBy("park_id", (F.dayofweek("day") - 1).alias("dow"), "hour").agg(r4(F.avg(occ)).alias("occupancy"))


@query("ag44_climatology", f"WITH {Q}, c AS (SELECT park_id, month(lts) AS month, event_type, count(*) AS n FROM q GROUP BY 1, 2, 3), m AS (SELECT park_id, month, arg_max(event_type, (n, event_type)) AS usual FROM c GROUP BY 1, 2) SELECT q.park_id, CAST(month(lts) AS INT) AS month, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, max(usual) AS usual FROM q JOIN m ON q.park_id = m.park_id AND month(lts) = m.month GROUP BY 1, 2")
def ag44(spark, sf):
    log = queue_log(spark, sf).withColumn("month", F.month("lts"))
    usual = log.groupBy("park_id", "month", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("park_id", "month").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("usual"))
    return log.groupBy("park_id", "month").agg(r4(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).join(usual, ["park_id", "month"])


@query("ag45_daily_peak_panel", f"WITH {Q} SELECT entity_id AS unique_id, strftime(lts, '%Y-%m-%d') AS ds, round(quantile_cont(wait, 0.9), 4) AS y FROM op WHERE wait >= 5 GROUP BY 1, 2 HAVING count(*) >= 3")
def ag45(spark, sf):
    d = standby_operating(queue_log(spark, sf), 5).groupBy(F.col("entity_id").alias("unique_id"), F.date_format("lts", "yyyy-MM-dd").alias("ds")).agg(r4(F.percentile("wait", F.lit(0.9))).alias("y"), F.count(F.lit(1)).alias("n"))
    return d.filter("n >= 3").drop("n")


@query("ag46_cross_ride_panel", f"WITH {Q} SELECT park_id, entity_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS slot, round(quantile_cont(CASE WHEN status = 'OPERATING' AND wait >= 5 THEN wait END, 0.5), 4) AS y, count(*) FILTER (status = 'OPERATING') AS n_obs, count(*) FILTER (status = 'DOWN') AS down_count FROM q GROUP BY 1, 2, 3")
def ag46(spark, sf):
    on = F.col("status") == "OPERATING"
    slot = (F.floor(F.unix_timestamp("ts") / 86400) * 86400).cast("long").alias("slot")
    return queue_log(spark, sf).groupBy("park_id", "entity_id", slot).agg(r4(F.percentile(F.when(on & (F.col("wait") >= 5), F.col("wait")), F.lit(0.5))).alias("y"), F.count_if(on).alias("n_obs"), F.count_if(F.col("status") == "DOWN").alias("down_count"))


@query("ag48_season_months", "SELECT o_custkey, string_agg(DISTINCT month(o_orderdate)::VARCHAR, ',' ORDER BY month(o_orderdate)::VARCHAR) AS months FROM orders GROUP BY 1 HAVING date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) >= 330")
def ag48(spark, sf):
    """Months seen, of what was observed for long enough."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set(F.month("o_orderdate").cast("string"))), ",").alias("months"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span"))
    return o.filter("span >= 330").drop("span")


def closed_days(log: DataFrame) -> DataFrame:
    """Ride-days with rows none of which is running."""
    return log.groupBy("park_id", "entity_id", F.to_date("lts").alias("day")).agg(F.bool_or(F.col("status") == "OPERATING").alias("ran")).filter(~F.col("ran")).drop("ran")


@query("ag49_seasonal_rides", f"WITH {Q}, d AS (SELECT park_id, entity_id, CAST(lts AS DATE) AS day FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE a.entity_id = b.entity_id AND CAST(a.lts AS DATE) = CAST(b.lts AS DATE) AND b.status = 'OPERATING') GROUP BY 1, 2, 3), {_LAST} SELECT d.entity_id, count(*) AS days FROM d JOIN last l USING (entity_id) WHERE l.status <> 'OPERATING' AND EXISTS (SELECT 1 FROM op o WHERE o.entity_id = d.entity_id) GROUP BY 1 HAVING count(*) >= 4")
def ag49(spark, sf):
    log = queue_log(spark, sf)
    now = latest_per(log, ["entity_id"]).filter(F.col("status") != "OPERATING").select("entity_id")
    ever = standby_operating(log).select("entity_id").distinct()
    return closed_days(log).join(now, "entity_id", "left_semi").join(ever, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("days")).filter("days >= 4")


@query("ag50_never_operated", f"WITH {Q}, p AS (SELECT park_id, count(*) FILTER (status = 'OPERATING') AS n FROM q WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1 HAVING count(*) FILTER (status = 'OPERATING') >= 20) SELECT entity_id, bool_or(status = 'OPERATING') AS ever FROM q JOIN p USING (park_id) WHERE ts < TIMESTAMP '2024-01-02' GROUP BY 1 HAVING NOT bool_or(status = 'OPERATING')")
def ag50(spark, sf):
    log = queue_log(spark, sf).filter(F.col("ts") < at("2024-01-02"))
    tracked = log.groupBy("park_id").agg(F.count_if(F.col("status") == "OPERATING").alias("n")).filter("n >= 20").select("park_id")
    return log.join(tracked, "park_id", "left_semi").groupBy("entity_id").agg(F.bool_or(F.col("status") == "OPERATING").alias("ever")).filter(~F.col("ever"))


@query("ag51_shared_minutes", f"WITH {Q}, l AS (SELECT park_id, entity_id, max(ts) AS ts FROM op GROUP BY 1, 2), t AS (SELECT park_id, count(*) AS n FROM l GROUP BY 1) SELECT l.park_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS at, count(*) AS rides FROM l JOIN t USING (park_id) GROUP BY 1, 2, n HAVING count(*) >= 5 AND count(*) >= 0.15 * n")
def ag51(spark, sf):
    last = standby_operating(queue_log(spark, sf)).groupBy("park_id", "entity_id").agg(F.max("ts").alias("ts"))
    return shared_moments(last, "yyyy-MM-dd")


def shared_moments(last: DataFrame, unit: str = "yyyy-MM-dd HH:mm", least: int = 5, share: float = 0.15) -> DataFrame:
    """Moments at which many rides of a park were last running: the feed stopped, not they."""
    tracked = last.groupBy("park_id").agg(F.count(F.lit(1)).alias("n"))
    c = last.groupBy("park_id", F.date_format("ts", unit).alias("at")).agg(F.count(F.lit(1)).alias("rides")).join(tracked, "park_id")
    return c.filter((F.col("rides") >= least) & (F.col("rides") >= share * F.col("n"))).drop("n")


@query("ag52_data_quality", f"WITH {Q} SELECT park_id, strftime(max(ts) FILTER (status = 'OPERATING'), '%Y-%m-%d %H:%M') AS last_running, array_to_string(list_slice(list(entity_id ORDER BY wait DESC, event_id), 1, 4), ',') AS tops FROM q GROUP BY 1 HAVING count(*) > 10")
def ag52(spark, sf):
    tops = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("wait")).alias("w"), "event_id", "entity_id"))), 1, 4)
    q = first_per(queue_log(spark, sf), ["event_id"], "ts")
    four = q.withColumn("k", F.row_number().over(Window.partitionBy("park_id").orderBy(F.desc("wait"), "event_id"))).filter("k <= 4").groupBy("park_id").agg(F.array_join(F.transform(tops, lambda s: s["entity_id"].cast("string")), ",").alias("tops"))
    last = q.groupBy("park_id").agg(F.date_format(F.max(F.when(F.col("status") == "OPERATING", F.col("ts"))), "yyyy-MM-dd HH:mm").alias("last_running"), F.count(F.lit(1)).alias("n")).filter("n > 10").drop("n")
    return last.join(four, "park_id")


@query("ag53_retirement", f"WITH {Q}, l AS (SELECT entity_id, max(ts) AS ts, count(*) AS n FROM op GROUP BY 1) SELECT entity_id, n FROM l LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) s ON entity_id = s_suppkey WHERE s_suppkey IS NULL AND ts < TIMESTAMP '2024-01-29'")
def ag53(spark, sf):
    marked = read(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("entity_id"))
    last = standby_operating(queue_log(spark, sf)).groupBy("entity_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return last.filter(F.col("ts") < at("2024-01-29")).join(marked, "entity_id", "left_anti").select("entity_id", "n")


@query("ag54_term_counts", "WITH t AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION ALL SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) FROM part) SELECT term, count(DISTINCT p_partkey) AS n FROM t GROUP BY 1")
def ag54(spark, sf):
    p = read(spark, sf, "part")
    of = lambda c: p.select("p_partkey", F.explode(F.split(F.lower(c), " ")).alias("term"))
    return of("p_name").unionByName(of("p_type")).groupBy("term").agg(F.countDistinct("p_partkey").alias("n"))


def derived_hours(slots: DataFrame, least: float = 2, most: float = 10, share: float = 0.1) -> DataFrame:
    """slots (park_id, day, slot_hour, rides active): opening and closing from the hours in which enough rides were active."""
    total = slots.groupBy("park_id").agg(F.max("known").alias("known"))
    need = F.least(F.lit(most), F.greatest(F.lit(least), share * F.col("known")))
    on = F.when(F.col("active") >= F.col("need"), F.col("slot_hour"))
    return slots.drop("known").join(total.withColumn("need", need), "park_id").groupBy("park_id", "day").agg(F.min(on).alias("opens"), (F.max(on) + 1).alias("closes")).filter("opens IS NOT NULL")


@query("ag55_derived_hours", f"WITH {Q}, s AS (SELECT park_id, strftime(lts, '%Y-%m-%d') AS day, CAST(hour(lts) AS INT) AS h, count(DISTINCT entity_id) AS active FROM op GROUP BY 1, 2, 3), k AS (SELECT park_id, count(DISTINCT entity_id) AS known FROM op GROUP BY 1) SELECT park_id, day, min(h) AS opens, max(h) + 1 AS closes FROM s JOIN k USING (park_id) WHERE active >= least(10, greatest(2, 0.1 * known)) GROUP BY 1, 2")
def ag55(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    known = rows.groupBy("park_id").agg(F.countDistinct("entity_id").alias("known"))
    s = rows.groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day"), F.hour("lts").alias("slot_hour")).agg(F.countDistinct("entity_id").alias("active"))
    return derived_hours(s.join(known, "park_id"))


@query("ag56_park_status", f"WITH {Q}, {SCHED}, a AS (SELECT park_id, bool_or(status = 'OPERATING' AND wait > 0) AS act FROM q WHERE ts > TIMESTAMP '2024-01-20 06:00:00' AND ts <= {_NOW} GROUP BY 1), s AS (SELECT park_id, type FROM sched WHERE date = DATE '2024-01-20') SELECT p.park_id, CASE WHEN s.type = 'OPERATING' OR coalesce(act, false) THEN 'OPERATING' ELSE 'CLOSED' END AS status FROM (SELECT DISTINCT park_id FROM q) p LEFT JOIN a USING (park_id) LEFT JOIN s USING (park_id)")
def ag56(spark, sf):
    log = queue_log(spark, sf)
    act = log.filter((F.col("ts") > at("2024-01-20 06:00:00")) & (F.col("ts") <= at("2024-01-20 12:00:00"))).groupBy("park_id").agg(F.bool_or((F.col("status") == "OPERATING") & (F.col("wait") > 0)).alias("act"))
    s = schedules(spark, sf).filter(F.col("date") == F.lit("2024-01-20").cast("date")).select("park_id", "type")
    rows = log.select("park_id").distinct().join(act, "park_id", "left").join(s, "park_id", "left")
    on = F.coalesce(F.col("type") == "OPERATING", F.lit(False)) | F.coalesce("act", F.lit(False))
    return rows.select("park_id", F.when(on, "OPERATING").otherwise("CLOSED").alias("status"))


@query("ag58_operating_range", f"WITH {Q}, {SCHED} SELECT park_id, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM sched WHERE type = 'OPERATING' GROUP BY 1")
def ag58(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return schedules(spark, sf).filter("type = 'OPERATING'").groupBy("park_id").agg(day(F.min("date")).alias("first"), day(F.max("date")).alias("last"))


@query("ag59_projected_holidays", "WITH y AS (SELECT c_nationkey, year(o_orderdate) AS y, min(dayofyear(o_orderdate)) AS a, max(dayofyear(o_orderdate)) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) = 7 GROUP BY 1, 2), m AS (SELECT c_nationkey, CAST(round(avg(a)) AS INT) AS a, CAST(round(avg(b)) AS INT) AS b FROM y GROUP BY 1) SELECT c_nationkey, strftime(unnest(generate_series(DATE '2002-01-01' + (a - 1), DATE '2002-01-01' + (b - 1), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM m")
def ag59(spark, sf):
    """The mean span of past summers, laid on a coming year."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(F.month("o_orderdate") == 7)
    y = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.min(F.dayofyear("o_orderdate")).alias("a"), F.max(F.dayofyear("o_orderdate")).alias("b"))
    m = y.groupBy("c_nationkey").agg(F.round(F.avg("a")).cast("int").alias("a"), F.round(F.avg("b")).cast("int").alias("b"))
    first = F.lit("2002-01-01").cast("date")
    return m.select("c_nationkey", F.explode(F.sequence(F.date_add(first, F.col("a") - 1), F.date_add(first, F.col("b") - 1))).alias("d")).select("c_nationkey", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("ag60_status_counts", f"WITH {Q}, {_LAST} SELECT park_id, count(*) AS total, count(*) FILTER (status = 'OPERATING') AS running, count(*) FILTER (status = 'DOWN') AS down, count(*) FILTER (status = 'CLOSED') AS closed FROM last GROUP BY 1")
def ag60(spark, sf):
    s = F.col("status")
    return latest_per(queue_log(spark, sf), ["entity_id"]).groupBy("park_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "OPERATING").alias("running"), F.count_if(s == "DOWN").alias("down"), F.count_if(s == "CLOSED").alias("closed"))


@query("ag63_ride_history", f"WITH {Q}, h AS (SELECT entity_id, CAST(lts AS DATE) AS day, round(quantile_cont(wait, 0.9), 4) AS p90, 'stored' AS origin FROM op WHERE CAST(lts AS DATE) < DATE '2024-01-25' GROUP BY 1, 2 UNION ALL SELECT entity_id, CAST(lts AS DATE), round(quantile_cont(wait, 0.9), 4), 'live' FROM op WHERE CAST(lts AS DATE) = DATE '2024-01-25' GROUP BY 1, 2), {SCHED} SELECT h.entity_id, strftime(h.day, '%Y-%m-%d') AS day, p90, origin, type FROM h LEFT JOIN sched s ON h.entity_id % 8 = s.park_id AND h.day = s.date")
def ag63(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).withColumn("day", F.to_date("lts"))
    cut = F.lit("2024-01-25").cast("date")
    of = lambda on, name: rows.filter(on).groupBy("park_id", "entity_id", "day").agg(r4(F.percentile("wait", F.lit(0.9))).alias("p90"), F.lit(name).alias("origin"))
    both = of(F.col("day") < cut, "stored").unionByName(of(F.col("day") == cut, "live"))
    s = schedules(spark, sf).select("park_id", F.col("date").alias("day"), "type")
    return both.join(s, ["park_id", "day"], "left").select("entity_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "p90", "origin", "type")


@query("ag64_model_comparison", "WITH v AS (SELECT o_orderpriority AS model, CAST(o_orderdate AS DATE) AS trained, round(avg(o_totalprice), 4) AS mae FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY trained DESC) AS k, lead(mae) OVER (PARTITION BY model ORDER BY trained DESC) AS before FROM v) SELECT model, mae, before, round((mae - before) / before * 100, 4) AS delta FROM k WHERE k = 1")
def ag64(spark, sf):
    v = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.to_date("o_orderdate").alias("trained")).agg(r4(F.avg("o_totalprice")).alias("mae"))
    w = Window.partitionBy("model").orderBy(F.desc("trained"))
    k = v.withColumns({"k": F.row_number().over(w), "before": F.lead("mae").over(w)}).filter("k = 1")
    return k.select("model", "mae", "before", r4((F.col("mae") - F.col("before")) / F.col("before") * 100).alias("delta"))


@query("ag65_live_waits", f"WITH {Q}, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity_id, queue_type ORDER BY ts DESC, event_id DESC) = 1) SELECT park_id, entity_id, string_agg(queue_type || '=' || wait, ',' ORDER BY queue_type) AS queues FROM l GROUP BY 1, 2")
def ag65(spark, sf):
    now = latest_per(queue_log(spark, sf), ["entity_id", "queue_type"])
    listed = F.sort_array(F.collect_list(F.struct("queue_type", "wait")))
    return now.groupBy("park_id", "entity_id").agg(F.array_join(F.transform(listed, lambda s: F.concat_ws("=", s["queue_type"], s["wait"])), ",").alias("queues"))


#: Fixed values of the rope-drop rule.
BIN, GUARD, SHAPE_PEAK, SUPPORT = 15, 30, 20.0, 0.5


def rope_drop(slots: DataFrame, support: float = SUPPORT, shape_peak: float = SHAPE_PEAK, guard: int = GUARD) -> DataFrame:
    """slots (entity_id, day, minutes after opening, p90): is it worth coming early?

    Days with a peak worth a shape, without the last minutes before closing, are scaled to their peak; the median curve has the bins that enough days
    support; the ride-by time is the first bin at half the peak; what is saved is the median peak less the wait at the start.
    """
    day = Window.partitionBy("entity_id", "day")
    rows = slots.withColumns({"peak": F.max("p90").over(day), "last": F.max("minutes").over(day)}).filter((F.col("peak") >= shape_peak) & (F.col("minutes") <= F.col("last") - guard))
    days = rows.groupBy("entity_id").agg(F.countDistinct("day").alias("days"))
    peaks = rows.groupBy("entity_id", "day").agg(F.max("peak").alias("peak")).groupBy("entity_id").agg(F.percentile("peak", F.lit(0.5)).alias("peak"))
    bins = rows.groupBy("entity_id", "minutes").agg(F.percentile(F.col("p90") / F.col("peak"), F.lit(0.5)).alias("level"), F.count(F.lit(1)).alias("n")).join(days, "entity_id").filter(F.col("n") >= support * F.col("days"))
    start = bins.groupBy("entity_id").agg(F.min_by("level", "minutes").alias("open_level"), F.min(F.when(F.col("level") >= 0.5, F.col("minutes"))).alias("ride_by"), F.min_by("minutes", F.struct("level", "minutes")).alias("best"), F.max("days").alias("days"))
    out = start.join(peaks, "entity_id").withColumn("saved", F.col("peak") * (1 - F.col("open_level")))
    worth = (F.col("peak") >= 60) & (F.col("saved") >= 45)
    return out.select("entity_id", "days", r4(F.col("peak")).alias("peak"), r4(F.col("saved")).alias("saved"), "ride_by", "best", worth.alias("worth"), F.when((F.col("peak") >= 90) & (F.col("saved") >= 60), "high").when(worth, "medium").otherwise("low").alias("strength"))


@query("ag27_rope_drop", f"""WITH {Q}, s AS (SELECT entity_id, CAST(lts AS DATE) AS day, CAST(hour(lts) // 3 * 180 AS INT) AS minutes, quantile_cont(wait, 0.9) AS p90 FROM op GROUP BY 1, 2, 3),
r AS (SELECT *, max(p90) OVER w AS peak, max(minutes) OVER w AS last FROM s WINDOW w AS (PARTITION BY entity_id, day)), f AS (SELECT * FROM r WHERE peak >= 20 AND minutes <= last - 30),
d AS (SELECT entity_id, count(DISTINCT day) AS days FROM f GROUP BY 1), pk AS (SELECT entity_id, quantile_cont(peak, 0.5) AS peak FROM (SELECT DISTINCT entity_id, day, peak FROM f) GROUP BY 1),
b AS (SELECT entity_id, minutes, quantile_cont(p90 / peak, 0.5) AS level, count(*) AS n FROM f GROUP BY 1, 2), g AS (SELECT b.*, days FROM b JOIN d USING (entity_id) WHERE n >= 0.1 * days),
st AS (SELECT entity_id, arg_min(level, minutes) AS o, min(minutes) FILTER (level >= 0.5) AS ride_by, arg_min(minutes, (level, minutes)) AS best, max(days) AS days FROM g GROUP BY 1)
SELECT st.entity_id, days, round(peak, 4) AS peak, round(peak * (1 - o), 4) AS saved, ride_by, best, peak >= 60 AND peak * (1 - o) >= 45 AS worth, CASE WHEN peak >= 90 AND peak * (1 - o) >= 60 THEN 'high' WHEN peak >= 60 AND peak * (1 - o) >= 45 THEN 'medium' ELSE 'low' END AS strength FROM st JOIN pk USING (entity_id)""")  # fmt: skip
def ag27(spark, sf):
    slots = standby_operating(queue_log(spark, sf)).groupBy("entity_id", F.to_date("lts").alias("day"), (F.floor(F.hour("lts") / 3) * 180).cast("int").alias("minutes")).agg(F.percentile("wait", F.lit(0.9)).alias("p90"))
    return rope_drop(slots, support=0.1)


@query("ag28_minutes_after_opening", f"WITH {Q}, s AS (SELECT park_id, entity_id, CAST(lts AS DATE) AS day, min(lts) AS a FROM op GROUP BY 1, 2, 3), o AS (SELECT park_id, day, min(a) AS opens FROM s GROUP BY 1, 2) SELECT s.entity_id, strftime(s.day, '%Y-%m-%d') AS day, CAST(floor((epoch(a) - epoch(opens)) / 60 / 15) * 15 AS BIGINT) AS minutes FROM s JOIN o USING (park_id, day)")
def ag28(spark, sf):
    s = standby_operating(queue_log(spark, sf)).groupBy("park_id", "entity_id", F.to_date("lts").alias("day")).agg(F.min("lts").alias("a"))
    opens = s.groupBy("park_id", "day").agg(F.min("a").alias("opens"))
    minutes = F.floor((F.unix_micros("a") - F.unix_micros("opens")) / 6e7 / 15) * 15
    return s.join(opens, ["park_id", "day"]).select("entity_id", F.date_format("day", "yyyy-MM-dd").alias("day"), minutes.cast("long").alias("minutes"))
