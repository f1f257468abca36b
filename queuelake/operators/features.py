"""Features, shapes and serving: composite operators out of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.functions.ladders import crowd_level
from queuelake.operators.latest import first_per, latest_per
from queuelake.operators.rollup import SCHED, schedules, standby_operating
from queuelake.plans.adaptor import Q, queue_log, r4, read
from queuelake.registry import query


def park_occupancy(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    """A park's mean wait in each hour as percent of its baseline, within 0..200."""
    h = rows.groupBy("park_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.avg("wait").alias("m")).join(baselines, "park_id")
    return h.withColumn("occupancy", F.least(F.greatest(F.col("m") / F.nullif(F.col("base"), F.lit(0.0)) * 100, F.lit(0.0)), F.lit(200.0)))


@query("fp2_occupancy", f"WITH {Q}, b AS (SELECT park_id, quantile_cont(wait, 0.5) AS base FROM op GROUP BY 1), h AS (SELECT park_id, strftime(ts, '%Y-%m-%d %H') AS hour, avg(wait) AS m FROM op GROUP BY 1, 2) SELECT h.park_id, hour, round(least(greatest(m / base * 100, 0), 200), 4) AS occupancy FROM h JOIN b USING (park_id)")
def fp2(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    return park_occupancy(rows, rows.groupBy("park_id").agg(F.percentile("wait", F.lit(0.5)).alias("base"))).select("park_id", "hour", r4(F.col("occupancy")).alias("occupancy"))


def schedule_features(rows: DataFrame, hours: DataFrame, force: int = 10) -> DataFrame:
    """Whether the park is open at a row, by its hours of the local day or because of a wait, and the minutes since opening."""
    j = rows.join(hours, ["park_id", "day"], "left")
    inside = F.coalesce((F.hour("lts") >= F.col("opens")) & (F.hour("lts") < F.col("closes")), F.lit(False))
    since = F.greatest(F.hour("lts") * 60 + F.minute("lts") - F.col("opens") * 60, F.lit(0))
    return j.withColumns({"is_open": inside | F.coalesce(F.col("wait") >= force, F.lit(False)), "since_open": F.coalesce(since, F.lit(0)).cast("int")})


@query("fp3_schedule_features", f"WITH {Q}, h AS (SELECT park_id, CAST(lts AS DATE) AS day, CAST(min(hour(lts)) + 6 AS INT) AS opens, CAST(max(hour(lts)) - 2 AS INT) AS closes FROM q WHERE park_id <> 3 GROUP BY 1, 2) SELECT event_id, (coalesce(hour(lts) >= opens AND hour(lts) < closes, false) OR coalesce(wait >= 200, false)) AS is_open, CAST(coalesce(greatest(hour(lts) * 60 + minute(lts) - opens * 60, 0), 0) AS INT) AS since_open FROM q LEFT JOIN h ON q.park_id = h.park_id AND CAST(lts AS DATE) = h.day")
def fp3(spark, sf):
    log = queue_log(spark, sf).withColumn("day", F.to_date("lts"))
    hours = log.filter("park_id <> 3").groupBy("park_id", "day").agg((F.min(F.hour("lts")) + 6).alias("opens"), (F.max(F.hour("lts")) - 2).alias("closes"))
    return schedule_features(log, hours, 200).select("event_id", "is_open", "since_open")


def bridge_days(holidays: DataFrame, key: str) -> DataFrame:
    """Fridays after a Thursday holiday and Mondays before a Tuesday one, that are none themselves."""
    d = F.col("day")
    cand = holidays.select(key, F.when(F.dayofweek(d) == 5, F.date_add(d, 1)).when(F.dayofweek(d) == 3, F.date_sub(d, 1)).alias("day")).filter("day IS NOT NULL").distinct()
    return cand.join(holidays.select(key, "day").distinct(), [key, "day"], "left_anti")


@query("fp4_bridge_days", "WITH h AS (SELECT DISTINCT user_id % 4 AS k, CAST(ts AS DATE) AS day FROM events WHERE value > 200 AND event_type = 'error'), c AS (SELECT DISTINCT k, CASE WHEN extract(dow FROM day) = 4 THEN day + 1 WHEN extract(dow FROM day) = 2 THEN day - 1 END AS day FROM h) SELECT k, strftime(day, '%Y-%m-%d') AS day FROM c WHERE day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.k = c.k AND h.day = c.day)")
def fp4(spark, sf):
    h = read(spark, sf, "events").filter("value > 200 AND event_type = 'error'").select((F.col("user_id") % 4).alias("k"), F.to_date("ts").alias("day")).distinct()
    return bridge_days(h, "k").select("k", F.date_format("day", "yyyy-MM-dd").alias("day"))


def validated(rows: DataFrame, most: int = 400, least_rows: int = 10, over: float = 200) -> DataFrame:
    """Training rows without negative, implausible and outlying waits: above Q3 + 3 IQR of rides with enough rows, and above ``over``."""
    q = rows.groupBy("entity_id").agg(F.percentile("wait", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= least_rows, F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0]))
    j = rows.join(q.select("entity_id", bound.alias("bound")), "entity_id")
    outlier = F.coalesce((F.col("wait") > F.col("bound")) & (F.col("wait") > over), F.lit(False))
    return j.filter((F.col("wait") >= 0) & (F.col("wait") <= most) & ~outlier).drop("bound")


@query("fp7_validation", f"WITH {Q}, b AS (SELECT entity_id, CASE WHEN count(*) >= 10 THEN quantile_cont(wait, 0.75) + 3 * (quantile_cont(wait, 0.75) - quantile_cont(wait, 0.25)) END AS bound FROM op GROUP BY 1) SELECT event_id FROM op JOIN b USING (entity_id) WHERE wait >= 0 AND wait <= 400 AND NOT coalesce(wait > bound AND wait > 200, false)")
def fp7(spark, sf):
    return validated(standby_operating(queue_log(spark, sf))).select("event_id")


def dropped_out(rows: DataFrame, rates: dict[str, float], seed: int = 7) -> DataFrame:
    """Features set to null at random: by a hash of row and feature, so a run gives what another gave."""
    cut = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "event_id"), F.lit(1_000_000)) < F.lit(int(rates[c] * 1_000_000))
    return rows.withColumns({c: F.when(~cut(c), F.col(c)) for c in rates})


@query("fp8_feature_dropout")
def fp8(spark, sf):
    return dropped_out(queue_log(spark, sf).select("event_id", "wait", "value"), {"wait": 0.5, "value": 0.4})


def future_times(start: Column, days: int, hours: tuple[int, ...] = (12, 14, 16)) -> Column:
    """The hours of each of the coming days, as an array."""
    each = F.sequence(F.date_trunc("DAY", start), F.date_trunc("DAY", start) + F.expr(f"INTERVAL {days - 1} DAYS"), F.expr("INTERVAL 1 DAY"))
    return F.flatten(F.transform(each, lambda d: F.array(*(d + F.expr(f"INTERVAL {h} HOURS") for h in hours))))


@query("fp9_fp31_future_grid", "SELECT s_suppkey AS entity_id, strftime(d + h * INTERVAL 1 HOUR, '%Y-%m-%d %H') AS at FROM supplier, generate_series(TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-13', INTERVAL 1 DAY) t(d), (VALUES (12), (14), (16)) v(h)")
def fp9(spark, sf):
    rides = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"))
    return rides.withColumn("at", F.explode(future_times(F.lit("2024-01-31").cast("timestamp"), 14))).select("entity_id", F.date_format("at", "yyyy-MM-dd HH").alias("at"))


def shape_profiles(panel: DataFrame, thresholds: DataFrame, least_slots: int = 8, least_peak: float = 5) -> DataFrame:
    """panel (park_id, entity_id, day, slot, y) -> mean curves of y over the day's peak at five levels: ride and crowd and weekday, ride and crowd, ride and weekday, ride, park."""
    day = Window.partitionBy("entity_id", "day")
    rows = panel.withColumns({"peak": F.max("y").over(day), "n": F.count(F.lit(1)).over(day)}).filter((F.col("peak") >= least_peak) & (F.col("n") >= least_slots))
    rows = rows.join(thresholds, "entity_id").withColumn("crowd", F.size(F.filter("cuts", lambda t: t <= F.col("peak"))))
    rows = rows.withColumns({"dow": F.dayofweek("day") - 1, "x": F.col("y") / F.col("peak")})
    cube = rows.groupingSets([["park_id", "entity_id", "crowd", "dow", "slot"], ["park_id", "entity_id", "crowd", "slot"], ["park_id", "entity_id", "dow", "slot"], ["park_id", "entity_id", "slot"], ["park_id", "slot"]], "park_id", "entity_id", "crowd", "dow", "slot")
    return cube.agg(F.grouping_id().alias("level"), r4(F.avg("x")).alias("curve"), F.count(F.lit(1)).alias("n"))


_SHAPE = """p AS (SELECT park_id, entity_id, CAST(lts AS DATE) AS day, CAST(hour(lts) // 6 AS INT) AS slot, CAST(max(wait) AS DOUBLE) AS y FROM op GROUP BY 1, 2, 3, 4), d AS (SELECT *, max(y) OVER (PARTITION BY entity_id, day) AS peak, count(*) OVER (PARTITION BY entity_id, day) AS n FROM p),
c AS (SELECT entity_id, quantile_cont(peak, [0.3333, 0.6667]) AS cuts FROM (SELECT entity_id, day, max(y) AS peak FROM p GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT d.*, y / peak AS x, CAST(peak >= cuts[1] AS INT) + CAST(peak >= cuts[2] AS INT) AS crowd, CAST(extract(dow FROM day) AS INT) AS dow FROM d JOIN c USING (entity_id) WHERE peak >= 5 AND n >= 2)"""


def _panel(spark, sf) -> DataFrame:
    return standby_operating(queue_log(spark, sf)).groupBy("park_id", "entity_id", F.to_date("lts").alias("day"), F.floor(F.hour("lts") / 6).cast("int").alias("slot")).agg(F.max("wait").cast("double").alias("y"))


def crowd_cuts(panel: DataFrame, shares: tuple[float, ...] = (0.3333, 0.6667)) -> DataFrame:
    """Of each ride, the inner quantiles of its daily peaks."""
    peaks = panel.groupBy("entity_id", "day").agg(F.max("y").alias("peak"))
    return peaks.groupBy("entity_id").agg(F.percentile("peak", F.array(*(F.lit(s) for s in shares))).alias("cuts"))


@query("fp15_shape_profiles", f"WITH {Q}, {_SHAPE} SELECT park_id, entity_id, crowd, dow, slot, CAST(grouping(park_id, entity_id, crowd, dow, slot) AS BIGINT) AS level, round(avg(x), 4) AS curve, count(*) AS n FROM f GROUP BY GROUPING SETS ((park_id, entity_id, crowd, dow, slot), (park_id, entity_id, crowd, slot), (park_id, entity_id, dow, slot), (park_id, entity_id, slot), (park_id, slot))")
def fp15(spark, sf):
    panel = _panel(spark, sf)
    return shape_profiles(panel, crowd_cuts(panel), 2)


@query("fp16_crowd_buckets", f"WITH {Q}, {_SHAPE} SELECT DISTINCT entity_id, strftime(day, '%Y-%m-%d') AS day, crowd FROM f")
def fp16(spark, sf):
    panel = _panel(spark, sf)
    peaks = panel.groupBy("entity_id", "day").agg(F.max("y").alias("peak"), F.count(F.lit(1)).alias("n")).filter("peak >= 5 AND n >= 2").join(crowd_cuts(panel), "entity_id")
    return peaks.select("entity_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size(F.filter("cuts", lambda t: t <= F.col("peak"))).alias("crowd"))


def picked(rows: DataFrame, levels: list[tuple[DataFrame, list[str]]], least: int = 5) -> DataFrame:
    """The first level's curve that has enough observations, from the finest on: left joins and one coalesce."""
    for k, (profile, keys) in enumerate(levels):
        rows = rows.join(profile.filter(F.col("n") >= least).select(*keys, F.col("curve").alias(f"_c{k}")), keys, "left")
    found = [F.col(f"_c{k}") for k in range(len(levels))]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in enumerate(found)))
    return rows.withColumns({"curve": F.coalesce(*found), "from_level": source}).drop(*(f"_c{k}" for k in range(len(levels))))


@query("fp17_curve_fallback", f"WITH {Q}, {_SHAPE}, k AS (SELECT DISTINCT park_id, entity_id, crowd, slot FROM f), ca AS (SELECT entity_id, crowd, slot, round(avg(x), 4) AS curve FROM f GROUP BY 1, 2, 3 HAVING count(*) >= 5), cb AS (SELECT entity_id, slot, round(avg(x), 4) AS curve FROM f GROUP BY 1, 2 HAVING count(*) >= 5), cc AS (SELECT park_id, slot, round(avg(x), 4) AS curve FROM f GROUP BY 1, 2 HAVING count(*) >= 5) SELECT k.entity_id, k.crowd, k.slot, coalesce(ca.curve, cb.curve, cc.curve) AS curve, CASE WHEN ca.curve IS NOT NULL THEN 0 WHEN cb.curve IS NOT NULL THEN 1 WHEN cc.curve IS NOT NULL THEN 2 END AS from_level FROM k LEFT JOIN ca USING (entity_id, crowd, slot) LEFT JOIN cb ON k.entity_id = cb.entity_id AND k.slot = cb.slot LEFT JOIN cc ON k.park_id = cc.park_id AND k.slot = cc.slot")
def fp17(spark, sf):
    panel = _panel(spark, sf)
    p = shape_profiles(panel, crowd_cuts(panel), 2)
    of = lambda keys, level: (p.filter(F.col("level") == level), keys)
    rows = p.filter("level = 2").select("park_id", "entity_id", "crowd", "slot")
    levels = [of(["entity_id", "crowd", "slot"], 0b00010), of(["entity_id", "slot"], 0b00110), of(["park_id", "slot"], 0b01110)]
    return picked(rows, levels).select("entity_id", "crowd", "slot", "curve", "from_level")


def schedule_gaps(schedule: DataFrame) -> DataFrame:
    """Days without a row: CLOSED strictly between the first and last operating day, else UNKNOWN, from the first to the last day known."""
    span = schedule.groupBy("park_id").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.min(F.when(F.col("type") == "OPERATING", F.col("date"))).alias("x"), F.max(F.when(F.col("type") == "OPERATING", F.col("date"))).alias("y"))
    grid = span.select("park_id", "x", "y", F.explode(F.sequence("a", "b")).alias("date"))
    none = grid.join(schedule.select("park_id", "date").distinct(), ["park_id", "date"], "left_anti")
    between = F.coalesce((F.col("date") > F.col("x")) & (F.col("date") < F.col("y")), F.lit(False))
    return none.select("park_id", "date", F.when(between, "CLOSED").otherwise("UNKNOWN").alias("type"))


@query("fp20_schedule_gaps", f"WITH {Q}, {SCHED}, s AS (SELECT park_id, date, type FROM sched WHERE n % 4 <> 0), sp AS (SELECT park_id, min(date) AS a, max(date) AS b, min(date) FILTER (type = 'OPERATING') AS x, max(date) FILTER (type = 'OPERATING') AS y FROM s GROUP BY 1), g AS (SELECT park_id, x, y, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM sp) SELECT park_id, strftime(date, '%Y-%m-%d') AS date, CASE WHEN date > x AND date < y THEN 'CLOSED' ELSE 'UNKNOWN' END AS type FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.park_id = g.park_id AND s.date = g.date)")
def fp20(spark, sf):
    s = schedules(spark, sf).filter("n % 4 <> 0").select("park_id", "date", "type")
    return schedule_gaps(s).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def holiday_kinds(rows: DataFrame) -> DataFrame:
    """One kind for each key and day: public before school before observance."""
    rank = F.when(F.col("kind") == "public", 0).when(F.col("kind") == "school", 1).otherwise(2)
    return first_per(rows.withColumn("_r", rank), ["k", "day"], "_r", "kind").drop("_r")


@query("fp21_holiday_map", "WITH h AS (SELECT DISTINCT user_id % 4 AS k, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'public' WHEN 'click' THEN 'school' ELSE 'observance' END AS kind FROM events WHERE value > 400) SELECT k, strftime(day, '%Y-%m-%d') AS day, kind FROM h QUALIFY row_number() OVER (PARTITION BY k, day ORDER BY CASE kind WHEN 'public' THEN 0 WHEN 'school' THEN 1 ELSE 2 END) = 1")
def fp21(spark, sf):
    kind = F.when(F.col("event_type") == "view", "public").when(F.col("event_type") == "click", "school").otherwise("observance")
    h = read(spark, sf, "events").filter("value > 400").select((F.col("user_id") % 4).alias("k"), F.to_date("ts").alias("day"), kind.alias("kind")).distinct()
    return holiday_kinds(h).select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "kind")


def headliner_load(latest: DataFrame, baselines: DataFrame) -> DataFrame:
    """A park's occupancy: the sum of its rides' waits over the sum of their usual ones, in percent, and its level."""
    j = latest.join(baselines.select("entity_id", "p50"), "entity_id")
    out = j.groupBy("park_id").agg((F.sum("wait") / F.nullif(F.sum("p50"), F.lit(0.0)) * 100).alias("load"), F.count(F.lit(1)).alias("rides"))
    return out.select("park_id", r4(F.col("load")).alias("load"), "rides", crowd_level(F.col("load")).alias("level"))


@query("fp23_headliner_load", f"WITH {Q}, b AS (SELECT entity_id, quantile_cont(wait, 0.5) AS p50 FROM op GROUP BY 1), l AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1), s AS (SELECT park_id, sum(wait) / nullif(sum(p50), 0) * 100 AS load, count(*) AS rides FROM l JOIN b USING (entity_id) GROUP BY 1) SELECT park_id, round(load, 4) AS load, rides, CASE WHEN load <= 60 THEN 'very_low' WHEN load <= 89 THEN 'low' WHEN load <= 110 THEN 'moderate' WHEN load <= 150 THEN 'high' WHEN load <= 200 THEN 'very_high' ELSE 'extreme' END AS level FROM s")
def fp23(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    return headliner_load(latest_per(rows, ["entity_id"]), rows.groupBy("entity_id").agg(F.percentile("wait", F.lit(0.5)).alias("p50")))


@query("fp28_quantile_pivot", f"WITH {Q}, f AS (SELECT entity_id, strftime(ts, '%Y-%m-%d') AS slot, CASE event_type WHEN 'view' THEN 0.5 ELSE 0.8 END AS q, event_id, value FROM q WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id) = 1) SELECT entity_id, slot, max(value) FILTER (q = 0.5) AS q50, max(value) FILTER (q = 0.8) AS q80 FROM f GROUP BY 1, 2")
def fp28(spark, sf):
    f = queue_log(spark, sf).filter(F.col("event_type").isin("view", "click")).withColumns({"slot": F.date_format("ts", "yyyy-MM-dd"), "q": F.when(F.col("event_type") == "view", "q50").otherwise("q80")})
    last = first_per(f, ["entity_id", "slot", "q"], F.desc("ts"), "event_id")
    return last.groupBy("entity_id", "slot").pivot("q", ["q50", "q80"]).agg(F.max("value"))


@query("fp30_holdout", f"WITH {Q}, m AS (SELECT max(ts) AS m FROM op) SELECT event_id, ts > m - INTERVAL 7 DAY AS held_out FROM op, m")
def fp30(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    last = rows.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("cut"))
    return rows.crossJoin(F.broadcast(last)).select("event_id", (F.col("ts") > F.col("cut")).alias("held_out"))


def history_features(targets: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Of each target (entity_id, hour of day, day of week): means of the last day, of the same hour and weekday in four weeks, else of seven days, and of the last hour."""
    w, age = F.col("wait"), (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600
    rows = log.withColumns({"age": age, "h": F.hour("ts"), "d": F.dayofweek("ts") - 1}).filter((F.col("age") > 0) & (F.col("age") <= 28 * 24))
    ride = rows.groupBy("entity_id").agg(F.avg(F.when(F.col("age") <= 24, w)).alias("day"), F.avg(F.when(F.col("age") <= 168, w)).alias("week"))
    same = rows.groupBy("entity_id", "h", "d").agg(F.avg("wait").alias("same"))
    out = targets.join(ride, "entity_id", "left").join(same, ["entity_id", "h", "d"], "left")
    return out.select("entity_id", "h", "d", r4(F.col("day")).alias("last_day"), r4(F.coalesce("same", "week")).alias("usual"))


_T = "TIMESTAMP '2024-01-30'"


@query("fp34_history_features", f"WITH {Q}, r AS (SELECT *, (epoch({_T}) - floor(epoch(ts))) / 3600 AS age FROM op WHERE ts < {_T}), x AS (SELECT * FROM r WHERE age > 0 AND age <= 672), a AS (SELECT entity_id, avg(wait) FILTER (age <= 24) AS day, avg(wait) FILTER (age <= 168) AS week FROM x GROUP BY 1), s AS (SELECT entity_id, hour(ts) AS h, extract(dow FROM ts) AS d, avg(wait) AS same FROM x GROUP BY 1, 2, 3), t AS (SELECT DISTINCT entity_id, h, 2 AS d FROM q, (VALUES (10), (14)) v(h)) SELECT t.entity_id, CAST(t.h AS INT) AS h, t.d, round(day, 4) AS last_day, round(coalesce(same, week), 4) AS usual FROM t LEFT JOIN a USING (entity_id) LEFT JOIN s ON t.entity_id = s.entity_id AND t.h = s.h AND t.d = s.d")
def fp34(spark, sf):
    log = queue_log(spark, sf)
    targets = log.select("entity_id").distinct().withColumn("h", F.explode(F.array(F.lit(10), F.lit(14)))).withColumn("d", F.lit(2))
    return history_features(targets, standby_operating(log), F.lit("2024-01-30").cast("timestamp"))


def served_quantile(rows: DataFrame, keys: list[str], targets: tuple[float, float] = (0.5, 0.8)) -> DataFrame:
    """rows (keys, alpha, value): the quantile nearest to each target, the lower of two as near, and how far the top lies above the first. Rows without
    a value don't count, one without alpha is the farthest."""
    gap = lambda t: F.round(F.abs(F.col("alpha") - t), 6)
    pick = lambda t: F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(F.col("alpha").isNull(), gap(t), "alpha")))
    out = rows.groupBy(*keys).agg(pick(targets[0]).alias("wait"), pick(targets[1]).alias("crowd"), F.max("value").alias("top"))
    return out.select(*keys, "wait", "crowd", F.greatest(F.col("top") - F.col("wait"), F.lit(0.0)).alias("uncertainty"))


@query("fp35_served_quantile", f"WITH {Q}, a AS (SELECT entity_id, value, (event_id % 10) / 10.0 AS alpha, event_id FROM q), b AS (SELECT entity_id, alpha, max(value) AS value FROM a GROUP BY 1, 2) SELECT entity_id, arg_min(value, (round(abs(alpha - 0.5), 6), alpha)) AS wait, arg_min(value, (round(abs(alpha - 0.8), 6), alpha)) AS crowd, round(greatest(max(value) - arg_min(value, (round(abs(alpha - 0.5), 6), alpha)), 0), 4) AS uncertainty FROM b GROUP BY 1")
def fp35(spark, sf):
    rows = queue_log(spark, sf).withColumn("alpha", F.col("event_id") % 10 / 10).groupBy("entity_id", "alpha").agg(F.max("value").alias("value"))
    return served_quantile(rows, ["entity_id"]).withColumn("uncertainty", r4(F.col("uncertainty")))


def confidence(lead_h: Column, model: Column, hourly: bool = True) -> Column:
    """0.6 of what time leaves and 0.4 of the model's; hours cost 2 points down to 50, days 0.15 down to 30."""
    time = F.greatest(95 - 2 * lead_h, F.lit(50.0)) if hourly else F.greatest(85 - 0.15 * lead_h / 24, F.lit(30.0))
    return 0.6 * time + 0.4 * model


@query("fp36_fp38_confidence", f"WITH {Q}, x AS (SELECT event_id, 0.6 * greatest(95 - 2 * (wait % 48), 50) + 0.4 * (event_id % 100) AS c, wait % 11 = 0 AS flagged FROM q) SELECT event_id, round(CASE WHEN flagged THEN c / 2 ELSE c END, 4) AS confidence FROM x")
def fp36(spark, sf):
    c = confidence(F.col("wait") % 48, F.col("event_id") % 100)
    return queue_log(spark, sf).select("event_id", r4(F.when(F.col("wait") % 11 == 0, c / 2).otherwise(c)).alias("confidence"))


@query("fp37_daily_reduction", f"WITH {Q} SELECT entity_id, strftime(ts, '%Y-%m-%d') AS day, event_id, wait FROM q QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(ts AS DATE) ORDER BY wait DESC, ts, event_id) = 1")
def fp37(spark, sf):
    rows = queue_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return first_per(rows, ["entity_id", "day"], F.desc("wait"), "ts", "event_id").select("entity_id", "day", "event_id", "wait")


@query("fp29_daily_crowd", f"WITH {Q}, d AS (SELECT park_id, CAST(lts AS DATE) AS day, avg(wait) AS m FROM op GROUP BY 1, 2) SELECT park_id, strftime(day, '%Y-%m-%d') AS day, CASE WHEN m / 2 <= 60 THEN 'very_low' WHEN m / 2 <= 89 THEN 'low' WHEN m / 2 <= 110 THEN 'moderate' WHEN m / 2 <= 150 THEN 'high' WHEN m / 2 <= 200 THEN 'very_high' ELSE 'extreme' END AS level FROM d")
def fp29(spark, sf):
    d = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(F.avg("wait").alias("m"))
    return d.select("park_id", "day", crowd_level(F.col("m") / 2).alias("level"))


@query("fp10_schedule_filter", f"WITH {Q}, {SCHED} SELECT event_id FROM q LEFT JOIN sched s ON q.park_id = s.park_id AND CAST(lts AS DATE) = s.date WHERE type = 'OPERATING' AND hour(lts) BETWEEN 9 AND 19")
def fp10(spark, sf):
    s = schedules(spark, sf).filter("type = 'OPERATING'").select("park_id", F.col("date").alias("day"))
    rows = queue_log(spark, sf).withColumn("day", F.to_date("lts")).join(s, ["park_id", "day"], "left_semi")
    return rows.filter(F.hour("lts").between(9, 19)).select("event_id")
