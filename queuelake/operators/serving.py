"""What serves a request: merges by priority, status rules, calendars, bounded selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.functions import text as X
from queuelake.functions.ladders import crowd_level, ladder
from queuelake.operators.joins import _FC, forecasts
from queuelake.operators.latest import first_per, latest_per
from queuelake.operators.quality import CMP, err, errors, persistence_blend, with_actuals
from queuelake.operators.rollup import SCHED, schedules, standby_operating
from queuelake.operators.stats import OPEN, _open
from queuelake.plans.adaptor import AS_OF, Q, as_of, queue_log, r4, read
from queuelake.registry import query


def speaks_for_today(kind: Column, date: Column, now: Column, entity: Column, kinds: tuple[str, ...] = ("OPERATING", "CLOSED")) -> Column:
    """A park's own row, of a kind that decides, within a day of now: its local date may be yesterday's or tomorrow's."""
    return entity.isNull() & kind.isin(*kinds) & (F.abs(F.datediff(date, F.to_date(now))) <= 1)


@query("flt2_schedule_of_today", f"WITH {Q}, {SCHED} SELECT park_id, strftime(date, '%Y-%m-%d') AS date, type FROM sched WHERE n % 3 <> 0 AND type IN ('OPERATING', 'CLOSED') AND abs(date - DATE '2024-01-20') <= 1")
def flt2(spark, sf):
    s = schedules(spark, sf).withColumn("entity", F.when(F.col("n") % 3 == 0, F.col("n")))
    return s.filter(speaks_for_today(F.col("type"), F.col("date"), F.lit("2024-01-20 12:00:00").cast("timestamp"), F.col("entity"))).select("park_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "type")


@query("prj2_merged_measurements", f"WITH {Q}, a AS (SELECT entity_id, max(wait) FILTER (event_type = 'view') AS h1, max(wait) FILTER (event_type = 'click' AND wait > 300) AS h2, max(wait) FILTER (event_type = 'error') AS h3 FROM q GROUP BY 1) SELECT entity_id, coalesce(CASE WHEN entity_id % 2 = 0 THEN h1 END, h2, h3) AS height, CASE WHEN entity_id % 2 = 0 AND h1 IS NOT NULL THEN 'curated' WHEN h2 IS NOT NULL THEN 'first' WHEN h3 IS NOT NULL THEN 'second' END AS origin FROM a")
def prj2(spark, sf):
    """Field by field, the first source that has it, and which it was."""
    of = lambda on, n: F.max(F.when(on, F.col("wait"))).alias(n)
    kind = F.col("event_type")
    a = queue_log(spark, sf).groupBy("entity_id").agg(of(kind == "view", "h1"), of((kind == "click") & (F.col("wait") > 300), "h2"), of(kind == "error", "h3"))
    sources = [("curated", F.when(F.col("entity_id") % 2 == 0, F.col("h1"))), ("first", F.col("h2")), ("second", F.col("h3"))]
    return a.select("entity_id", F.coalesce(*(c for _, c in sources)).alias("height"), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sources)).alias("origin"))


@query("prj4_rides_by_term", "WITH b AS (SELECT l_partkey, round(quantile_cont(l_quantity, 0.9), 2) AS p90 FROM lineitem GROUP BY 1) SELECT p_partkey, p90 FROM part LEFT JOIN b ON p_partkey = l_partkey WHERE list_contains(string_split(p_name, ' '), 'widget') ORDER BY p90 DESC NULLS LAST, p_partkey LIMIT 25")
def prj4(spark, sf):
    """Rides of a term, the top 25 by their P90 baseline; those without one come last."""
    of_term = read(spark, sf, "part").filter(F.array_contains(F.split("p_name", " "), "widget")).select("p_partkey")
    rows = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity").join(of_term, "p_partkey", "left_semi")
    p90 = rows.groupBy("p_partkey").agg(F.round(F.percentile("l_quantity", 0.9), 2).alias("p90"))
    return of_term.join(p90, "p_partkey", "left").orderBy(F.desc_nulls_last("p90"), "p_partkey").limit(25)


@query("jn22_same_type_matching", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def jn22(spark, sf):
    p = read(spark, sf, "part")
    keys = ["p_type", "p_name", "p_brand"]
    return p.select(*keys, F.col("p_partkey").alias("a")).join(p.select(*keys, F.col("p_partkey").alias("b")), keys).filter("a < b").select("a", "b")


@query("dd12_durable_snapshot", f"WITH {Q}, n AS (SELECT entity_id, strftime(lts, '%Y-%m-%d') AS day, event_id, value FROM q WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(lts AS DATE) ORDER BY ts DESC, event_id DESC) = 1) SELECT entity_id, day, event_id, CASE WHEN entity_id % 4 = 0 THEN value ELSE value END AS value FROM n")
def dd12(spark, sf):
    """The latest prediction of each ride and day, written over what the table had."""
    from queuelake.sources.sinks import upserted

    log = queue_log(spark, sf).filter("event_type = 'view'").withColumn("day", F.date_format("lts", "yyyy-MM-dd"))
    new = latest_per(log, ["entity_id", "day"]).select("entity_id", "day", "event_id", "value")
    return upserted(new.filter("entity_id % 4 = 0").withColumn("value", F.lit(0.0)), new, ["entity_id", "day"])


_G = "list_distinct(list_transform(range(1, length({t})), lambda i: substring({t}, i, 2)))"


@query("dd15_duplicate_parks", f"WITH s AS (SELECT s_suppkey, s_nationkey, s_name AS n, {_G.format(t='s_name')} AS g FROM supplier), p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) SELECT a, b, round(dice, 4) AS dice FROM p WHERE dice >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(dice, 6) DESC, b) = 1")
def dd15(spark, sf):
    s = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    pairs = s.select("s_nationkey", F.col("s_suppkey").alias("a"), F.col("s_name").alias("x")).join(s.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("s_name").alias("y")), "s_nationkey").filter("a <> b")
    best = first_per(pairs.withColumn("dice", F.round(X.dice(F.col("x"), F.col("y")), 6)).filter("dice >= 0.9"), ["a"], F.desc("dice"), "b")
    return best.select("a", "b", r4(F.col("dice")).alias("dice"))


def mean_over_rides(log: DataFrame) -> DataFrame:
    """Of each park the mean and the top over rides of their own, so the mean is never above the top; and the mean of their P90."""
    per = log.groupBy("park_id", "entity_id").agg(F.avg("wait").alias("m"), F.max("wait").alias("t"), F.percentile("wait", F.lit(0.9)).alias("p"))
    return per.groupBy("park_id").agg(r4(F.avg("m")).alias("mean"), F.max("t").alias("top"), r4(F.avg("p")).alias("p90"))


@query("ag7_ag8_mean_over_rides", f"WITH {Q}, r AS (SELECT park_id, entity_id, avg(wait) AS m, max(wait) AS t, quantile_cont(wait, 0.9) AS p FROM op WHERE wait >= 10 GROUP BY 1, 2) SELECT park_id, round(avg(m), 4) AS mean, max(t) AS top, round(avg(p), 4) AS p90 FROM r GROUP BY 1")
def ag7(spark, sf):
    return mean_over_rides(standby_operating(queue_log(spark, sf), 10))


@query("ag13_day_percentile", f"WITH {Q}, h AS (SELECT entity_id, CAST(ts AS DATE) AS d, hour(ts) AS h, quantile_cont(wait, 0.9) AS p FROM op GROUP BY 1, 2, 3) SELECT entity_id, strftime(d, '%Y-%m-%d') AS day, round(quantile_cont(p, 0.9), 4) AS p FROM h WHERE d = DATE '2024-01-15' GROUP BY 1, 2")
def ag13(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).filter(F.to_date("ts") == F.lit("2024-01-15").cast("date"))
    h = rows.groupBy("entity_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts")).agg(F.percentile("wait", F.lit(0.9)).alias("p"))
    return h.groupBy("entity_id", "day").agg(r4(F.percentile("p", F.lit(0.9))).alias("p"))


@query("ag19_ride_baseline", f"WITH {Q} SELECT entity_id, round(quantile_cont(wait, 0.5), 2) AS p50, round(quantile_cont(wait, 0.9), 2) AS p90, count(DISTINCT CAST(lts AS DATE)) AS days, CASE WHEN count(DISTINCT CAST(lts AS DATE)) >= 90 THEN 'high' WHEN count(DISTINCT CAST(lts AS DATE)) >= 15 THEN 'medium' ELSE 'low' END AS confidence FROM op WHERE wait >= 5 GROUP BY 1")
def ag19(spark, sf):
    out = standby_operating(queue_log(spark, sf), 5).groupBy("entity_id").agg(F.round(F.percentile("wait", F.lit(0.5)), 2).alias("p50"), F.round(F.percentile("wait", F.lit(0.9)), 2).alias("p90"), F.countDistinct(F.to_date("lts")).alias("days"))
    return out.withColumn("confidence", F.when(F.col("days") >= 90, "high").when(F.col("days") >= 15, "medium").otherwise("low"))


@query("ag34_discovery_stats", f"WITH {Q}, {SCHED}, {OPEN}, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1) SELECT l.park_id, l.park_id IN (SELECT park_id FROM open) AS is_open, count(*) AS rides, count(*) FILTER (status = 'OPERATING') AS running, round(avg(CASE WHEN status = 'OPERATING' THEN wait END), 4) AS mean FROM l GROUP BY 1")
def ag34(spark, sf):
    on = F.col("status") == "OPERATING"
    now = latest_per(queue_log(spark, sf), ["entity_id"]).groupBy("park_id").agg(F.count(F.lit(1)).alias("rides"), F.count_if(on).alias("running"), r4(F.avg(F.when(on, F.col("wait")))).alias("mean"))
    open_ = _open(spark, sf).withColumn("o", F.lit(True))
    return now.join(open_, "park_id", "left").select("park_id", F.coalesce("o", F.lit(False)).alias("is_open"), "rides", "running", "mean")


@query("ag38_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "orders", "part")))
def ag38(spark, sf):
    out = None
    for t in ("events", "orders", "part"):
        c = read(spark, sf, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        out = c if out is None else out.unionByName(c)
    return out


@query("ag40_any_in_window", f"WITH {Q} SELECT p.park_id, EXISTS (SELECT 1 FROM op WHERE op.park_id = p.park_id AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-20 06:00:00') AS any FROM (SELECT DISTINCT park_id FROM q) p")
def ag40(spark, sf):
    log = queue_log(spark, sf)
    hit = standby_operating(log).filter((F.col("ts") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20 06:00:00").cast("timestamp"))).select("park_id").distinct().withColumn("any", F.lit(True))
    return log.select("park_id").distinct().join(hit, "park_id", "left").select("park_id", F.coalesce("any", F.lit(False)).alias("any"))


@query("ag47_shape_panel", f"WITH {Q} SELECT entity_id, strftime(lts, '%Y-%m-%d') AS day, CAST(hour(lts) * 4 + minute(lts) // 15 AS INT) AS slot, round(quantile_cont(wait, 0.5), 4) AS y FROM op WHERE wait >= 5 GROUP BY 1, 2, 3")
def ag47(spark, sf):
    slot = (F.hour("lts") * 4 + F.floor(F.minute("lts") / 15)).cast("int").alias("slot")
    return standby_operating(queue_log(spark, sf), 5).groupBy("entity_id", F.date_format("lts", "yyyy-MM-dd").alias("day"), slot).agg(r4(F.percentile("wait", F.lit(0.5))).alias("y"))


@query("mq6_performers_vs_realised", f"WITH {Q}, y AS (SELECT entity_id, CAST(ts AS DATE) AS d, quantile_cont(value, 0.9) AS y FROM q WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT entity_id, CAST(ts AS DATE) AS d, value AS p FROM q WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id) = 1) SELECT entity_id, count(*) AS n, round(avg(abs(p - y)), 4) AS mae FROM p JOIN y USING (entity_id, d) GROUP BY 1 HAVING count(*) >= 2")
def mq6(spark, sf):
    log = queue_log(spark, sf).withColumn("d", F.to_date("ts"))
    y = log.filter("event_type = 'click'").groupBy("entity_id", "d").agg(F.percentile("value", F.lit(0.9)).alias("actual"))
    p = first_per(log.filter("event_type = 'view'"), ["entity_id", "d"], F.desc("ts"), "event_id").select("entity_id", "d", F.col("value").alias("predicted"))
    return p.join(y, ["entity_id", "d"]).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(err()))).alias("mae")).filter("n >= 2")


@query("mq17_daily_board", f"WITH {CMP}, x AS (SELECT *, entity_id % 10 = 0 AS head FROM cmp WHERE y IS NOT NULL) SELECT seg AS segment, count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(avg(p - y), 4) AS bias FROM x, (VALUES ('all'), ('busy'), ('headliner')) s(seg) WHERE seg = 'all' OR (seg = 'busy' AND y >= 40) OR (seg = 'headliner' AND head) GROUP BY 1")
def mq17(spark, sf):
    from queuelake.operators.joins import by_segment

    rows = with_actuals(spark, sf).filter(F.col("actual").isNotNull())
    long = by_segment(rows, {"all": F.lit(True), "busy": F.col("actual") >= 40, "headliner": F.col("entity_id") % 10 == 0})
    return long.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(err()))).alias("mae"), r4(F.avg(err())).alias("bias"))


@query("mq19_lead_curve", f"WITH {Q}, {_FC}, l AS (SELECT *, CASE WHEN lead_h <= 1 THEN '1h' WHEN lead_h <= 3 THEN '3h' WHEN lead_h <= 6 THEN '6h' END AS bucket FROM fc) SELECT bucket, count(*) AS n, round(avg(abs(forecast - actual)), 4) AS mae FROM l WHERE bucket IS NOT NULL GROUP BY 1")
def mq19(spark, sf):
    h = F.col("lead_h")
    rows = forecasts(spark, sf).withColumn("bucket", F.when(h <= 1, "1h").when(h <= 3, "3h").when(h <= 6, "6h")).filter("bucket IS NOT NULL")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(F.col("forecast") - F.col("actual")))).alias("mae"))


@query("mq21_blend_in_serving", f"WITH {Q}, {_FC} SELECT target_id, event_id, round(CASE WHEN actual >= 40 THEN greatest(least((3 - lead_h) / 2, 1), 0) * actual + (1 - greatest(least((3 - lead_h) / 2, 1), 0)) * forecast ELSE forecast END, 4) AS blend FROM fc WHERE lead_h <= 3")
def mq21(spark, sf):
    return forecasts(spark, sf).filter("lead_h <= 3").select("target_id", "event_id", r4(persistence_blend(F.col("forecast"), F.col("actual"), F.col("lead_h"))).alias("blend"))


@query("mq24_pooled_means", f"WITH {CMP}, e AS (SELECT entity_id, count(y) AS n, avg(abs(p - y)) AS mae FROM cmp WHERE y IS NOT NULL GROUP BY 1) SELECT round(sum(mae * n) / sum(n), 4) AS pooled, round(avg(mae), 4) AS unpooled FROM e")
def mq24(spark, sf):
    e = with_actuals(spark, sf).filter(F.col("actual").isNotNull()).groupBy("entity_id").agg(F.count("actual").alias("n"), F.avg(F.abs(err())).alias("mae"))
    return e.agg(r4(F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("pooled"), r4(F.avg("mae")).alias("unpooled"))


@query("mq25_train_metrics", f"WITH {CMP} SELECT round(avg(abs(p - y)), 4) AS mae, round(avg(CASE WHEN y > 0 THEN abs(p - y) / y END) * 100, 4) AS mape, round(avg(CASE WHEN y >= 5 THEN abs(p - y) / y END) * 100, 4) AS mape5 FROM cmp")
def mq25(spark, sf):
    share = lambda low, strict: r4(F.avg(F.when((F.col("actual") > low) if strict else (F.col("actual") >= low), F.abs(err()) / F.col("actual"))) * 100)
    return with_actuals(spark, sf).agg(r4(F.avg(F.abs(err()))).alias("mae"), share(0, True).alias("mape"), share(5, False).alias("mape5"))


def bounded_selection(rows: DataFrame, key: str, most: int, most_domestic: int) -> DataFrame:
    """Of each key's neighbours by priority, the first so many, of which so many of its own country: two ranks, no loop."""
    own = F.row_number().over(Window.partitionBy(key, "domestic").orderBy("priority", "id"))
    rows = rows.withColumn("_o", own).filter(~F.col("domestic") | (F.col("_o") <= most_domestic))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("priority", "id"))).filter(F.col("_k") <= most).drop("_o", "_k")


@query("so3_bounded_selection", "WITH r AS (SELECT s_nationkey AS k, s_suppkey AS id, s_suppkey % 5 AS priority, s_suppkey % 2 = 0 AS domestic FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY k, domestic ORDER BY priority, id) AS o FROM r) SELECT k, id FROM o WHERE NOT domestic OR o <= 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority, id) <= 3")
def so3(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("priority"), (F.col("s_suppkey") % 2 == 0).alias("domestic"))
    return bounded_selection(rows, "k", 3, 1).select("k", "id")


@query("so1_top_of_all", f"WITH {Q} SELECT event_id, wait FROM op ORDER BY wait DESC, event_id LIMIT 40")
def so1(spark, sf):
    return standby_operating(queue_log(spark, sf)).orderBy(F.desc("wait"), "event_id").limit(40).select("event_id", "wait")


@query("so5_best_days", f"WITH {Q} SELECT park_id, strftime(lts, '%Y-%m-%d') AS day, round(avg(wait), 4) AS level FROM op WHERE CAST(lts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY 1, 2")
def so5(spark, sf):
    day = F.to_date("lts")
    rows = standby_operating(queue_log(spark, sf)).filter(day.between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-16").cast("date")))
    return rows.groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(r4(F.avg("wait")).alias("level"))


@query("sc17_date_parts", f"WITH {Q} SELECT event_id, CAST(month(lts) AS INT) AS m, CAST(dayofyear(lts) AS INT) AS doy, lpad(CAST(hour(lts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(lts) AS VARCHAR), 2, '0') AS hm, strftime(date_trunc('week', lts), '%Y-%m-%d') AS week, split_part(strftime(lts, '%Y-%m-%d'), '-', 3) AS dd FROM q")
def sc17(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return queue_log(spark, sf).select("event_id", F.month("lts").alias("m"), F.dayofyear("lts").alias("doy"), F.concat(two(F.hour("lts")), F.lit(":"), two(F.minute("lts"))).alias("hm"), F.date_format(F.date_trunc("WEEK", "lts"), "yyyy-MM-dd").alias("week"), F.split_part(F.date_format("lts", "yyyy-MM-dd"), F.lit("-"), F.lit(3)).alias("dd"))


@query("sc18_numeric", f"WITH {Q} SELECT event_id, greatest(wait, 100) AS g, least(wait, 100) AS l, coalesce(nullif(wait, 7), -1) AS c, abs(wait - 200) AS a, round(sqrt(value), 4) AS s, round(power(wait, 2), 2) AS p FROM q")
def sc18(spark, sf):
    w = F.col("wait")
    return queue_log(spark, sf).select("event_id", F.greatest(w, F.lit(100)).alias("g"), F.least(w, F.lit(100)).alias("l"), F.coalesce(F.nullif(w, F.lit(7)), F.lit(-1)).alias("c"), F.abs(w - 200).alias("a"), r4(F.sqrt("value")).alias("s"), F.round(F.pow(w, F.lit(2.0)), 2).alias("p"))


def is_weekend(day: Column, country: Column, friday: tuple[str, ...] = ("SA", "AE", "QA", "KW")) -> Column:
    """Saturday and Sunday; Friday and Saturday where that is the custom."""
    d = F.dayofweek(day)
    return F.when(country.isin(*friday), d.isin(6, 7)).otherwise(d.isin(1, 7))


@query("sc20_regional_weekend", f"WITH {Q} SELECT event_id, CASE WHEN park_id = 3 THEN extract(dow FROM lts) IN (5, 6) ELSE extract(dow FROM lts) IN (0, 6) END AS weekend FROM q")
def sc20(spark, sf):
    return queue_log(spark, sf).select("event_id", is_weekend(F.col("lts"), F.when(F.col("park_id") == 3, "SA").otherwise("DE")).alias("weekend"))


def holiday_info(days: DataFrame, key: str) -> DataFrame:
    """days (key, day, holiday): whether a day is one, or a bridge: a working day between a holiday and a weekend or another."""
    w = Window.partitionBy(key).orderBy("day")
    off = lambda c, d: F.coalesce(c, F.lit(False)) | F.dayofweek(d).isin(1, 7)
    before, after = off(F.lag("holiday").over(w), F.date_sub("day", 1)), off(F.lead("holiday").over(w), F.date_add("day", 1))
    beside = F.coalesce(F.lag("holiday").over(w), F.lit(False)) | F.coalesce(F.lead("holiday").over(w), F.lit(False))
    return days.withColumn("bridge", ~F.col("holiday") & ~F.dayofweek("day").isin(1, 7) & before & after & beside)


_CAL = "cal AS (SELECT k, CAST(d AS DATE) AS day, EXISTS (SELECT 1 FROM events WHERE user_id % 4 = k AND CAST(ts AS DATE) = CAST(d AS DATE) AND value > 330) AS holiday FROM range(4) r(k), generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d))"


def calendar(spark, sf) -> DataFrame:
    grid = spark.range(4).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("day"))
    hit = read(spark, sf, "events").filter("value > 330").select((F.col("user_id") % 4).alias("k"), F.to_date("ts").alias("day")).distinct().withColumn("holiday", F.lit(True))
    return grid.join(hit, ["k", "day"], "left").fillna(False, ["holiday"])


@query("sc22_sc38_bridge_days", f"WITH {_CAL}, n AS (SELECT *, coalesce(lag(holiday) OVER w, false) AS b, coalesce(lead(holiday) OVER w, false) AS a FROM cal WINDOW w AS (PARTITION BY k ORDER BY day)) SELECT k, strftime(day, '%Y-%m-%d') AS day, holiday, NOT holiday AND extract(dow FROM day) NOT IN (0, 6) AND (b OR extract(dow FROM day - 1) IN (0, 6)) AND (a OR extract(dow FROM day + 1) IN (0, 6)) AND (a OR b) AS bridge FROM n")
def sc22(spark, sf):
    return holiday_info(calendar(spark, sf), "k").select("k", F.date_format("day", "yyyy-MM-dd").alias("day"), "holiday", "bridge")


def status_without_data(status: Column, wait: Column, fresh: Column, park_open: Column) -> Column:
    """A shut park shuts its rides; an open one with fresh rows and no wait is free flow; without fresh rows it isn't known."""
    return F.when(~park_open, "CLOSED").when(~fresh, "UNKNOWN").when((status == "OPERATING") & wait.isNull(), "FREE_FLOW").otherwise(status)


@query("sc26_sc27_status_rules", f"WITH {Q} SELECT event_id, CASE WHEN NOT (park_id <> 3) THEN 'CLOSED' WHEN NOT (ts >= TIMESTAMP '2024-01-03') THEN 'UNKNOWN' WHEN status = 'OPERATING' AND wait % 9 = 0 THEN 'FREE_FLOW' ELSE status END AS status FROM q")
def sc26(spark, sf):
    wait = F.when(F.col("wait") % 9 != 0, F.col("wait"))
    return queue_log(spark, sf).select("event_id", status_without_data(F.col("status"), wait, F.col("ts") >= F.lit("2024-01-03").cast("timestamp"), F.col("park_id") != 3).alias("status"))


@query("sc32_sc33_arrays", "SELECT p_type, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS sizes, len(list(p_partkey)) AS n, list_contains(list(p_size), 7) AS has7 FROM part GROUP BY 1")
def sc32(spark, sf):
    sizes = F.sort_array(F.collect_set("p_size"))
    return read(spark, sf, "part").groupBy("p_type").agg(F.array_join(F.transform(sizes, lambda x: x.cast("string")), ",").alias("sizes"), F.count(F.lit(1)).alias("n"), F.bool_or(F.col("p_size") == 7).alias("has7"))


@query("sc35_patterns", "SELECT page_id, regexp_matches(url, '^https://') AS secure, regexp_replace(url, '\\?.*$', '') AS bare FROM pages")
def sc35(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.col("url").rlike("^https://").alias("secure"), F.regexp_replace("url", r"\?.*$", "").alias("bare"))


@query("sc2_index_ladder", f"WITH {Q} SELECT event_id, CASE WHEN wait IS NULL THEN 'unknown' WHEN wait <= 100 THEN 'a' WHEN wait <= 300 THEN 'b' ELSE 'c' END AS step FROM q")
def sc2(spark, sf):
    return queue_log(spark, sf).select("event_id", ladder(F.col("wait"), [(100, "a"), (300, "b")], "c").alias("step"))


@query("fp5_local_time", f"WITH {Q} SELECT event_id, strftime(lts, '%Y-%m-%d %H:%M:%S') AS local FROM q")
def fp5(spark, sf):
    return queue_log(spark, sf).select("event_id", F.date_format("lts", "yyyy-MM-dd HH:mm:ss").alias("local"))


@query("fp6_downtime_features", f"WITH {Q}, v AS (SELECT DISTINCT entity_id FROM q WHERE queue_type = 'PAID' AND wait > 450) SELECT event_id, count(*) FILTER (status = 'DOWN') OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL '2 days' PRECEDING AND INTERVAL '1 microsecond' PRECEDING) AS down_2d, v.entity_id IS NOT NULL AS virtual, (hour(lts) * wait) AS hour_wait FROM q LEFT JOIN v USING (entity_id)")
def fp6(spark, sf):
    from queuelake.operators.windows import by_time

    log = queue_log(spark, sf)
    v = log.filter("queue_type = 'PAID' AND wait > 450").select("entity_id").distinct().withColumn("v", F.lit(True))
    rows = log.join(v, "entity_id", "left")
    return rows.select("event_id", F.count_if(F.col("status") == "DOWN").over(by_time(2 * 86400, "entity_id")).alias("down_2d"), F.coalesce("v", F.lit(False)).alias("virtual"), (F.hour("lts").cast("long") * F.col("wait")).alias("hour_wait"))


@query("fp13_aligned_axis", f"WITH {Q}, o AS (SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS pos, k AS entity_id FROM (VALUES (3), (500), (7), (9)) t(k)) SELECT pos, o.entity_id, coalesce(round(avg(wait), 4), 0) AS y, count(wait) > 0 AS present FROM o LEFT JOIN op ON o.entity_id = op.entity_id GROUP BY 1, 2")
def fp13(spark, sf):
    """Rides in the order that a model was trained with; a missing ride is filled."""
    order = spark.createDataFrame(list(enumerate([3, 7, 9, 500])), "pos int, entity_id int")
    rows = order.join(standby_operating(queue_log(spark, sf)).select("entity_id", "wait"), "entity_id", "left")
    return rows.groupBy("pos", "entity_id").agg(F.coalesce(r4(F.avg("wait")), F.lit(0.0)).alias("y"), (F.count("wait") > 0).alias("present"))


@query("fp22_predicted_levels", f"WITH {Q}, p AS (SELECT park_id, strftime(lts, '%Y-%m-%d') AS day, avg(wait) AS w FROM q WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT park_id, quantile_cont(wait, 0.5) AS base FROM op GROUP BY 1), x AS (SELECT p.park_id, day, w / base * 100 AS x FROM p JOIN b USING (park_id)) SELECT park_id, day, CASE WHEN x <= 60 THEN 'very_low' WHEN x <= 89 THEN 'low' WHEN x <= 110 THEN 'moderate' WHEN x <= 150 THEN 'high' WHEN x <= 200 THEN 'very_high' ELSE 'extreme' END AS level FROM x")
def fp22(spark, sf):
    log = queue_log(spark, sf)
    p = log.filter("event_type = 'view'").groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(F.avg("wait").alias("w"))
    b = standby_operating(log).groupBy("park_id").agg(F.percentile("wait", F.lit(0.5)).alias("base"))
    return p.join(b, "park_id").select("park_id", "day", crowd_level(F.col("w") / F.col("base") * 100).alias("level"))


@query("fp26_fresh_forecasts", f"WITH {Q}, {_FC} SELECT entity_id, strftime(target, '%Y-%m-%d') AS day, event_id, forecast FROM fc WHERE lead_h <= 36 AND entity_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(target AS DATE) ORDER BY lead_h, target_id, event_id) = 1")
def fp26(spark, sf):
    rows = forecasts(spark, sf).filter("lead_h <= 36 AND entity_id % 3 = 0").withColumn("day", F.date_format("target", "yyyy-MM-dd"))
    return first_per(rows, ["entity_id", "day"], "lead_h", "target_id", "event_id").select("entity_id", "day", "event_id", "forecast")


@query("fp27_intraday_override", f"WITH {Q}, d AS (SELECT entity_id, CAST(ts AS DATE) AS d, event_id, value FROM q WHERE event_type = 'view'), o AS (SELECT entity_id, CAST(ts AS DATE) AS d, max(value) AS q80, min(value) AS q50 FROM q WHERE event_type = 'click' GROUP BY 1, 2) SELECT event_id, coalesce(q50, value) AS shown, greatest(coalesce(q80, value), coalesce(q50, value)) AS crowd, q50 IS NOT NULL AS overridden FROM d LEFT JOIN o USING (entity_id, d)")
def fp27(spark, sf):
    log = queue_log(spark, sf).withColumn("d", F.to_date("ts"))
    o = log.filter("event_type = 'click'").groupBy("entity_id", "d").agg(F.max("value").alias("q80"), F.min("value").alias("q50"))
    rows = log.filter("event_type = 'view'").join(o, ["entity_id", "d"], "left")
    shown = F.coalesce("q50", "value")
    return rows.select("event_id", shown.alias("shown"), F.greatest(F.coalesce("q80", "value"), shown).alias("crowd"), F.col("q50").isNotNull().alias("overridden"))


@query("fp32_serving_weather", f"WITH {Q}, f AS (SELECT park_id, date_trunc('hour', ts) AS h, avg(value) AS t FROM q WHERE event_type = 'error' GROUP BY 1, 2), c AS (SELECT park_id, month(ts) AS m, avg(value) AS t FROM q WHERE event_type = 'error' GROUP BY 1, 2) SELECT event_id, round(coalesce(f.t, c.t), 4) AS t, f.t IS NOT NULL AS forecast FROM op LEFT JOIN f ON op.park_id = f.park_id AND date_trunc('hour', op.ts + INTERVAL 30 MINUTE) = f.h LEFT JOIN c ON op.park_id = c.park_id AND month(op.ts) = c.m")
def fp32(spark, sf):
    """The forecast of the nearest hour, else the month's usual."""
    log = queue_log(spark, sf)
    w = log.filter("event_type = 'error'")
    f = w.groupBy("park_id", F.date_trunc("HOUR", "ts").alias("h")).agg(F.avg("value").alias("ft"))
    c = w.groupBy("park_id", F.month("ts").alias("m")).agg(F.avg("value").alias("ct"))
    rows = standby_operating(log).withColumns({"h": F.date_trunc("HOUR", F.col("ts") + F.expr("INTERVAL 30 MINUTES")), "m": F.month("ts")})
    return rows.join(f, ["park_id", "h"], "left").join(c, ["park_id", "m"], "left").select("event_id", r4(F.coalesce("ft", "ct")).alias("t"), F.col("ft").isNotNull().alias("forecast"))


@query("fp33_row_status", f"WITH {Q}, {SCHED} SELECT event_id, CASE WHEN s.type = 'OPERATING' THEN 'OPERATING' WHEN s.type IS NULL OR s.type = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'CLOSED' END AS park, coalesce(s.type = 'INFO', false) AS event FROM q LEFT JOIN sched s ON q.park_id = s.park_id AND CAST(lts AS DATE) = s.date")
def fp33(spark, sf):
    s = schedules(spark, sf).select("park_id", F.col("date").alias("day"), "type")
    rows = queue_log(spark, sf).withColumn("day", F.to_date("lts")).join(s, ["park_id", "day"], "left")
    t = F.col("type")
    return rows.select("event_id", F.when(t == "OPERATING", "OPERATING").when(t.isNull() | (t == "UNKNOWN"), "UNKNOWN").otherwise("CLOSED").alias("park"), F.coalesce(t == "INFO", F.lit(False)).alias("event"))


@query("st4_valid_since", f"WITH {Q}, o AS (SELECT park_id, min(lts) AS opens FROM op WHERE CAST(lts AS DATE) = DATE '2024-01-20' AND park_id < 5 GROUP BY 1) SELECT event_id FROM q LEFT JOIN o USING (park_id) WHERE lts >= coalesce(opens, TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 6 HOUR)")
def st4(spark, sf):
    log = queue_log(spark, sf)
    o = standby_operating(log).filter((F.to_date("lts") == F.lit("2024-01-20").cast("date")) & (F.col("park_id") < 5)).groupBy("park_id").agg(F.min("lts").alias("opens"))
    cut = F.coalesce("opens", F.lit("2024-01-20 06:00:00").cast("timestamp"))
    return log.join(o, "park_id", "left").filter(F.col("lts") >= cut).select("event_id")


@query("st5_frozen_feeds", f"WITH {Q} SELECT park_id, CAST(floor(epoch(ts) / 14400) * 14400 AS BIGINT) AS window_start, count(DISTINCT (entity_id, wait, status)) <= count(DISTINCT entity_id) AS frozen FROM q GROUP BY 1, 2")
def st5(spark, sf):
    w = F.window("ts", "4 hours")
    return queue_log(spark, sf).groupBy("park_id", w).agg(F.countDistinct("entity_id", "wait", "status").alias("moves"), F.countDistinct("entity_id").alias("rides")).select("park_id", F.unix_timestamp("window.start").alias("window_start"), (F.col("moves") <= F.col("rides")).alias("frozen"))


@query("snk4_forecast_upsert", f"WITH {Q}, {_FC} SELECT entity_id, target_id, event_id, CASE WHEN lead_h <= 6 THEN forecast + 1 ELSE forecast END AS forecast FROM fc")
def snk4(spark, sf):
    from queuelake.sources.sinks import upserted

    rows = forecasts(spark, sf).select("entity_id", "target_id", "event_id", "forecast", "lead_h")
    return upserted(rows, rows.filter("lead_h <= 6").withColumn("forecast", F.col("forecast") + 1), ["target_id", "event_id"]).drop("lead_h")


@query("snk5_purge_counts", f"WITH {Q} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS deleted FROM q WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY 1")
def snk5(spark, sf):
    return queue_log(spark, sf).filter(F.col("ts") < as_of() - F.expr("INTERVAL 20 DAYS")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("deleted"))
