"""Window functions: rolling by rows and by time, fills, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.operators.latest import first_per
from queuelake.operators.rollup import standby_operating
from queuelake.plans.adaptor import Q, queue_log, r4
from queuelake.registry import query

MICROS = 1_000_000


def ordered(*keys: str):
    return Window.partitionBy(*keys).orderBy("ts", "event_id")


def by_time(seconds: int, *keys: str, closed_left: bool = True):
    """The frame of the seconds before a row, without the row's own instant."""
    return Window.partitionBy(*keys).orderBy(F.unix_micros("ts")).rangeBetween(-seconds * MICROS, -1 if closed_left else 0)


def ticker(log: DataFrame, most: int = 40) -> DataFrame:
    """The one ride of each park to show, running ones first, longest wait first; then the top of all parks."""
    now = first_per(log, ["entity_id"], F.desc("ts"), F.desc("event_id"))
    top = first_per(now, ["park_id"], F.when(F.col("status") == "OPERATING", 0).when(F.col("status") == "DOWN", 1).otherwise(2), F.desc("wait"), "entity_id")
    return top.orderBy(F.desc("wait"), "park_id").limit(most)


@query("wn1_ticker", f"WITH {Q}, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1), t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY CASE status WHEN 'OPERATING' THEN 0 WHEN 'DOWN' THEN 1 ELSE 2 END, wait DESC, entity_id) = 1) SELECT park_id, entity_id, status, wait FROM t ORDER BY wait DESC, park_id LIMIT 5")
def wn1(spark, sf):
    return ticker(queue_log(spark, sf), 5).select("park_id", "entity_id", "status", "wait")


def gaps(days: DataFrame, key: str, over: int = 21) -> DataFrame:
    """The longest gap between a key's days, and whether it is a season's break."""
    nxt = F.lead("day").over(Window.partitionBy(key).orderBy("day"))
    return days.select(key, "day").distinct().withColumn("gap", F.datediff(nxt, "day")).groupBy(key).agg(F.max("gap").alias("longest"), F.max(F.coalesce(F.col("gap") > over, F.lit(False))).alias("seasonal"))


@query("wn2_ag57_season_gap", f"WITH {Q}, d AS (SELECT DISTINCT entity_id, CAST(lts AS DATE) AS day FROM op), g AS (SELECT entity_id, lead(day) OVER (PARTITION BY entity_id ORDER BY day) - day AS gap FROM d) SELECT entity_id, CAST(max(gap) AS INT) AS longest, bool_or(coalesce(gap > 5, false)) AS seasonal FROM g GROUP BY 1")
def wn2(spark, sf):
    return gaps(standby_operating(queue_log(spark, sf)).withColumn("day", F.to_date("lts")), "entity_id", 5)


def rolling_rows(log: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Mean and deviation over the last so many rows, with means of weekday and weekend rows alone."""
    out, free = log, F.dayofweek("lts").isin(1, 7)
    for n in sizes:
        w = ordered("entity_id").rowsBetween(-n + 1, 0)
        out = out.withColumns({f"mean_{n}": r4(F.avg("wait").over(w)), f"sd_{n}": r4(F.stddev_samp("wait").over(w)), f"weekend_{n}": r4(F.avg(F.when(free, F.col("wait"))).over(w)), f"weekday_{n}": r4(F.avg(F.when(~free, F.col("wait"))).over(w))})
    return out


def _rows_sql(n: int) -> str:
    w = f"OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    we = "extract(dow FROM lts) IN (0, 6)"
    return f"round(avg(wait) {w}, 4) AS mean_{n}, round(stddev_samp(wait) {w}, 4) AS sd_{n}, round(avg(CASE WHEN {we} THEN wait END) {w}, 4) AS weekend_{n}, round(avg(CASE WHEN NOT {we} THEN wait END) {w}, 4) AS weekday_{n}"


@query("wn3_rolling_rows", f"WITH {Q} SELECT event_id, {_rows_sql(8)}, {_rows_sql(24)} FROM op")
def wn3(spark, sf):
    out = rolling_rows(standby_operating(queue_log(spark, sf)), (8, 24))
    return out.select("event_id", *[f"{k}_{n}" for n in (8, 24) for k in ("mean", "sd", "weekend", "weekday")])


def rolling_time(log: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Means over time spans before each row, which is left out."""
    return log.withColumns({k: r4(F.avg("wait").over(by_time(s, "entity_id"))) for k, s in spans.items()})


def _time(days: int) -> str:
    return f"OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL '{days} days' PRECEDING AND INTERVAL '1 microsecond' PRECEDING)"


@query("wn4_rolling_time", f"WITH {Q} SELECT event_id, round(avg(wait) {_time(1)}, 4) AS d1, round(avg(wait) {_time(7)}, 4) AS d7, round(avg(wait) {_time(28)}, 4) AS d28 FROM op")
def wn4(spark, sf):
    return rolling_time(standby_operating(queue_log(spark, sf)), {"d1": 86400, "d7": 7 * 86400, "d28": 28 * 86400}).select("event_id", "d1", "d7", "d28")


def volatility(log: DataFrame, seconds: int, cap: float = 30.0) -> DataFrame:
    sd = F.stddev_samp("wait").over(by_time(seconds, "entity_id"))
    return log.withColumn("volatility", r4(F.least(F.log1p(sd), F.log1p(F.lit(cap)))))


@query("wn5_volatility", f"WITH {Q}, s AS (SELECT event_id, stddev_samp(wait) {_time(7)} AS sd FROM op) SELECT event_id, round(CASE WHEN sd IS NULL THEN ln(121) ELSE least(ln(1 + sd), ln(121)) END, 4) AS volatility FROM s")
def wn5(spark, sf):
    return volatility(standby_operating(queue_log(spark, sf)), 7 * 86400, 120).select("event_id", "volatility")


def velocity(log: DataFrame, n: int = 6) -> DataFrame:
    """The mean of the last n changes before the row."""
    w = ordered("entity_id")
    return log.withColumn("step", F.col("wait") - F.lag("wait").over(w)).withColumn("velocity", r4(F.avg("step").over(w.rowsBetween(-n, -1))))


@query("wn6_velocity", f"WITH {Q}, s AS (SELECT *, wait - lag(wait) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS step FROM op) SELECT event_id, round(avg(step) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS velocity FROM s")
def wn6(spark, sf):
    return velocity(standby_operating(queue_log(spark, sf))).select("event_id", "velocity")


def off_median(log: DataFrame, radius: int = 3) -> DataFrame:
    """A row's distance from the centred rolling median of its ride, and from its park's median of the day."""
    ride = F.percentile("wait", F.lit(0.5)).over(ordered("entity_id").rowsBetween(-radius, radius))
    park = F.percentile("wait", F.lit(0.5)).over(Window.partitionBy("park_id", F.to_date("lts")))
    return log.withColumns({"off_ride": r4(F.col("wait") - ride), "off_park": r4(F.col("wait") - park)})


@query("wn7_off_median", f"WITH {Q} SELECT event_id, round(wait - quantile_cont(wait, 0.5) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS off_ride, round(wait - quantile_cont(wait, 0.5) OVER (PARTITION BY park_id, CAST(lts AS DATE)), 4) AS off_park FROM op")
def wn7(spark, sf):
    return off_median(standby_operating(queue_log(spark, sf))).select("event_id", "off_ride", "off_park")


def switches(log: DataFrame, on: Column) -> DataFrame:
    """Rows where a park's condition starts or stops."""
    before = F.lag(on.cast("int")).over(ordered("park_id"))
    return log.withColumns({"starts": on & (before == 0), "stops": ~on & (before == 1)})


@query("wn8_switches", f"WITH {Q}, s AS (SELECT event_id, park_id, ts, wait >= 250 AS o, lag(wait >= 250) OVER (PARTITION BY park_id ORDER BY ts, event_id) AS b, sum(wait) OVER (PARTITION BY park_id ORDER BY ts RANGE BETWEEN INTERVAL '3 hours' PRECEDING AND INTERVAL '1 microsecond' PRECEDING) AS s3 FROM q) SELECT event_id, (o AND NOT b) AS starts, (NOT o AND b) AS stops, CAST(s3 AS BIGINT) AS s3 FROM s")
def wn8(spark, sf):
    out = switches(queue_log(spark, sf), F.col("wait") >= 250)
    return out.select("event_id", "starts", "stops", F.sum("wait").over(by_time(10800, "park_id")).alias("s3"))


@query("wn9_downtime_today", f"WITH {Q} SELECT event_id, CAST(sum(CAST(status = 'DOWN' AS INT)) OVER (PARTITION BY entity_id, CAST(lts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS down FROM q")
def wn9(spark, sf):
    w = Window.partitionBy("entity_id", F.to_date("lts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return queue_log(spark, sf).select("event_id", F.sum((F.col("status") == "DOWN").cast("int")).over(w).alias("down"))


def rolling_percentile(log: DataFrame, rows: int, least: int, q: float = 0.9) -> DataFrame:
    w = ordered("park_id").rowsBetween(-rows + 1, 0)
    return log.withColumn("p", F.when(F.count("wait").over(w) >= least, r4(F.percentile("wait", F.lit(q)).over(w))))


@query("wn10_rolling_percentile", f"WITH {Q} SELECT event_id, CASE WHEN count(wait) OVER w >= 30 THEN round(quantile_cont(wait, 0.9) OVER w, 4) END AS p FROM op WINDOW w AS (PARTITION BY park_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def wn10(spark, sf):
    return rolling_percentile(standby_operating(queue_log(spark, sf)), 60, 30).select("event_id", "p")


def filled_with_means(rows: DataFrame, value: str, group: str, month: Column) -> DataFrame:
    """A missing value becomes its group's mean, else the mean of all; with its distance from the group's mean of the month."""
    whole = rows.agg(F.avg(value).alias("_all"))
    own = F.avg(value).over(Window.partitionBy(group))
    out = rows.crossJoin(F.broadcast(whole)).withColumn("filled", F.coalesce(value, own, "_all"))
    return out.withColumn("off", F.col("filled") - F.avg("filled").over(Window.partitionBy(group, month)))


@query("wn11_group_fill", f"WITH {Q}, v AS (SELECT *, CASE WHEN park_id = 3 OR wait % 7 = 0 THEN NULL ELSE wait END AS x FROM op), f AS (SELECT *, coalesce(x, avg(x) OVER (PARTITION BY park_id), (SELECT avg(x) FROM v)) AS filled FROM v) SELECT event_id, round(filled, 4) AS filled, round(filled - avg(filled) OVER (PARTITION BY park_id, month(lts)), 4) AS off FROM f")
def wn11(spark, sf):
    rows = standby_operating(queue_log(spark, sf)).withColumn("x", F.when((F.col("park_id") != 3) & (F.col("wait") % 7 != 0), F.col("wait")))
    return filled_with_means(rows, "x", "park_id", F.month("lts")).select("event_id", r4(F.col("filled")).alias("filled"), r4(F.col("off")).alias("off"))


def forward_filled(log: DataFrame, value: Column, rows: int | None = None) -> Column:
    w = ordered("entity_id").rowsBetween(Window.unboundedPreceding if rows is None else -rows, 0)
    return F.last(value, ignorenulls=True).over(w)


_X = "x AS (SELECT *, CASE WHEN wait % 3 = 0 THEN wait END AS v FROM q)"
_FF = "OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query("wn12_forward_fill", f"WITH {Q}, {_X} SELECT event_id, coalesce(last_value(v IGNORE NULLS) {_FF.format(n='UNBOUNDED')}, 0) AS filled FROM x")
def wn12(spark, sf):
    log = queue_log(spark, sf)
    return log.select("event_id", F.coalesce(forward_filled(log, F.when(F.col("wait") % 3 == 0, F.col("wait"))), F.lit(0)).alias("filled"))


@query("wn14_bounded_fill", f"WITH {Q}, {_X} SELECT event_id, last_value(v IGNORE NULLS) {_FF.format(n=4)} AS filled FROM x")
def wn14(spark, sf):
    log = queue_log(spark, sf)
    return log.select("event_id", forward_filled(log, F.when(F.col("wait") % 3 == 0, F.col("wait")), 4).alias("filled"))


def smoothed(curve: DataFrame, keys: list[str], slot: str, value: str, radius: int = 2) -> DataFrame:
    """Centred moving mean over neighbouring slots, without nulls."""
    return curve.withColumn("smooth", r4(F.avg(value).over(Window.partitionBy(*keys).orderBy(slot).rowsBetween(-radius, radius))))


@query("wn13_smooth_curve", f"WITH {Q}, h AS (SELECT park_id, CAST(hour(lts) AS INT) AS hour, avg(CASE WHEN wait % 2 = 0 THEN wait END) AS m FROM op GROUP BY 1, 2) SELECT park_id, hour, round(avg(m) OVER (PARTITION BY park_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM h")
def wn13(spark, sf):
    h = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.hour("lts").alias("hour")).agg(F.avg(F.when(F.col("wait") % 2 == 0, F.col("wait"))).alias("m"))
    return smoothed(h, ["park_id"], "hour", "m").select("park_id", "hour", "smooth")


def islands(log: DataFrame, on: Column) -> DataFrame:
    """Runs of rows of a park on which a condition holds: start, end, length."""
    w = ordered("park_id")
    marked = log.withColumn("_on", on).withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_on").groupBy("park_id", F.col("_run").alias("run")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.max("wait").alias("top"))


@query("sc28_islands", f"WITH {Q}, a AS (SELECT *, wait >= 250 AS o, lag(wait >= 250, 1, false) OVER (PARTITION BY park_id ORDER BY ts, event_id) AS b FROM q), r AS (SELECT *, sum(CAST(o AND NOT b AS INT)) OVER (PARTITION BY park_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT park_id, CAST(run AS BIGINT) AS run, min(event_id) AS first_id, count(*) AS n, max(wait) AS top FROM r WHERE o GROUP BY 1, 2")
def sc28(spark, sf):
    return islands(queue_log(spark, sf), F.col("wait") >= 250)


def regular_grid(panel: DataFrame, seconds: int) -> DataFrame:
    """panel (park_id, entity_id, slot, y): every ride at every slot between its park's first and last; ``observed`` marks what was there."""
    span = panel.groupBy("park_id").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    slots = span.select("park_id", F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("slot"))
    grid = panel.select("park_id", "entity_id").distinct().join(slots, "park_id")
    return grid.join(panel, ["park_id", "entity_id", "slot"], "left").withColumn("observed", F.col("y").isNotNull())


_PANEL = "panel AS (SELECT park_id, entity_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS slot, quantile_cont(wait, 0.5) AS y FROM op WHERE wait >= 5 GROUP BY 1, 2, 3), sp AS (SELECT park_id, min(slot) AS a, max(slot) AS b FROM panel GROUP BY 1), grid AS (SELECT r.park_id, entity_id, unnest(range(a, b + 1, 86400)) AS slot FROM (SELECT DISTINCT park_id, entity_id FROM panel) r JOIN sp ON r.park_id = sp.park_id), tensor AS (SELECT g.*, y, y IS NOT NULL AS observed FROM grid g LEFT JOIN panel p ON g.entity_id = p.entity_id AND g.slot = p.slot)"


def daily_panel(spark, sf) -> DataFrame:
    slot = (F.floor(F.unix_timestamp("ts") / 86400) * 86400).cast("long")
    return standby_operating(queue_log(spark, sf), 5).groupBy("park_id", "entity_id", slot.alias("slot")).agg(F.percentile("wait", F.lit(0.5)).alias("y"))


@query("fp11_regular_grid", f"WITH {Q}, {_PANEL} SELECT entity_id, slot, round(y, 4) AS y, observed FROM tensor")
def fp11(spark, sf):
    return regular_grid(daily_panel(spark, sf), 86400).select("entity_id", "slot", r4(F.col("y")).alias("y"), "observed")


def tensor(grid: DataFrame, least_open: int = 3) -> DataFrame:
    """Channels of the grid: the filled value, the mask, the park's mean of what was observed, whether enough rides report, the day of week as a circle."""
    w = Window.partitionBy("entity_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slot = Window.partitionBy("park_id", "slot")
    angle = 2 * 3.141592653589793 * F.weekday(F.timestamp_seconds("slot")) / 7
    return grid.withColumns({
        "filled": F.coalesce(F.last("y", ignorenulls=True).over(w), F.lit(0.0)), "park_mean": F.avg("y").over(slot), "park_open": F.count("y").over(slot) >= least_open, "sin_dow": F.sin(angle), "cos_dow": F.cos(angle),
    })


@query("fp12_tensor", f"WITH {Q}, {_PANEL} SELECT entity_id, slot, round(coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY slot ROWS UNBOUNDED PRECEDING), 0), 4) AS filled, observed, round(avg(y) OVER s, 4) AS park_mean, count(y) OVER s >= 3 AS park_open, round(sin(2 * 3.141592653589793 * ((extract(dow FROM make_timestamp(slot * 1000000)) + 6) % 7) / 7), 4) AS sin_dow FROM tensor WINDOW s AS (PARTITION BY park_id, slot)")
def fp12(spark, sf):
    return tensor(regular_grid(daily_panel(spark, sf), 86400)).select("entity_id", "slot", r4(F.col("filled")).alias("filled"), "observed", r4(F.col("park_mean")).alias("park_mean"), "park_open", r4(F.col("sin_dow")).alias("sin_dow"))


def context_windows(panel: DataFrame, length: int, ahead: int) -> DataFrame:
    """For every slot with a full past and future: the last ``length`` values and the next ``ahead`` as arrays."""
    w = Window.partitionBy("entity_id").orderBy("slot")
    out = panel.withColumns({"context": F.collect_list("y").over(w.rowsBetween(-length + 1, 0)), "target": F.collect_list("y").over(w.rowsBetween(1, ahead))})
    return out.filter((F.size("context") == length) & (F.size("target") == ahead))


@query("fp14_context_windows", f"WITH {Q}, {_PANEL}, c AS (SELECT entity_id, slot, list(y) OVER (PARTITION BY entity_id ORDER BY slot ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c, list(y) OVER (PARTITION BY entity_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS t FROM panel) SELECT entity_id, slot, round(list_sum(c), 4) AS context, round(list_sum(t), 4) AS target FROM c WHERE len(c) = 4 AND len(t) = 2")
def fp14(spark, sf):
    total = lambda c: r4(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return context_windows(daily_panel(spark, sf), 4, 2).select("entity_id", "slot", total("context").alias("context"), total("target").alias("target"))


@query("fp19_persistence_baseline", f"WITH {Q}, {_PANEL}, l AS (SELECT y, lag(y) OVER (PARTITION BY entity_id ORDER BY slot) AS last, lag(y, 7) OVER (PARTITION BY entity_id ORDER BY slot) AS week FROM panel) SELECT count(last) AS n, round(avg(abs(y - last)), 4) AS mae_last, round(avg(abs(y - week)), 4) AS mae_week FROM l")
def fp19(spark, sf):
    w = Window.partitionBy("entity_id").orderBy("slot")
    rows = daily_panel(spark, sf).withColumns({"last": F.lag("y").over(w), "week": F.lag("y", 7).over(w)})
    return rows.agg(F.count("last").alias("n"), r4(F.avg(F.abs(F.col("y") - F.col("last")))).alias("mae_last"), r4(F.avg(F.abs(F.col("y") - F.col("week")))).alias("mae_week"))
