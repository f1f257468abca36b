"""Percentile rollups, baselines and typical days. Percentiles are exact and interpolated unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.plans.adaptor import AS_OF, Q, as_of, queue_log, r4
from queuelake.registry import query

PERCENTS = (25, 50, 75, 90, 95, 99)


def standby_operating(log: DataFrame, floor: int | None = None, below: int | None = None) -> DataFrame:
    """Rows that speak for the regular queue of a running ride, with a wait in [floor, below)."""
    out = log.filter((F.col("queue_type") == "STANDBY") & (F.col("status") == "OPERATING") & F.col("wait").isNotNull())
    out = out if floor is None else out.filter(F.col("wait") >= floor)
    return out if below is None else out.filter(F.col("wait") < below)


def window_before(log: DataFrame, end: Column, days: int, at: str = "ts") -> DataFrame:
    return log.filter((F.col(at) >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) < end))


def hour_of(at: str = "ts") -> Column:
    return F.date_format(at, "yyyy-MM-dd HH")


def hourly_rollup(log: DataFrame, least: int = 3) -> DataFrame:
    """Of each ride and hour with at least ``least`` samples: percentiles, spread, mean, count, and a deterministic key."""
    pct = F.percentile("wait", F.array(*(F.lit(p / 100) for p in PERCENTS)))
    rows = standby_operating(log).groupBy("entity_id", "park_id", hour_of().alias("hour")).agg(pct.alias("p"), F.stddev_samp("wait").alias("sd"), F.avg("wait").alias("mean"), F.count(F.lit(1)).alias("n"))
    named = [r4(F.col("p")[i]).alias(f"p{p}") for i, p in enumerate(PERCENTS)]
    return rows.filter(F.col("n") >= least).select("entity_id", "park_id", "hour", *named, r4(F.col("p")[2] - F.col("p")[0]).alias("iqr"), r4(F.col("sd")).alias("sd"), r4(F.col("mean")).alias("mean"), "n", F.md5(F.concat_ws("|", "entity_id", "hour")).alias("key"))


_PCT = ", ".join(f"round(quantile_cont(wait, {p / 100}), 4) AS p{p}" for p in PERCENTS)
ROLLUP = f"""roll AS (SELECT entity_id, park_id, strftime(ts, '%Y-%m-%d %H') AS hour, {_PCT}, round(quantile_cont(wait, 0.75) - quantile_cont(wait, 0.25), 4) AS iqr,
  round(stddev_samp(wait), 4) AS sd, round(avg(wait), 4) AS mean, count(*) AS n, md5(concat_ws('|', entity_id, strftime(ts, '%Y-%m-%d %H'))) AS key FROM op GROUP BY 1, 2, 3 HAVING count(*) >= {{least}})"""


@query("ag1_hourly_rollup", f"WITH {Q}, {ROLLUP.format(least=2)} SELECT * FROM roll")
def ag1(spark, sf):
    return hourly_rollup(queue_log(spark, sf), 2)


def missing_rollups(new: DataFrame, held: DataFrame) -> DataFrame:
    """Rollups to insert: those whose key isn't held yet."""
    return new.join(held.select("key"), "key", "left_anti")


@query("ag2_rollup_backfill", f"WITH {Q}, {ROLLUP.format(least=1)} SELECT entity_id, hour, p50, n FROM roll WHERE entity_id % 3 <> 0")
def ag2(spark, sf):
    new = hourly_rollup(queue_log(spark, sf), 1)
    return missing_rollups(new, new.filter("entity_id % 3 = 0")).select("entity_id", "hour", "p50", "n")


def mean_of_ride_means(log: DataFrame, end: Column, hours: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Of each park, the mean over rides of their mean waits in each of the hours before ``end``."""
    back = F.ceil((F.unix_timestamp(end) - F.unix_timestamp("ts")) / 3600).cast("int").alias("back")
    per = standby_operating(log).filter(F.col("ts") < end).select("park_id", "entity_id", "wait", back).filter(F.col("back").isin(*hours)).groupBy("park_id", "entity_id", "back").agg(F.avg("wait").alias("m"))
    return per.groupBy("park_id").pivot("back", list(hours)).agg(r4(F.avg("m"))).select("park_id", *(F.col(str(h)).alias(f"mean_{h}h_back") for h in hours))


@query("ag3_mean_of_means", f"""WITH {Q}, per AS (SELECT park_id, entity_id, CAST(ceil((epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts))) / 3600) AS INT) AS back, avg(wait) AS m FROM op WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT park_id, round(avg(m) FILTER (back = 1), 4) AS mean_1h_back, round(avg(m) FILTER (back = 2), 4) AS mean_2h_back FROM per WHERE back IN (1, 2) GROUP BY park_id""")  # fmt: skip
def ag3(spark, sf):
    return mean_of_ride_means(queue_log(spark, sf), F.lit("2024-01-20").cast("timestamp"))


def latest_wait_percentile(latest: DataFrame, q: float = 0.9) -> DataFrame:
    return latest.groupBy("park_id").agg(r4(F.percentile("wait", F.lit(q))).alias("p"), F.count(F.lit(1)).alias("rides"))


@query("ag5_latest_percentile", f"WITH {Q}, l AS (SELECT * FROM op QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1) SELECT park_id, round(quantile_cont(wait, 0.9), 4) AS p, count(*) AS rides FROM l GROUP BY 1")
def ag5(spark, sf):
    from queuelake.operators.latest import latest_per

    return latest_wait_percentile(latest_per(standby_operating(queue_log(spark, sf)), ["entity_id"]))


def park_today(log: DataFrame, end: Column, floor: int = 10) -> DataFrame:
    """Of each park over the day before ``end``: P90 above the floor, rides, closed rides, mean and top of waits, the mean over rides of their P90."""
    day = window_before(log, end, 1)
    ride = day.groupBy("park_id", "entity_id").agg(
        F.percentile(F.when((F.col("status") == "OPERATING") & (F.col("wait") >= floor), F.col("wait")), F.lit(0.9)).alias("p90"), F.avg("wait").alias("mean"), F.max("wait").alias("top"), F.max_by("status", F.struct("ts", "event_id")).alias("status"),
    )
    return ride.groupBy("park_id").agg(
        r4(F.avg("p90")).alias("mean_p90"), F.count(F.lit(1)).alias("rides"), F.count_if(F.col("status") == "CLOSED").alias("closed"), r4(F.avg("mean")).alias("mean"), F.max("top").alias("top"), r4(F.percentile("p90", F.lit(0.9))).alias("p90_of_p90"),
    )


_RIDE = f"ride AS (SELECT park_id, entity_id, quantile_cont(CASE WHEN status = 'OPERATING' AND wait >= 10 THEN wait END, 0.9) AS p90, avg(wait) AS mean, max(wait) AS top, arg_max(status, (ts, event_id)) AS status FROM q WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY GROUP BY 1, 2)"


@query("ag6_park_today", f"WITH {Q}, {_RIDE} SELECT park_id, round(avg(p90), 4) AS mean_p90, count(*) AS rides, count(*) FILTER (status = 'CLOSED') AS closed, round(avg(mean), 4) AS mean, max(top) AS top, round(quantile_cont(p90, 0.9), 4) AS p90_of_p90 FROM ride GROUP BY 1")
def ag6(spark, sf):
    return park_today(queue_log(spark, sf), as_of() - F.expr("INTERVAL 1 DAY"))


def ride_stats(log: DataFrame) -> DataFrame:
    """Mean, least, top, count, and when the top was last seen."""
    return standby_operating(log).groupBy("entity_id").agg(r4(F.avg("wait")).alias("mean"), F.min("wait").alias("least"), F.max("wait").alias("top"), F.count(F.lit(1)).alias("n"), F.date_format(F.max_by("ts", F.struct("wait", "ts")), "yyyy-MM-dd HH:mm:ss").alias("top_at"))


@query("ag9_ride_stats", f"WITH {Q} SELECT entity_id, round(avg(wait), 4) AS mean, min(wait) AS least, max(wait) AS top, count(*) AS n, strftime(arg_max(ts, (wait, ts)), '%Y-%m-%d %H:%M:%S') AS top_at FROM op GROUP BY 1")
def ag9(spark, sf):
    return ride_stats(queue_log(spark, sf))


def park_series(log: DataFrame, minutes: int = 10, q: float = 0.9, floor: int = 5) -> DataFrame:
    slot = F.floor(F.unix_timestamp("ts") / (60 * minutes)) * (60 * minutes)
    return standby_operating(log, floor).groupBy("park_id", slot.alias("slot")).agg(r4(F.percentile("wait", F.lit(q))).alias("p"), F.count(F.lit(1)).alias("n"))


@query("ag10_park_series", f"WITH {Q} SELECT park_id, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS slot, round(quantile_cont(wait, 0.9), 4) AS p, count(*) AS n FROM op WHERE wait >= 5 GROUP BY 1, 2")
def ag10(spark, sf):
    return park_series(queue_log(spark, sf))


def peak_hours(log: DataFrame, at: str = "lts") -> DataFrame:
    """Of each park the hour with the highest mean over rides of their mean waits; ``at``: local or UTC time. Ties: the earlier hour."""
    per = standby_operating(log).groupBy("park_id", "entity_id", F.hour(at).alias("hour")).agg(F.avg("wait").alias("m"))
    hours = per.groupBy("park_id", "hour").agg(F.round(F.avg("m"), 6).alias("m"))
    rank = F.row_number().over(Window.partitionBy("park_id").orderBy(F.desc("m"), "hour"))
    return hours.withColumn("k", rank).filter("k = 1").select("park_id", "hour", r4(F.col("m")).alias("mean"))


def _peak(at: str) -> str:
    return f"WITH {Q}, per AS (SELECT park_id, entity_id, hour({at}) AS hour, avg(wait) AS m FROM op GROUP BY 1, 2, 3), h AS (SELECT park_id, hour, round(avg(m), 6) AS m FROM per GROUP BY 1, 2) SELECT park_id, CAST(hour AS INT) AS hour, round(m, 4) AS mean FROM h QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY m DESC, hour) = 1"


@query("ag11_peak_hour_local", _peak("lts"))
def ag11(spark, sf):
    return peak_hours(queue_log(spark, sf))


@query("ag12_peak_hour_utc", _peak("ts"))
def ag12(spark, sf):
    return peak_hours(queue_log(spark, sf), "ts")


def percentile_of_percentiles(rollup: DataFrame, q: float = 0.9) -> DataFrame:
    return rollup.groupBy("entity_id").agg(r4(F.percentile("p90", F.lit(q))).alias("p"), F.count(F.lit(1)).alias("hours"))


@query("ag14_percentile_of_percentiles", f"WITH {Q}, {ROLLUP.format(least=1)} SELECT entity_id, round(quantile_cont(p90, 0.9), 4) AS p, count(*) AS hours FROM roll GROUP BY 1")
def ag14(spark, sf):
    return percentile_of_percentiles(hourly_rollup(queue_log(spark, sf), 1))


def typical_for_hour(rollup: DataFrame) -> DataFrame:
    """By hour and day of week (Sunday 0): the sample-weighted mean, and the P95 of P95s."""
    at = F.to_timestamp("hour", "yyyy-MM-dd HH")
    return rollup.groupBy("entity_id", F.hour(at).alias("hour_of_day"), (F.dayofweek(at) - 1).alias("dow")).agg(
        r4(F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), r4(F.percentile("p95", F.lit(0.95))).alias("p95"),
    )


@query("ag15_typical_for_hour", f"WITH {Q}, {ROLLUP.format(least=1)} SELECT entity_id, CAST(hour(strptime(hour, '%Y-%m-%d %H')) AS INT) AS hour_of_day, CAST(extract(dow FROM strptime(hour, '%Y-%m-%d %H')) AS INT) AS dow, round(sum(mean * n) / nullif(sum(n), 0), 4) AS mean, round(quantile_cont(p95, 0.95), 4) AS p95 FROM roll GROUP BY 1, 2, 3")
def ag15(spark, sf):
    return typical_for_hour(hourly_rollup(queue_log(spark, sf), 1))


def headliners(log: DataFrame, end: Column, days: int = 548, floor: int = 10, below: int = 380, mean_over: float = 20, p90_over: float = 30, day_share: float = 0.6, most: int = 10, enough: int = 3) -> DataFrame:
    """The rides that stand for a park, with their tier.

    Tier 1 is long and often open. Tier 2 (park P60, or tall peaks) is asked only if tier 1 has fewer than ``enough``; tier 3 (park median) only if neither
    has enough; the five of the highest P90 only if all are empty. A ride keeps its best tier; of more than ``most`` in tier 1, only the top ones by mean.
    """
    rows = standby_operating(window_before(log, end, days), floor, below)
    ride = rows.groupBy("park_id", "entity_id").agg(F.avg("wait").alias("mean"), F.percentile("wait", F.lit(0.5)).alias("p50"), F.percentile("wait", F.lit(0.9)).alias("p90"), F.countDistinct(F.to_date("lts")).alias("days"))
    park = Window.partitionBy("park_id")
    ride = ride.withColumns({"most_days": F.max("days").over(park), "park_p60": F.percentile("mean", F.lit(0.6)).over(park), "park_p50": F.percentile("mean", F.lit(0.5)).over(park)})
    often = F.col("days") > day_share * F.col("most_days")
    t1 = (F.col("mean") > mean_over) & (F.col("p90") > p90_over) & often
    t2 = ((F.col("mean") >= F.col("park_p60")) | (F.col("p90") > 1.5 * F.col("p50"))) & often
    t3 = F.col("mean") >= F.col("park_p50")
    ride = ride.withColumns({"t1": t1, "t2": t2, "t3": t3}).withColumns({"n1": F.count_if("t1").over(park), "n2": F.count_if("t2").over(park), "n3": F.count_if("t3").over(park)})
    use2 = F.col("n1") < enough
    use3 = use2 & (F.col("n2") < enough)
    none = (F.col("n1") == 0) & (~use2 | (F.col("n2") == 0)) & (~use3 | (F.col("n3") == 0))
    by_p90 = F.row_number().over(park.orderBy(F.desc("p90"), "entity_id"))
    tier = F.when(F.col("t1"), 1).when(use2 & F.col("t2"), 2).when(use3 & F.col("t3"), 3).when(none & (F.col("by_p90") <= 5), 4)
    rank = F.row_number().over(Window.partitionBy("park_id", "tier").orderBy(F.desc("mean"), "entity_id"))
    chosen = ride.withColumn("by_p90", by_p90).withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("rank", rank)
    over = F.col("n1") > most
    return chosen.filter(~over | ((F.col("tier") == 1) & (F.col("rank") <= most))).select("park_id", "entity_id", "tier", r4(F.col("mean")).alias("mean"), r4(F.col("p50")).alias("p50"), r4(F.col("p90")).alias("p90"), "days")


HEAD = f"""ride AS (SELECT park_id, entity_id, avg(wait) AS mean, quantile_cont(wait, 0.5) AS p50, quantile_cont(wait, 0.9) AS p90, count(DISTINCT CAST(lts AS DATE)) AS days FROM op
  WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 548 DAY AND ts < TIMESTAMP '{AS_OF}' AND wait >= 10 AND wait < 380 GROUP BY 1, 2),
park AS (SELECT park_id, max(days) AS md, quantile_cont(mean, 0.6) AS p60, quantile_cont(mean, 0.5) AS pm FROM ride GROUP BY 1),
a AS (SELECT r.*, mean > {{mean}} AND p90 > {{p90}} AND days > 0.6 * md AS t1, (mean >= p60 OR p90 > 1.5 * p50) AND days > 0.6 * md AS t2, mean >= pm AS t3 FROM ride r JOIN park USING (park_id)),
c AS (SELECT park_id, count(*) FILTER (t1) AS n1, count(*) FILTER (t2) AS n2, count(*) FILTER (t3) AS n3 FROM a GROUP BY 1),
b AS (SELECT a.*, n1, CASE WHEN t1 THEN 1 WHEN n1 < 3 AND t2 THEN 2 WHEN n1 < 3 AND n2 < 3 AND t3 THEN 3 WHEN n1 = 0 AND n2 = 0 AND n3 = 0 AND row_number() OVER (PARTITION BY park_id ORDER BY p90 DESC, entity_id) <= 5 THEN 4 END AS tier FROM a JOIN c USING (park_id)),
head AS (SELECT park_id, entity_id, tier, round(mean, 4) AS mean, round(p50, 4) AS p50, round(p90, 4) AS p90, days FROM b WHERE tier IS NOT NULL QUALIFY n1 <= 10 OR (tier = 1 AND row_number() OVER (PARTITION BY park_id, tier ORDER BY mean DESC, entity_id) <= 10))"""


@query("ag16_headliners", f"WITH {Q}, {HEAD.format(mean=20, p90=30)} SELECT * FROM head")
def ag16(spark, sf):
    return headliners(queue_log(spark, sf), as_of())


@query("ag16_headliner_fallback", f"WITH {Q}, {HEAD.format(mean=235, p90=340)} SELECT * FROM head")
def ag16b(spark, sf):
    return headliners(queue_log(spark, sf), as_of(), mean_over=235, p90_over=340)


def confidence(days: Column) -> Column:
    return F.when(days >= 90, "high").when(days >= 30, "medium").otherwise("low")


def park_baseline(heads: DataFrame) -> DataFrame:
    """The mean of the headliners' P50 and P90 above 0; the confidence by days; the lowest tier that was needed."""
    return heads.groupBy("park_id").agg(
        F.round(F.avg(F.when(F.col("p50") > 0, F.col("p50"))), 2).alias("p50"), F.round(F.avg(F.when(F.col("p90") > 0, F.col("p90"))), 2).alias("p90"), confidence(F.max("days")).alias("confidence"), F.max("tier").alias("tier"), F.count(F.lit(1)).alias("rides"),
    )


@query("ag17_park_baseline", f"WITH {Q}, {HEAD.format(mean=20, p90=30)} SELECT park_id, round(avg(p50) FILTER (p50 > 0), 2) AS p50, round(avg(p90) FILTER (p90 > 0), 2) AS p90, CASE WHEN max(days) >= 90 THEN 'high' WHEN max(days) >= 30 THEN 'medium' ELSE 'low' END AS confidence, max(tier) AS tier, count(*) AS rides FROM head GROUP BY 1")
def ag17(spark, sf):
    return park_baseline(headliners(queue_log(spark, sf), as_of()))


def typical_day_peak(log: DataFrame, end: Column, days: int = 548, floor: int = 10, least_days: int = 30) -> DataFrame:
    """P90 of each ride and local day, their mean of each day, the median over days; null if a park has too few days."""
    rows = standby_operating(window_before(log, end, days), floor)
    ride_day = rows.groupBy("park_id", "entity_id", F.to_date("lts").alias("day")).agg(F.percentile("wait", F.lit(0.9)).alias("p90"))
    day = ride_day.groupBy("park_id", "day").agg(F.avg("p90").alias("peak"))
    out = day.groupBy("park_id").agg(F.percentile("peak", F.lit(0.5)).alias("peak"), F.count(F.lit(1)).alias("days"))
    return out.select("park_id", F.when(F.col("days") >= least_days, r4(F.col("peak"))).alias("typical_day_peak"), "days")


@query("ag18_typical_day_peak", f"""WITH {Q}, rd AS (SELECT park_id, entity_id, CAST(lts AS DATE) AS day, quantile_cont(wait, 0.9) AS p90 FROM op WHERE wait >= 10 AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1, 2, 3),
d AS (SELECT park_id, day, avg(p90) AS peak FROM rd GROUP BY 1, 2) SELECT park_id, CASE WHEN count(*) >= 20 THEN round(quantile_cont(peak, 0.5), 4) END AS typical_day_peak, count(*) AS days FROM d GROUP BY 1""")  # fmt: skip
def ag18(spark, sf):
    return typical_day_peak(queue_log(spark, sf), as_of(), least_days=20)


def ride_baselines(log: DataFrame, schedule: DataFrame, floor: int = 5) -> DataFrame:
    """P50, P90 and days of each ride, on days without a schedule row or with one that says that the park ran or isn't known to have been shut."""
    rows = standby_operating(log, floor).withColumn("day", F.to_date("lts")).join(schedule.select("park_id", F.col("date").alias("day"), "type"), ["park_id", "day"], "left")
    open_ = rows.filter(F.col("type").isNull() | F.col("type").isin("OPERATING", "UNKNOWN"))
    return open_.groupBy("park_id", "entity_id").agg(r4(F.percentile("wait", F.lit(0.5))).alias("p50"), r4(F.percentile("wait", F.lit(0.9))).alias("p90"), F.countDistinct("day").alias("days"))


def schedules(spark, sf) -> DataFrame:
    """A schedule out of the log: a park's day is of a type that follows from its number of rows."""
    days = queue_log(spark, sf).groupBy("park_id", F.to_date("lts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return days.select("park_id", "date", F.when(F.col("n") % 5 == 0, "CLOSED").when(F.col("n") % 5 == 1, "UNKNOWN").when(F.col("n") % 5 < 4, "OPERATING").otherwise("INFO").alias("type"), "n")


SCHED = "sched AS (SELECT park_id, CAST(lts AS DATE) AS date, CASE WHEN count(*) % 5 = 0 THEN 'CLOSED' WHEN count(*) % 5 = 1 THEN 'UNKNOWN' WHEN count(*) % 5 < 4 THEN 'OPERATING' ELSE 'INFO' END AS type, count(*) AS n FROM q GROUP BY 1, 2)"


@query("ag20_ride_baselines", f"WITH {Q}, {SCHED} SELECT o.park_id, entity_id, round(quantile_cont(wait, 0.5), 4) AS p50, round(quantile_cont(wait, 0.9), 4) AS p90, count(DISTINCT CAST(lts AS DATE)) AS days FROM op o LEFT JOIN sched s ON o.park_id = s.park_id AND CAST(o.lts AS DATE) = s.date WHERE wait >= 5 AND (type IS NULL OR type IN ('OPERATING', 'UNKNOWN')) GROUP BY 1, 2")
def ag20(spark, sf):
    return ride_baselines(queue_log(spark, sf), schedules(spark, sf))


def ride_day_peaks(rollup: DataFrame, least: int = 2) -> DataFrame:
    """Of each ride and day the top of the hourly P90 with enough samples."""
    return rollup.filter(F.col("n") >= least).groupBy("entity_id", F.to_date(F.substring("hour", 1, 10)).alias("day")).agg(F.max("p90").alias("peak"))


def round5(c: Column) -> Column:
    """To the nearest five, halves up."""
    return (F.floor((c + 2.5) / 5) * 5).cast("int")


def interpolated(values: Column, q: float) -> Column:
    """The interpolated percentile of a sorted array, null if it is empty. One product and the sum are rounded together, as DuckDB does: F.percentile
    rounds them apart, and where the exact value is half of a step, the last bit decides what round5 makes of it."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = (F.get(values, f(at).cast("int")).cast("double") for f in (F.floor, F.ceil))
    part = at - F.floor(at)
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
    return F.when(F.size(values) > 0, fused)


def typical_waits(rollup: DataFrame, least_days: int = 20, weekend: tuple[int, ...] = (0, 6)) -> DataFrame:
    """P50 and P90 of a ride's daily peaks on weekdays and weekends (Sunday 0), and its record day, the latest on ties."""
    day = ride_day_peaks(rollup).withColumn("weekend", (F.dayofweek("day") - 1).isin(*weekend))
    free = F.col("weekend")
    peaks = lambda on: F.sort_array(F.collect_list(F.when(on, F.col("peak"))))
    out = day.groupBy("entity_id").agg(F.count(F.lit(1)).alias("days"), peaks(~free).alias("weekday"), peaks(free).alias("weekend"), F.max("peak").alias("record"), F.date_format(F.max_by("day", F.struct("peak", "day")), "yyyy-MM-dd").alias("record_day"))
    typical = (round5(interpolated(F.col(k), q)).alias(f"{k}_p{int(q * 100)}") for k in ("weekday", "weekend") for q in (0.5, 0.9))
    return out.filter(F.col("days") >= least_days).select("entity_id", "days", *typical, "record", "record_day")


@query("ag22_typical_waits", f"""WITH {Q}, {ROLLUP.format(least=1)}, d AS (SELECT entity_id, CAST(hour[:10] AS DATE) AS day, max(p90) AS peak FROM roll WHERE n >= 1 GROUP BY 1, 2), w AS (SELECT *, extract(dow FROM day) IN (0, 6) AS we FROM d)
SELECT entity_id, count(*) AS days, {", ".join(f"CAST(floor((quantile_cont(peak, {q}) FILTER ({'NOT we' if k == 'weekday' else 'we'}) + 2.5) / 5) * 5 AS INT) AS {k}_p{int(q * 100)}" for k in ('weekday', 'weekend') for q in (0.5, 0.9))}, max(peak) AS record, strftime(arg_max(day, (peak, day)), '%Y-%m-%d') AS record_day
FROM w GROUP BY 1 HAVING count(*) >= 5""")  # fmt: skip
def ag22(spark, sf):
    rollup = hourly_rollup(queue_log(spark, sf), 1)
    return typical_waits(rollup.withColumn("n", F.lit(2)), 5)


@query("ag21_ride_typical_peak", f"WITH {Q}, {ROLLUP.format(least=1)}, d AS (SELECT entity_id, CAST(hour[:10] AS DATE) AS day, max(p90) AS peak FROM roll GROUP BY 1, 2) SELECT entity_id, round(quantile_cont(peak, 0.5), 4) AS peak, count(*) AS days FROM d GROUP BY 1 HAVING count(*) >= 10")
def ag21(spark, sf):
    day = ride_day_peaks(hourly_rollup(queue_log(spark, sf), 1), 1)
    return day.groupBy("entity_id").agg(r4(F.percentile("peak", F.lit(0.5))).alias("peak"), F.count(F.lit(1)).alias("days")).filter("days >= 10")


@query("ag24_headliner_daily_peaks", f"WITH {Q}, {HEAD.format(mean=20, p90=30)} SELECT o.park_id, o.entity_id, strftime(lts, '%Y-%m-%d') AS day, round(quantile_cont(wait, 0.9), 4) AS p90 FROM op o JOIN head h ON o.entity_id = h.entity_id WHERE wait >= 10 GROUP BY 1, 2, 3")
def ag24(spark, sf):
    log = queue_log(spark, sf)
    heads = headliners(log, as_of()).select("entity_id")
    return standby_operating(log, 10).join(heads, "entity_id", "left_semi").groupBy("park_id", "entity_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(r4(F.percentile("wait", F.lit(0.9))).alias("p90"))


def slot_profile(log: DataFrame, minutes: int = 15, floor: int = 5) -> DataFrame:
    """P90, mean and count of each ride, local day and slot of the day."""
    slot = F.format_string("%02d:%02d", F.hour("lts"), (F.floor(F.minute("lts") / minutes) * minutes).cast("int"))
    return standby_operating(log, floor).groupBy("entity_id", F.date_format("lts", "yyyy-MM-dd").alias("day"), slot.alias("slot")).agg(r4(F.percentile("wait", F.lit(0.9))).alias("p90"), r4(F.avg("wait")).alias("mean"), F.count(F.lit(1)).alias("n"))


SLOTS = "slots AS (SELECT entity_id, strftime(lts, '%Y-%m-%d') AS day, printf('%02d:%02d', hour(lts), minute(lts) // 15 * 15) AS slot, round(quantile_cont(wait, 0.9), 4) AS p90, round(avg(wait), 4) AS mean, count(*) AS n FROM op WHERE wait >= 5 GROUP BY 1, 2, 3)"


@query("ag25_slot_profile", f"WITH {Q}, {SLOTS} SELECT * FROM slots")
def ag25(spark, sf):
    return slot_profile(queue_log(spark, sf))


@query("ag26_down_hours", f"WITH {Q} SELECT entity_id, strftime(lts, '%Y-%m-%d') AS day, count(DISTINCT hour(lts)) AS down_hours FROM q WHERE status = 'DOWN' GROUP BY 1, 2")
def ag26(spark, sf):
    return queue_log(spark, sf).filter("status = 'DOWN'").groupBy("entity_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct(F.hour("lts")).alias("down_hours"))


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank percentile of a sorted array."""
    return F.element_at(values, F.greatest(F.ceil(F.size(values) * q).cast("int"), F.lit(1)))


def park_daily_stats(log: DataFrame) -> DataFrame:
    """Nearest-rank P50 and P90 of a park's day, and its top wait, capped by them: a group is one park's day."""
    day = standby_operating(log, 1).groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day")).agg(F.sort_array(F.collect_list("wait")).alias("w"))
    day = day.select("park_id", "day", nearest_rank(F.col("w"), 0.5).alias("p50"), nearest_rank(F.col("w"), 0.9).alias("p90"), F.size("w").cast("long").alias("n"), F.array_max("w").alias("raw"))
    cap = F.when(F.col("n") >= 20, F.greatest(F.lit(120), 3 * F.col("p90"))).when(F.col("p50") > 0, 5 * F.col("p50")).otherwise(120)
    return day.select("park_id", "day", "p50", "p90", "n", F.least("raw", cap).alias("top"))


@query("ag29_park_daily_stats", f"WITH {Q}, d AS (SELECT park_id, strftime(lts, '%Y-%m-%d') AS day, quantile_disc(wait, 0.5) AS p50, quantile_disc(wait, 0.9) AS p90, count(*) AS n, max(wait) AS raw FROM op WHERE wait >= 1 GROUP BY 1, 2) SELECT park_id, day, p50, p90, n, least(raw, CASE WHEN n >= 20 THEN greatest(120, 3 * p90) WHEN p50 > 0 THEN 5 * p50 ELSE 120 END) AS top FROM d")
def ag29(spark, sf):
    return park_daily_stats(queue_log(spark, sf))


def top_rides(log: DataFrame, n: int = 3) -> DataFrame:
    per = standby_operating(log).groupBy("park_id", "entity_id").agg(F.round(F.percentile("wait", F.lit(0.9)), 4).alias("p90"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("park_id").orderBy(F.desc("p90"), "entity_id"))).filter(F.col("rank") <= n)


@query("ag31_top_rides", f"WITH {Q}, p AS (SELECT park_id, entity_id, round(quantile_cont(wait, 0.9), 4) AS p90 FROM op GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY park_id ORDER BY p90 DESC, entity_id) AS INT) AS rank FROM p QUALIFY rank <= 3")
def ag31(spark, sf):
    return top_rides(queue_log(spark, sf))


def best_times(days: DataFrame, unit: Column, least_days: int = 60) -> DataFrame:
    """days (park_id, day, level): the mean over parks of their level in each unit (month, day of week) as a ratio of their own mean."""
    park = days.groupBy("park_id").agg(F.avg("level").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_days).select("park_id", "mean")
    per = days.groupBy("park_id", unit.alias("unit")).agg(F.avg("level").alias("level"))
    return per.join(park, "park_id").groupBy("unit").agg(r4(F.avg(F.col("level") / F.col("mean"))).alias("index"), F.count(F.lit(1)).alias("parks"))


@query("ag32_best_weekdays", f"WITH {Q}, d AS (SELECT park_id, CAST(lts AS DATE) AS day, quantile_cont(wait, 0.9) AS level FROM op GROUP BY 1, 2), p AS (SELECT park_id, avg(level) AS mean FROM d GROUP BY 1 HAVING count(*) >= 20), u AS (SELECT park_id, CAST(extract(dow FROM day) AS INT) AS unit, avg(level) AS level FROM d GROUP BY 1, 2) SELECT unit, round(avg(level / mean), 4) AS index, count(*) AS parks FROM u JOIN p USING (park_id) GROUP BY 1")
def ag32(spark, sf):
    days = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.to_date("lts").alias("day")).agg(F.percentile("wait", F.lit(0.9)).alias("level"))
    return best_times(days, F.dayofweek("day") - 1, 20)
