"""Merging of sources whose names differ a little, and frames and filters by calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from queuelake.functions import text as X
from queuelake.operators.lookup import _DICE, _grams
from queuelake.operators.rollup import SCHED, schedules, standby_operating
from queuelake.plans.adaptor import AS_OF, Q, as_of, queue_log, r4, read
from queuelake.registry import query

LEAST_DICE, LONGER = 0.9, 5


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _rarest(rows: DataFrame, side: str, counts: DataFrame) -> DataFrame:
    """Of each name so many of its rarest bigrams that a name at least LEAST_DICE alike holds one of them: all but the overlap that it needs, and one."""
    grams = rows.select(side, F.explode(X.ngrams(F.col(f"{side}_n"), 2)).alias("gram")).join(counts, "gram")
    by = Window.partitionBy(side)
    ranked = grams.withColumns({"rank": F.row_number().over(by.orderBy("df", "gram")), "size": F.count(F.lit(1)).over(by)})
    return ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * (LEAST_DICE / (2 - LEAST_DICE))) + 1).select(side, "gram")


def merged_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (a, name), b (b, name): ids joined on the normalised name, else, of names longer than LONGER, with the likest one by bigrams above LEAST_DICE.

    A fuzzy pair is one that is the best of both its sides (ties: the smaller id). Candidates come from an equi-join on rare bigrams, never from
    all pairs. Rows: a, b, origin (exact, fuzzy, first, second). Of one source's ids with the same normalised name, the least stands for all.
    """
    x = a.groupBy(normalised(F.col("name")).alias("n")).agg(F.min("a").alias("a"))
    y = b.groupBy(normalised(F.col("name")).alias("n")).agg(F.min("b").alias("b"))
    both = x.join(y, "n", "full")
    exact = both.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.lit("exact").alias("origin"))
    left = both.filter("b IS NULL").select("a", F.col("n").alias("a_n"))
    right = both.filter("a IS NULL").select("b", F.col("n").alias("b_n"))
    long_a, long_b = left.filter(F.length("a_n") > LONGER), right.filter(F.length("b_n") > LONGER)
    grams = long_a.select(F.explode(X.ngrams(F.col("a_n"), 2)).alias("gram")).unionByName(long_b.select(F.explode(X.ngrams(F.col("b_n"), 2)).alias("gram")))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    near = _rarest(long_a, "a", counts).join(_rarest(long_b, "b", counts), "gram").select("a", "b").distinct()
    scored = near.join(long_a, "a").join(long_b, "b").withColumn("dice", X.dice(F.col("a_n"), F.col("b_n"))).filter(F.col("dice") > LEAST_DICE)
    best = scored.withColumns({
        "of_a": F.row_number().over(Window.partitionBy("a").orderBy(F.desc("dice"), "b")), "of_b": F.row_number().over(Window.partitionBy("b").orderBy(F.desc("dice"), "a")),
    })
    fuzzy = best.filter("of_a = 1 AND of_b = 1").select("a", "b", F.lit("fuzzy").alias("origin"))
    first = left.join(fuzzy.select("a"), "a", "left_anti").select("a", F.lit(None).cast("long").alias("b"), F.lit("first").alias("origin"))
    second = right.join(fuzzy.select("b"), "b", "left_anti").select(F.lit(None).cast("long").alias("a"), "b", F.lit("second").alias("origin"))
    return exact.unionByName(fuzzy).unionByName(first).unionByName(second)


_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("jn23_fuzzy_merge", f"""WITH x AS (SELECT {_NORM.format("p_name || ' ' || p_brand")} AS n, min(p_partkey) AS a FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
y AS (SELECT {_NORM.format("p_name || CASE WHEN p_size < 25 THEN 's ' ELSE ' ' END || p_brand")} AS n, min(p_partkey) AS b FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
z AS (SELECT a, b, coalesce(x.n, y.n) AS n FROM x FULL JOIN y ON x.n = y.n),
s AS (SELECT l.a, r.b, {_DICE.format(a='l.n', b='r.n', x=_grams('l.n'), y=_grams('r.n'))} AS dice FROM z l JOIN z r ON l.b IS NULL AND r.a IS NULL AND length(l.n) > 5 AND length(r.n) > 5),
f AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dice DESC, b) AS i, row_number() OVER (PARTITION BY b ORDER BY dice DESC, a) AS j FROM s WHERE dice > 0.9) WHERE i = 1 AND j = 1)
SELECT a, b, 'exact' AS origin FROM z WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT a, b, 'fuzzy' FROM f
UNION ALL SELECT a, NULL, 'first' FROM z WHERE b IS NULL AND a NOT IN (SELECT a FROM f) UNION ALL SELECT NULL, b, 'second' FROM z WHERE a IS NULL AND b NOT IN (SELECT b FROM f)""")
def jn23_fuzzy(spark, sf):
    p = read(spark, sf, "part")
    a = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    b = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), F.concat("p_name", F.when(F.col("p_size") < 25, "s ").otherwise(" "), "p_brand").alias("name"))
    return merged_by_name(a, b)


def future_frame(rides: DataFrame, after: Column, hours: int) -> DataFrame:
    """Of each ride the hours that follow ``after``: entity_id, park_id, ds."""
    first = F.date_trunc("hour", after) + F.expr("INTERVAL 1 HOUR")
    return rides.select("entity_id", "park_id", F.explode(F.sequence(first, first + F.make_interval(hours=F.lit(hours - 1)), F.expr("INTERVAL 1 HOUR"))).alias("ds"))


def calendar_covariates(frame: DataFrame, holidays: DataFrame) -> DataFrame:
    """frame with hour, day of week from Monday, weekend, month, the hour as a circle, holidays (day) and the days before them."""
    day = F.to_date("ds")
    known = F.broadcast(holidays.select(F.col("day").alias("_day")).distinct())  # days of a calendar: some thousands
    eve = F.broadcast(holidays.select(F.date_sub("day", 1).alias("_eve")).distinct())
    out = frame.join(known, day == F.col("_day"), "left").join(eve, day == F.col("_eve"), "left")
    turn = 2 * 3.141592653589793 * F.hour("ds") / 24
    return out.withColumns({
        "hour": F.hour("ds"), "dow": F.weekday("ds"), "weekend": F.weekday("ds") >= 5, "month": F.month("ds"), "sin_hour": F.sin(turn), "cos_hour": F.cos(turn),
        "holiday": F.col("_day").isNotNull(), "eve": F.col("_eve").isNotNull(),
    }).drop("_day", "_eve")


HOLIDAYS = ("2024-01-01", "2024-02-02", "2024-02-03")


@query("fp10_future_frame", f"""WITH {Q}, r AS (SELECT DISTINCT entity_id, park_id FROM q), h AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{d}')" for d in HOLIDAYS)}) t(day)),
f AS (SELECT entity_id, park_id, unnest(generate_series(TIMESTAMP '{AS_OF}' + INTERVAL 1 HOUR, TIMESTAMP '{AS_OF}' + INTERVAL 72 HOUR, INTERVAL 1 HOUR)) AS t FROM r)
SELECT entity_id, park_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS ds, hour(t) AS hour, isodow(t) - 1 AS dow, isodow(t) >= 6 AS weekend, month(t) AS month, round(sin(2 * 3.141592653589793 * hour(t) / 24), 4) AS sin_hour,
  CAST(t AS DATE) IN (SELECT day FROM h) AS holiday, CAST(t AS DATE) + 1 IN (SELECT day FROM h) AS eve FROM f""")
def fp10_future(spark, sf):
    rides = queue_log(spark, sf).select("entity_id", "park_id").distinct()
    days = spark.createDataFrame([(d,) for d in HOLIDAYS], "day string").select(F.to_date("day").alias("day"))
    out = calendar_covariates(future_frame(rides, as_of(), 72), days)
    return out.select("entity_id", "park_id", F.date_format("ds", "yyyy-MM-dd HH:mm:ss").alias("ds"), "hour", "dow", "weekend", "month", r4(F.col("sin_hour")).alias("sin_hour"), "holiday", "eve")


def on_operating_days(daily: DataFrame, schedule: DataFrame) -> DataFrame:
    """daily (park_id, day, ...) without the days on which a park that has a schedule isn't scheduled to operate; parks without any keep all."""
    open_days = schedule.filter("type = 'OPERATING'").select("park_id", F.col("date").alias("day"), F.lit(True).alias("_open")).distinct()
    planned = schedule.select("park_id", F.lit(True).alias("_planned")).distinct()
    return daily.join(open_days, ["park_id", "day"], "left").join(planned, "park_id", "left").filter("_open OR _planned IS NULL").drop("_open", "_planned")


@query("flt10_daily_schedule_filter", f"""WITH {Q}, {SCHED}, d AS (SELECT park_id, entity_id, CAST(lts AS DATE) + 1 AS day, max(wait) AS peak FROM op GROUP BY ALL), s AS (SELECT * FROM sched WHERE park_id < 6)
SELECT park_id, entity_id, strftime(day, '%Y-%m-%d') AS day, peak FROM d WHERE park_id NOT IN (SELECT park_id FROM s) OR EXISTS (SELECT 1 FROM s WHERE s.park_id = d.park_id AND s.date = d.day AND s.type = 'OPERATING')""")
def flt10_daily(spark, sf):
    """Peaks of a day, predicted for the day after it."""
    daily = standby_operating(queue_log(spark, sf)).groupBy("park_id", "entity_id", F.date_add(F.to_date("lts"), 1).alias("day")).agg(F.max("wait").alias("peak"))
    out = on_operating_days(daily, schedules(spark, sf).filter("park_id < 6"))
    return out.select("park_id", "entity_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "peak")
