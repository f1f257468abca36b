"""Forecast accuracy, score boards, drift and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.operators.joins import _FC, PRED, compared, forecasts
from queuelake.operators.latest import first_per
from queuelake.plans.adaptor import Q, queue_log, r4
from queuelake.registry import query

def err() -> Column:
    return F.col("predicted") - F.col("actual")


def errors(by: list[str], rows: DataFrame, least_actual: float = 10) -> DataFrame:
    """rows (predicted, actual or null) -> totals, coverage, MAE, MAPE over actuals from ``least_actual``, RMSE, bias and R2, from sums."""
    out = rows.groupBy(*by) if by else rows.groupBy()
    sse, n = F.sum(err() * err()), F.count("actual")
    sst = F.sum(F.col("actual") * F.col("actual")) - F.sum("actual") * F.sum("actual") / F.nullif(n.cast("double"), F.lit(0.0))
    return out.agg(
        F.count(F.lit(1)).alias("total"), n.alias("n"), r4(F.avg(F.abs(err()))).alias("mae"), r4(F.avg(F.when(F.col("actual") >= least_actual, F.abs(err()) / F.col("actual"))) * 100).alias("mape"),
        r4(F.sqrt(F.avg(err() * err()))).alias("rmse"), r4(F.avg(err())).alias("bias"), r4(1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"), r4(100.0 * n / F.count(F.lit(1))).alias("coverage"),
    )


_E = "count(*) AS total, count(y) AS n, round(avg(abs(p - y)), 4) AS mae, round(avg(CASE WHEN y >= 10 THEN abs(p - y) / y END) * 100, 4) AS mape, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(p - y), 4) AS bias, round(1 - sum(CASE WHEN y IS NOT NULL THEN (p - y) * (p - y) END) / nullif(sum(y * y) - sum(y) * sum(y) / nullif(count(y), 0), 0), 4) AS r2, round(100.0 * count(y) / count(*), 4) AS coverage"
CMP = f"{Q}, {PRED.format(tol=7200)}, cmp AS (SELECT p.event_id, p.entity_id, p.ts, p.value AS p, a_value AS y FROM pred p LEFT JOIN near n ON p.event_id = n.event_id)"


def with_actuals(spark, sf) -> DataFrame:
    return compared(spark, sf)


@query("mq1_ride_accuracy", f"WITH {CMP} SELECT entity_id, {_E} FROM cmp GROUP BY 1")
def mq1(spark, sf):
    return errors(["entity_id"], with_actuals(spark, sf))


def badge(n: Column, mae: Column) -> Column:
    return F.when(n < 10, "insufficient_data").when(mae < 5, "excellent").when(mae < 10, "good").when(mae < 15, "fair").otherwise("poor")


@query("mq2_accuracy_badges", f"WITH {CMP}, d AS (SELECT CAST(ts AS DATE) AS d, {_E} FROM cmp GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN n < 10 THEN 'insufficient_data' WHEN mae < 5 THEN 'excellent' WHEN mae < 10 THEN 'good' WHEN mae < 15 THEN 'fair' ELSE 'poor' END AS badge FROM d")
def mq2(spark, sf):
    rows = errors(["day"], with_actuals(spark, sf).withColumn("day", F.date_format("target", "yyyy-MM-dd")))
    return rows.select("day", badge(F.col("n"), F.col("mae")).alias("badge"))


@query("mq3_system_accuracy", f"WITH {CMP} SELECT {_E} FROM cmp")
def mq3(spark, sf):
    return errors([], with_actuals(spark, sf))


def error_shares(rows: DataFrame, by: Column, high: float = 200, low: float = 50, least: int = 3) -> DataFrame:
    """How often errors are high or low in each value of a feature."""
    e = F.abs(err())
    out = rows.filter(F.col("actual").isNotNull()).groupBy(by.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(e > high).alias("high"), F.count_if(e <= low).alias("low"))
    return out.filter(F.col("n") >= least).withColumn("high_rate", r4(F.col("high") / F.col("n")))


@query("mq4_errors_by_hour", f"WITH {CMP} SELECT CAST(hour(ts) AS INT) AS value, count(*) AS n, count(*) FILTER (abs(p - y) > 200) AS high, count(*) FILTER (abs(p - y) <= 50) AS low, round(count(*) FILTER (abs(p - y) > 200) / count(*), 4) AS high_rate FROM cmp WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def mq4(spark, sf):
    return error_shares(with_actuals(spark, sf), F.hour("target"))


def performers(rows: DataFrame, least: int, k: int) -> DataFrame:
    """The k best and worst rides by MAE among those with enough rows and some spread."""
    per = rows.filter(F.col("actual").isNotNull()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(err()))).alias("mae"), F.avg("actual").alias("mean"), F.stddev_samp("actual").alias("sd")).filter((F.col("n") >= least) & (F.col("mean") >= 10) & (F.col("sd") >= 8))
    top = lambda order, kind: per.orderBy(*order).limit(k).select(F.lit(kind).alias("kind"), "entity_id", "mae")
    return top(["mae", "entity_id"], "best").unionByName(top([F.desc("mae"), "entity_id"], "worst"))


@query("mq5_performers", f"WITH {CMP}, s AS (SELECT entity_id, round(avg(abs(p - y)), 4) AS mae FROM cmp WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND avg(y) >= 10 AND stddev_samp(y) >= 8) (SELECT 'best' AS kind, entity_id, mae FROM s ORDER BY mae, entity_id LIMIT 5) UNION ALL (SELECT 'worst', entity_id, mae FROM s ORDER BY mae DESC, entity_id LIMIT 5)")
def mq5(spark, sf):
    return performers(with_actuals(spark, sf), 2, 5)


@query("mq7_daily_trend", f"WITH {CMP} SELECT strftime(ts, '%Y-%m-%d') AS day, {_E} FROM cmp GROUP BY 1")
def mq7(spark, sf):
    return errors(["day"], with_actuals(spark, sf).withColumn("day", F.date_format("target", "yyyy-MM-dd")))


@query("mq7_weekday_pattern", f"WITH {CMP} SELECT CAST(extract(dow FROM ts) AS INT) AS dow, {_E} FROM cmp GROUP BY 1")
def mq7b(spark, sf):
    return errors(["dow"], with_actuals(spark, sf).withColumn("dow", F.dayofweek("target") - 1))


@query("mq8_park_accuracy", f"WITH {CMP} SELECT entity_id % 8 AS park_id, {_E} FROM cmp GROUP BY 1")
def mq8(spark, sf):
    return errors(["park_id"], with_actuals(spark, sf).withColumn("park_id", F.col("entity_id") % 8))


@query("mq9_retrain_rule", f"WITH {CMP}, s AS (SELECT {_E} FROM cmp) SELECT coalesce(mae > 8, false) OR coalesce(mape > 35, false) AS retrain, CASE WHEN mae > 8 THEN 'mae' WHEN mape > 35 THEN 'mape' END AS reason FROM s")
def mq9(spark, sf):
    s = errors([], with_actuals(spark, sf))
    return s.select((F.coalesce(F.col("mae") > 8, F.lit(False)) | F.coalesce(F.col("mape") > 35, F.lit(False))).alias("retrain"), F.when(F.col("mae") > 8, "mae").when(F.col("mape") > 35, "mape").alias("reason"))


def health(rows: DataFrame, now: Column, stall_hours: int = 48) -> DataFrame:
    """Of predictions: done, waiting for their time, late, given up; and the share done of those due."""
    due, old = F.col("target") <= now, F.col("target") < now - F.make_interval(hours=F.lit(stall_hours))
    none = F.col("actual").isNull()
    return rows.agg(
        F.count_if(~none).alias("done"), F.count_if(none & ~due).alias("pending"), F.count_if(none & due & ~old).alias("stalled"), F.count_if(none & old).alias("missed"), r4(100.0 * F.count_if(~none & due) / F.nullif(F.count_if(due), F.lit(0))).alias("success"),
    )


_NOW = "TIMESTAMP '2024-01-25'"


@query("mq10_health", f"WITH {CMP} SELECT count(*) FILTER (y IS NOT NULL) AS done, count(*) FILTER (y IS NULL AND ts > {_NOW}) AS pending, count(*) FILTER (y IS NULL AND ts <= {_NOW} AND ts >= {_NOW} - INTERVAL 48 HOUR) AS stalled, count(*) FILTER (y IS NULL AND ts < {_NOW} - INTERVAL 48 HOUR) AS missed, round(100.0 * count(*) FILTER (y IS NOT NULL AND ts <= {_NOW}) / nullif(count(*) FILTER (ts <= {_NOW}), 0), 4) AS success FROM cmp")
def mq10(spark, sf):
    return health(with_actuals(spark, sf), F.lit("2024-01-25").cast("timestamp"))


@query("mq11_weighted_mae", f"WITH {CMP}, d AS (SELECT CAST(ts AS DATE) AS d, count(y) AS n, avg(abs(p - y)) AS mae FROM cmp GROUP BY 1) SELECT round(sum(mae * n) / nullif(sum(n), 0), 4) AS mae, CAST(sum(n) AS BIGINT) AS n FROM d")
def mq11(spark, sf):
    d = with_actuals(spark, sf).groupBy(F.to_date("target").alias("d")).agg(F.count("actual").alias("n"), F.avg(F.abs(err())).alias("mae"))
    return d.agg(r4(F.sum(F.col("mae") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mae"), F.sum("n").alias("n"))


def model_drift(daily: DataFrame, trained: Column, days: int = 7) -> DataFrame:
    """The mean of the last daily MAEs against that of training, in percent, with its band."""
    last = daily.orderBy(F.desc("day")).limit(days).agg(F.avg("mae").alias("live"))
    drift = (F.col("live") - trained) / trained * 100
    return last.select(r4(F.col("live")).alias("live"), r4(drift).alias("drift"), F.when(drift >= 30, "critical").when(drift >= 20, "warning").otherwise("ok").alias("band"))


@query("mq12_model_drift", f"WITH {CMP}, d AS (SELECT CAST(ts AS DATE) AS d, avg(abs(p - y)) AS mae FROM cmp WHERE y IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 7), l AS (SELECT avg(mae) AS live FROM d) SELECT round(live, 4) AS live, round((live - 130) / 130 * 100, 4) AS drift, CASE WHEN (live - 130) / 130 * 100 >= 30 THEN 'critical' WHEN (live - 130) / 130 * 100 >= 20 THEN 'warning' ELSE 'ok' END AS band FROM l")
def mq12(spark, sf):
    d = with_actuals(spark, sf).filter(F.col("actual").isNotNull()).groupBy(F.to_date("target").alias("day")).agg(F.avg(F.abs(err())).alias("mae"))
    return model_drift(d, F.lit(130.0))


def feature_drift(live: DataFrame, trained: DataFrame, value: str) -> DataFrame:
    """One row: the deviation of means in percent, and the largest gap between the share of live values at the training percentiles and that share."""
    t = trained.agg(F.avg(value).alias("m"), F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    v = F.col(value)
    rows = live.select(value).crossJoin(F.broadcast(t))
    gap = [F.abs(F.avg((v <= F.col("p")[i]).cast("double")) - q) for i, q in enumerate((0.1, 0.5, 0.9))]
    out = rows.agg(F.avg(value).alias("live"), F.max("m").alias("trained"), F.stddev_pop(value).alias("sd"), F.greatest(*gap).alias("ks"))
    dev = F.abs(F.col("live") - F.col("trained")) / F.nullif(F.abs(F.col("trained")), F.lit(0.0)) * 100
    return out.select(r4(F.col("live")).alias("live"), r4(F.col("trained")).alias("trained"), r4(F.col("sd")).alias("sd"), r4(F.col("ks")).alias("ks"), r4(dev).alias("deviation"), F.when(dev >= 30, "critical").when(dev >= 15, "warning").otherwise("ok").alias("band"))


@query("mq13_feature_drift", f"WITH {Q}, t AS (SELECT avg(wait) AS m, quantile_cont(wait, 0.1) AS a, quantile_cont(wait, 0.5) AS b, quantile_cont(wait, 0.9) AS c FROM q WHERE ts < TIMESTAMP '2024-01-20'), l AS (SELECT avg(wait) AS live, max(m) AS trained, stddev_pop(wait) AS sd, greatest(abs(avg(CAST(wait <= a AS INT)) - 0.1), abs(avg(CAST(wait <= b AS INT)) - 0.5), abs(avg(CAST(wait <= c AS INT)) - 0.9)) AS ks FROM q, t WHERE ts >= TIMESTAMP '2024-01-20' AND entity_id % 7 < 3) SELECT round(live, 4) AS live, round(trained, 4) AS trained, round(sd, 4) AS sd, round(ks, 4) AS ks, round(abs(live - trained) / trained * 100, 4) AS deviation, CASE WHEN abs(live - trained) / trained * 100 >= 30 THEN 'critical' WHEN abs(live - trained) / trained * 100 >= 15 THEN 'warning' ELSE 'ok' END AS band FROM l")
def mq13(spark, sf):
    log, cut = queue_log(spark, sf), F.lit("2024-01-20").cast("timestamp")
    return feature_drift(log.filter((F.col("ts") >= cut) & (F.col("entity_id") % 7 < 3)), log.filter(F.col("ts") < cut), "wait")


def anomalies(rows: DataFrame, sigmas: float = 3.0, most_error: float = 50.0) -> DataFrame:
    """Actuals far above the mean of the positive ones, and large errors; the first of each ride, kind and hour. No positive actuals, no rows."""
    stats = rows.filter(F.col("actual") > 0).agg(F.avg("actual").alias("m"), F.stddev_pop("actual").alias("s"))
    z = (F.col("actual") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    kinds = F.filter(F.array(F.when(z > sigmas, F.struct(F.lit("extreme").alias("kind"), F.least(F.lit(100.0), z / 3 * 100).alias("score"))), F.when(F.abs(err()) > most_error, F.struct(F.lit("error").alias("kind"), F.least(F.lit(100.0), F.abs(err())).alias("score")))), lambda x: x.isNotNull())
    found = rows.filter(F.col("actual").isNotNull()).crossJoin(F.broadcast(stats)).withColumn("a", F.explode(kinds)).select("left_id", "entity_id", "target", "a.*")
    return first_per(found.withColumn("hour", F.date_format("target", "yyyy-MM-dd HH")), ["entity_id", "kind", "hour"], "target", "left_id")


@query("mq14_anomalies", f"WITH {CMP}, s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM cmp WHERE y > 0), f AS (SELECT event_id, entity_id, ts, 'extreme' AS kind, least(100, (y - m) / s / 3 * 100) AS score FROM cmp, s WHERE (y - m) / s > 1.5 UNION ALL SELECT event_id, entity_id, ts, 'error', least(100, abs(p - y)) FROM cmp WHERE abs(p - y) > 80) SELECT event_id AS left_id, kind, round(score, 4) AS score FROM f QUALIFY row_number() OVER (PARTITION BY entity_id, kind, date_trunc('hour', ts) ORDER BY ts, event_id) = 1")
def mq14(spark, sf):
    return anomalies(with_actuals(spark, sf), 1.5, 80).select("left_id", "kind", r4(F.col("score")).alias("score"))


@query("mq15_deviation_flag", f"WITH {CMP} SELECT event_id AS left_id, abs(p - y) > 10 OR abs(p - y) / nullif(p, 0) > 0.2 AS deviates FROM cmp WHERE y IS NOT NULL")
def mq15(spark, sf):
    return with_actuals(spark, sf).filter(F.col("actual").isNotNull()).select("left_id", ((F.abs(err()) > 10) | (F.abs(err()) / F.nullif(F.col("predicted"), F.lit(0.0)) > 0.2)).alias("deviates"))


def alerts(stats: DataFrame) -> DataFrame:
    """stats (mae, critical, coverage): a row for each rule that is broken."""
    rules = F.filter(F.array(F.when(F.col("mae") > 13, "mae"), F.when(F.col("critical") > 0, "drift"), F.when(F.col("coverage") < 80, "coverage")), lambda x: x.isNotNull())
    return stats.select(F.explode(rules).alias("alert"))


@query("mq16_alerts", f"WITH {CMP}, s AS (SELECT {_E} FROM cmp) SELECT 'mae' AS alert FROM s WHERE mae > 13 UNION ALL SELECT 'coverage' FROM s WHERE coverage < 80")
def mq16(spark, sf):
    return alerts(errors([], with_actuals(spark, sf)).withColumn("critical", F.lit(0)))


def board(rows: DataFrame, models: list[str], segments: dict[str, Column], leads: dict[str, Column]) -> DataFrame:
    """Every model, segment and lead bucket on the same rows: n, MAE, bias and means. One row fans out by arrays; no join."""
    on = lambda m: F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in m.items())), lambda x: x.isNotNull())
    long = rows.withColumn("segment", F.explode(on(segments))).withColumn("lead", F.explode(on(leads)))
    long = long.withColumn("m", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models)))).select("segment", "lead", "actual", "m.*")
    return long.groupBy("model", "segment", "lead").agg(F.count(F.lit(1)).alias("n"), r4(F.avg(F.abs(F.col("p") - F.col("actual")))).alias("mae"), r4(F.avg(F.col("p") - F.col("actual"))).alias("bias"), r4(F.avg("p")).alias("mean_p"), r4(F.avg("actual")).alias("mean_y"))


_SEG = "(VALUES ('all'), ('busy'), ('mid'), ('quiet')) s(segment), (VALUES ('all'), ('<=3h'), ('3-6h'), ('>6h')) l(lead)"
_ON = "(segment = 'all' OR (segment = 'busy' AND actual >= 300) OR (segment = 'mid' AND actual >= 100 AND actual < 300) OR (segment = 'quiet' AND actual < 100)) AND (lead = 'all' OR (lead = '<=3h' AND lead_h <= 3) OR (lead = '3-6h' AND lead_h > 3 AND lead_h <= 6) OR (lead = '>6h' AND lead_h > 6))"


@query("mq18_intraday_board", f"WITH {Q}, {_FC}, m AS (SELECT 'view' AS model, forecast AS p, actual, lead_h FROM fc UNION ALL SELECT 'half', forecast * 0.71337, actual, lead_h FROM fc) SELECT model, segment, lead, count(*) AS n, round(avg(abs(p - actual)), 4) AS mae, round(avg(p - actual), 4) AS bias, round(avg(p), 4) AS mean_p, round(avg(actual), 4) AS mean_y FROM m, {_SEG} WHERE {_ON} GROUP BY 1, 2, 3")
def mq18(spark, sf):
    rows = forecasts(spark, sf).withColumns({"view": F.col("forecast"), "half": F.col("forecast") * 0.71337})
    y, h = F.col("actual"), F.col("lead_h")
    return board(rows, ["view", "half"], {"all": F.lit(True), "busy": y >= 300, "mid": (y >= 100) & (y < 300), "quiet": y < 100}, {"all": F.lit(True), "<=3h": h <= 3, "3-6h": (h > 3) & (h <= 6), ">6h": h > 6})


def serve_round(x: Column) -> Column:
    """To the nearest five; a positive wait is at least ten."""
    five = F.floor((x + 2.5) / 5) * 5
    return F.when(x <= 0, 0).otherwise(F.greatest(five, F.lit(10))).cast("int")


def persistence_blend(model: Column, anchor: Column, lead_h: Column, gate: float = 40) -> Column:
    """Near leads lean on what is seen now: its weight is (3 - lead) / 2 within 0..1, only from a busy anchor on."""
    a = F.greatest(F.least((3 - lead_h) / 2, F.lit(1.0)), F.lit(0.0))
    return F.when(anchor.isNotNull() & (anchor >= gate), a * anchor + (1 - a) * model).otherwise(model)


@query("mq20_persistence_blend", f"WITH {Q}, {_FC}, b AS (SELECT target_id, event_id, CASE WHEN actual >= 40 THEN greatest(least((3 - lead_h) / 2, 1), 0) * actual + (1 - greatest(least((3 - lead_h) / 2, 1), 0)) * forecast ELSE forecast END AS x FROM fc) SELECT target_id, event_id, round(x, 4) AS blend, CASE WHEN x <= 0 THEN 0 ELSE greatest(CAST(floor((x + 2.5) / 5) * 5 AS INT), 10) END AS served FROM b")
def mq20(spark, sf):
    rows = forecasts(spark, sf).withColumn("x", persistence_blend(F.col("forecast"), F.col("actual"), F.col("lead_h")))
    return rows.select("target_id", "event_id", r4(F.col("x")).alias("blend"), serve_round(F.col("x")).alias("served"))


def full_days(rows: DataFrame, at: str, freeze_hours: int = 14) -> DataFrame:
    """Rows of days that are wholly covered: from the first day that begins after the first row, less a freeze."""
    first = rows.agg(F.min(at).alias("_a"))
    cut = F.date_trunc("DAY", F.col("_a") + F.make_interval(hours=F.lit(24 + freeze_hours)))
    return rows.crossJoin(F.broadcast(first)).filter(F.col(at) >= cut).drop("_a")


@query("mq22_full_days", f"WITH {Q} SELECT event_id FROM op WHERE ts >= (SELECT date_trunc('day', min(ts) + INTERVAL 38 HOUR) FROM op)")
def mq22(spark, sf):
    from queuelake.operators.rollup import standby_operating

    return full_days(standby_operating(queue_log(spark, sf)), "ts").select("event_id")


def monotone(quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """A higher quantile is no lower than those below it."""
    return quantiles.withColumn("value", F.max("value").over(Window.partitionBy(*keys).orderBy("alpha").rowsBetween(Window.unboundedPreceding, 0)))


@query("mq23_monotone_quantiles", f"WITH {Q} SELECT entity_id, event_id, max(value) OVER (PARTITION BY entity_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value FROM q")
def mq23(spark, sf):
    return monotone(queue_log(spark, sf).withColumn("alpha", F.col("event_id")), ["entity_id"]).select("entity_id", "event_id", "value")


@query("mq26_feature_stats", f"WITH {Q}, u AS (SELECT 'wait' AS feature, CAST(wait AS DOUBLE) AS v FROM q UNION ALL SELECT 'hour', CAST(hour(ts) AS DOUBLE) FROM q) SELECT feature, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS least, max(v) AS most, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90 FROM u GROUP BY 1")
def mq26(spark, sf):
    wide = queue_log(spark, sf).select("event_id", F.col("wait").cast("double").alias("wait"), F.hour("ts").cast("double").alias("hour"))
    long = wide.unpivot("event_id", ["wait", "hour"], "feature", "v")
    p = F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"), p.alias("p"))
    return out.select("feature", r4(F.col("mean")).alias("mean"), r4(F.col("sd")).alias("sd"), "least", "most", *(r4(F.col("p")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


@query("mq26_top_values", f"WITH {Q}, c AS (SELECT park_id, event_type, count(*) AS n FROM q GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY n DESC, event_type) <= 2")
def mq26b(spark, sf):
    c = queue_log(spark, sf).groupBy("park_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("park_id").orderBy(F.desc("n"), "event_type"))).filter("k <= 2").drop("k")
