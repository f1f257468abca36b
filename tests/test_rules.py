"""Boundaries of ladders and rules, definitions of percentiles, streams against batches, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from queuelake.functions import ladders as L
from queuelake.functions import text as X
from queuelake.operators import features, joins, quality, rollup, stats, windows
from queuelake.plans.adaptor import queue_log
from queuelake.sources import readers, sinks
from queuelake.streaming import delta

SF = "/root/testdata/sf0.001"


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_crowd_ladder_edges(spark):
    edges = [(60.0, "very_low"), (60.1, "low"), (89.0, "low"), (89.1, "moderate"), (110.0, "moderate"), (110.1, "high"), (150.0, "high"), (150.1, "very_high"), (200.0, "very_high"), (200.1, "extreme"), (None, "unknown")]
    got = values(spark, [(x,) for x, _ in edges], "x double", L.crowd_level(F.col("x")))
    assert [g[0] for g in got] == [e for _, e in edges]


def test_trend(spark):
    rows = [(30.0, 20.0, "up"), (26.0, 20.0, "up"), (25.0, 20.0, "stable"), (10.0, 20.0, "down"), (112.0, 100.0, "up"), (110.0, 100.0, "stable"), (None, 20.0, "stable")]
    got = values(spark, [r[:2] for r in rows], "a double, b double", L.trend(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [r[2] for r in rows]


def test_rounding(spark):
    got = values(spark, [(x,) for x in (0.0, 2.4, 2.5, 7.4, 7.5, 12.0)], "x double", rollup.round5(F.col("x")), quality.serve_round(F.col("x")))
    assert got == [(0, 0), (0, 10), (5, 10), (5, 10), (10, 10), (10, 10)]


def test_percentile_definitions(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int")
    assert df.agg(F.percentile("x", F.lit(0.5))).first()[0] == 2.5
    assert df.agg(rollup.nearest_rank(F.sort_array(F.collect_list("x")), 0.5)).first()[0] == 2


def test_consensus(spark):
    rows = [([12],), ([10, 21],), ([10, 12, 60],), ([5, 40, 90],), ([],), ([None, 33],)]
    assert [r[0] for r in values(spark, rows, "w array<int>", L.consensus(F.col("w")))] == [10, 15, 10, 40, None, 35]


def test_easter(spark):
    years = {1961: "04-02", 2000: "04-23", 2024: "03-31", 2025: "04-20", 2038: "04-25"}
    got = values(spark, [(y,) for y in years], "y int", "y", F.date_format(L.easter(F.col("y")), "MM-dd"))
    assert dict(got) == years


def test_blend(spark):
    rows = [(10.0, 50.0, 1.0), (10.0, 50.0, 2.0), (10.0, 50.0, 3.0), (10.0, 39.0, 1.0), (10.0, None, 1.0)]
    assert [r[0] for r in values(spark, rows, "m double, a double, l double", quality.persistence_blend(F.col("m"), F.col("a"), F.col("l")))] == [50.0, 30.0, 10.0, 10.0, 10.0]


def test_text(spark):
    got = values(spark, [("Åse Straße", "night", "nacht")], "a string, b string, c string", X.fold(F.col("a")), X.dice(F.col("b"), F.col("c")), X.trigram_similarity(F.col("b"), F.col("b")), X.within_edits(F.col("b"), F.col("c"), 1), L.slug(F.lit("  Élan & Café!! ")))
    assert got[0][0] == "ase strasse" and got[0][1] == 0.25 and got[0][2] == 1.0 and got[0][3] is None and got[0][4] == "elan-cafe"
    d = values(spark, [(52.52, 13.405, 48.8566, 2.3522)], "a double, b double, c double, d double", X.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert abs(d[0][0] - 878) < 3


def test_quantiles_monotone(spark):
    df = spark.createDataFrame([(1, 0.1, 5.0), (1, 0.5, 4.0), (1, 0.9, 9.0)], "k int, alpha double, value double")
    assert [r.value for r in quality.monotone(df, ["k"]).orderBy("alpha").collect()] == [5.0, 5.0, 9.0]


def test_tensor_masks(spark):
    grid = windows.regular_grid(spark.createDataFrame([(1, 1, 0, 10.0), (1, 1, 1800, 20.0), (1, 2, 900, 30.0)], "park_id int, entity_id int, slot long, y double"), 900)
    rows = {(r.entity_id, r.slot): r for r in windows.tensor(grid).collect()}
    assert len(rows) == 6 and rows[1, 900].filled == 10.0 and not rows[1, 900].observed and rows[2, 0].filled == 0.0 and rows[1, 900].park_mean == 30.0 and not rows[1, 0].park_open


def test_rope_drop(spark):
    days = [(1, d, m, p) for d in range(4) for m, p in ((0, 20.0), (15, 40.0), (30, 100.0), (45, 110.0), (60, 100.0), (75, 60.0), (90, 10.0))]
    r = stats.rope_drop(spark.createDataFrame(days, "entity_id int, day int, minutes int, p90 double")).first()
    assert r.worth and r.strength == "high" and r.ride_by == 30 and r.best == 0 and r.peak == 110.0 and r.saved == 90.0


def test_schedule_rules(spark):
    rows = [(1, dt.date(2024, 1, 1), "OPERATING"), (1, dt.date(2024, 1, 4), "OPERATING"), (1, dt.date(2024, 1, 6), "UNKNOWN")]
    got = {(r.date.day, r.type) for r in features.schedule_gaps(spark.createDataFrame(rows, "park_id int, date date, type string")).collect()}
    assert got == {(2, "CLOSED"), (3, "CLOSED"), (5, "UNKNOWN")}
    h = spark.createDataFrame([(1, dt.date(2024, 5, 9)), (1, dt.date(2024, 4, 30))], "k int, day date")  # a Thursday and a Tuesday
    assert {r.day for r in features.bridge_days(h, "k").collect()} == {dt.date(2024, 5, 10), dt.date(2024, 4, 29)}


def test_open_parks_frozen_and_closed(spark):
    t = dt.datetime(2024, 1, 1, 12)
    ago = lambda m: t - dt.timedelta(minutes=m)
    log = [(p, e, ago(m), 30 if p == 2 else 20 + m, "OPERATING") for p in (1, 2, 3) for e in (1, 2, 3) for m in (10, 40)]
    df = spark.createDataFrame(log, "park_id int, entity_id int, ts timestamp, wait int, status string")
    s = spark.createDataFrame([(3, dt.date(2024, 1, 1), "CLOSED"), (4, dt.date(2024, 1, 1), "OPERATING")], "park_id int, date date, type string")
    assert {r.park_id for r in stats.open_parks(df, s, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()} == {1, 4}


def fold(rows):
    kept, last = [], {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        k, now = (r.entity_id, r.queue_type), (r.day, r.status, r.wait)
        old = last.get(k)
        if old is None or old[1] != now or (r.ts - old[0]).total_seconds() > 3600:
            kept.append(r.event_id)
            last[k] = (r.ts, now)
    return sorted(kept)


@pytest.fixture(scope="module")
def polls(spark):
    start = dt.datetime(2024, 1, 1, 8)
    rows = [(i, i % 3, "STANDBY", start + dt.timedelta(minutes=5 * (i // 3)), start + dt.timedelta(minutes=5 * (i // 3)), "OPERATING" if i % 50 else "DOWN", 10 + i // 60 % 2 * 5) for i in range(600)]
    return spark.createDataFrame(rows, "event_id long, entity_id long, queue_type string, ts timestamp, lts timestamp, status string, wait int")


def test_delta_batch_equals_fold(spark, polls):
    want = fold(delta.plain(polls).collect())
    assert sorted(r.event_id for r in delta.compressed(polls).collect()) == want and 20 < len(want) < 300


def test_delta_stream_equals_batch(spark, polls, tmp_path):
    plain = delta.plain(polls)
    for k in range(3):  # three polls of 200 rows, in order
        plain.filter(F.floor(F.col("event_id") / 200) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = delta.compressed_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("kept").collect()) == fold(plain.collect())


def test_rollup_stream_and_upsert(spark, polls, tmp_path):
    polls.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(polls.schema).parquet(f"{tmp_path}/in")
    out = delta.rollup_stream(stream).select(F.col("window.start").alias("hour"), "entity_id", "mean", "n")
    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(delta.upsert_batches(f"{tmp_path}/out", ["hour", "entity_id"])).start()
    q.awaitTermination(120)
    got = {(r.hour, r.entity_id): (r.mean, r.n) for r in sinks.current(spark, f"{tmp_path}/out").collect()}
    want = {(r.hour, r.entity_id): (r.mean, r.n) for r in polls.groupBy(F.date_trunc("HOUR", "ts").alias("hour"), "entity_id").agg(F.avg("wait").alias("mean"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "2024-01-01"), (2, -1, "2024-01-02"), (3, None, "2024-01-03")], "k int, wait int, day string")
    sinks.append(rows, F.col("wait") >= 0, f"{tmp_path}/ok", f"{tmp_path}/bad")
    assert spark.read.parquet(f"{tmp_path}/ok").count() == 1 and spark.read.parquet(f"{tmp_path}/bad").count() == 2
    sinks.upsert(spark, f"{tmp_path}/t", rows, ["k"])
    sinks.upsert(spark, f"{tmp_path}/t", rows.filter("k > 1").withColumn("wait", F.lit(9)), ["k"])
    assert sorted((r.k, r.wait) for r in sinks.current(spark, f"{tmp_path}/t").collect()) == [(1, 5), (2, 9), (3, 9)]
    assert sinks.purge_before(spark, f"{tmp_path}/t", "day", "2024-01-02") == 1 and sinks.current(spark, f"{tmp_path}/t").count() == 2
    sinks.log_lines(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 3


def test_sources(spark, tmp_path):
    spark.range(2).select(F.col("id").cast("string").alias("external_id"), F.lit("OPERATING").alias("status"), F.lit(5).alias("wait")).write.json(f"{tmp_path}/a")
    a = readers.load(spark, "live", f"{tmp_path}/a")
    assert a.schema == readers.LIVE and a.filter("wait = 5").count() == 2
    assert readers.combined({"a": a, "b": a.drop("name")}).groupBy("source").count().count() == 2


def test_nearest_ties_and_tolerance(spark):
    t = dt.datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, 7, t), (2, 8, t)], "left_id int, k int, at timestamp")
    right = spark.createDataFrame([(7, t + dt.timedelta(minutes=5), "late"), (7, t - dt.timedelta(minutes=5), "early"), (8, t + dt.timedelta(minutes=31), "far")], "k int, ts timestamp, v string")
    got = {r.left_id: r.v for r in joins.nearest(left, right, ["k"], "at", 1800, ["v"]).collect()}
    assert got == {1: "early", 2: None}


def test_partitioning_does_not_matter(spark):
    log = queue_log(spark, SF)
    one, many = rollup.typical_day_peak(log.coalesce(1), F.lit("2024-01-31").cast("timestamp"), least_days=1), rollup.typical_day_peak(log.repartition(13), F.lit("2024-01-31").cast("timestamp"), least_days=1)
    assert sorted(one.collect()) == sorted(many.collect())


def test_mean_never_exceeds_top(spark):
    assert rollup.ride_stats(queue_log(spark, SF)).filter("mean > top OR mean < least").count() == 0


def test_tensor_round_trip(spark, tmp_path):
    from queuelake.sources import sinks

    cells = spark.createDataFrame([(r, s, float(r * s) if s % 3 else None, s % 3 > 0) for r in range(20) for s in range(48)], "entity_id long, slot long, y double, observed boolean")
    with pytest.raises(FileNotFoundError):
        sinks.load_tensor(spark, f"{tmp_path}/t")
    for part in (cells.filter("slot < 5"), cells):
        sinks.save_tensor(spark, f"{tmp_path}/t", part)
        got = sinks.load_tensor(spark, f"{tmp_path}/t")
        assert got.dtypes == cells.dtypes and sorted(map(str, got.collect())) == sorted(map(str, part.collect()))
    assert sinks.load_tensor(spark, f"{tmp_path}/t", ["y"]).columns == ["entity_id", "slot", "y"]


def test_search_takes_words_literally(spark):
    from queuelake.operators.lookup import search

    rows = spark.createDataFrame([("a+b ride",), ("the a+b",), ("aab",)], "name string")
    assert {r.name: r.tier for r in search(rows, "name", "a+b").collect() if r.tier < 4} == {"a+b ride": 1, "the a+b": 2}


def test_typical_waits_round_halves_as_sql(spark):
    """The exact P90 of the weekend is 42.5, that of the SQL's arithmetic 42.49999999999999."""
    free = zip((6, 7, 13, 14, 20, 21, 27, 28), (13.0, 19.0, 20.0, 21.0, 25.0, 31.0, 35.0, 60.0))
    rows = [(1, f"2024-01-{d:02} 10", p, 2) for d, p in free] + [(2, f"2024-01-{d:02} 10", 7.5, 2) for d in (2, 3)]
    rows += [(2, "2024-01-04 11", 99.0, 1)]
    got = rollup.typical_waits(spark.createDataFrame(rows, "entity_id long, hour string, p90 double, n long"), 2).orderBy("entity_id").collect()
    assert [tuple(r) for r in got] == [(1, 8, None, None, 25, 40, 60.0, "2024-01-28"), (2, 2, 10, 10, None, None, 7.5, "2024-01-03")]


def test_interpolated_equals_sql_to_the_bit(spark):
    import random

    import duckdb

    draw = random.Random(2)
    rows = [(g, [draw.randint(0, 2000) / 10 for _ in range(draw.randint(1, 30))]) for g in range(2000)] + [(2000, [])]
    df = spark.createDataFrame(rows, "g int, v array<double>").withColumn("v", F.sort_array("v"))
    got = [tuple(r) for r in df.select("g", *(rollup.interpolated(F.col("v"), q) for q in (0.5, 0.9))).orderBy("g").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, v DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute("SELECT g, quantile_cont(x, 0.5), quantile_cont(x, 0.9) FROM (SELECT g, unnest(v) AS x FROM t UNION ALL SELECT g, NULL FROM t) GROUP BY 1 ORDER BY 1").fetchall()
    assert got == want


def test_served_quantile_ties_and_gaps(spark):
    """0.7 and 0.9 are equally near to 0.8, though not in floating point; nulls are never the nearest."""
    rows = [(1, 0.7, 7.0), (1, 0.9, 9.0), (1, 0.4, 4.0), (1, 0.6, 6.0), (2, 0.5, None), (2, 0.8, None), (2, 0.3, 3.0), (2, None, 1.0), (3, 0.5, None), (4, None, 2.0)]
    got = features.served_quantile(spark.createDataFrame(rows, "k int, alpha double, value double"), ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 4.0, 7.0, 5.0), (2, 3.0, 3.0, 0.0), (3, None, None, 0.0), (4, 2.0, 2.0, 0.0)]
