"""Names, places and matching; rules on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelake.functions import ladders as L
from queuelake.functions import text as X
from queuelake.operators.latest import first_per
from queuelake.operators.rollup import round5, standby_operating
from queuelake.plans.adaptor import Q, queue_log, r4, read
from queuelake.registry import query


def _case(x: str, steps, top: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' " + " ".join(f"WHEN {x} <= {b} THEN '{n}'" for b, n in steps) + f" ELSE '{top}' END"


@query("sc1_crowd_level", f"WITH {Q} SELECT event_id, {_case('(wait / 2.0)', L.CROWD, 'extreme')} AS level, {_case('(wait / 200.0)', L.RELATIVE, 'very_high')} AS relative, round(least(greatest(wait / 10.0, 1.0), 5.0), 1) AS score FROM q")
def sc1(spark, sf):
    return queue_log(spark, sf).select("event_id", L.crowd_level(F.col("wait") / 2).alias("level"), L.relative_level(F.col("wait") / 200).alias("relative"), L.crowd_score(F.col("wait").cast("double")).alias("score"))


@query("sc3_comparison", f"WITH {Q} SELECT event_id, CASE WHEN wait / 2.0 <= 60 THEN 'much_lower' WHEN wait / 2.0 <= 89 THEN 'lower' WHEN wait / 2.0 <= 110 THEN 'typical' WHEN wait / 2.0 <= 150 THEN 'higher' ELSE 'much_higher' END AS status FROM q")
def sc3(spark, sf):
    return queue_log(spark, sf).select("event_id", L.comparison(F.col("wait") / 2).alias("status"))


@query("sc4_ag4_trend", f"WITH {Q}, b AS (SELECT entity_id, avg(CASE WHEN ts >= TIMESTAMP '2024-01-28' THEN wait END) AS now, avg(CASE WHEN ts < TIMESTAMP '2024-01-28' AND ts >= TIMESTAMP '2024-01-21' THEN wait END) AS before FROM op GROUP BY 1) SELECT entity_id, CASE WHEN now IS NULL OR before IS NULL THEN 'stable' WHEN now - before > greatest(5, before * 0.1) THEN 'up' WHEN before - now > greatest(5, before * 0.1) THEN 'down' ELSE 'stable' END AS trend FROM b")
def sc4(spark, sf):
    day = lambda d: F.lit(d).cast("timestamp")
    w, ts = F.col("wait"), F.col("ts")
    rows = standby_operating(queue_log(spark, sf)).groupBy("entity_id").agg(F.avg(F.when(ts >= day("2024-01-28"), w)).alias("now"), F.avg(F.when((ts < day("2024-01-28")) & (ts >= day("2024-01-21")), w)).alias("before"))
    return rows.select("entity_id", L.trend(F.col("now"), F.col("before")).alias("trend"))


@query("sc5_round_five", f"WITH {Q} SELECT event_id, CAST(floor((value + 2.5) / 5) * 5 AS INT) AS five, CASE WHEN value <= 0 THEN 0 ELSE greatest(CAST(floor((value + 2.5) / 5) * 5 AS INT), 10) END AS served FROM q")
def sc5(spark, sf):
    from queuelake.operators.quality import serve_round

    return queue_log(spark, sf).select("event_id", round5(F.col("value")).alias("five"), serve_round(F.col("value")).alias("served"))


@query("sc8_recommendation", f"""WITH {Q}, x AS (SELECT event_id, {_case('(wait / 2.0)', L.CROWD, 'extreme')} AS lv, wait % 5 = 0 AS h, wait % 3 = 0 AS v, wait % 7 = 0 AS b, wait % 100 AS w FROM q),
p AS (SELECT event_id, CASE lv WHEN 'very_low' THEN 5 WHEN 'low' THEN 4 WHEN 'moderate' THEN 3 WHEN 'high' THEN 2 ELSE 1 END - least(CAST(h AS INT) + CAST(v AS INT) + CAST(b AS INT), 2) - CASE WHEN w >= 95 THEN 2 WHEN w >= 61 THEN 1 ELSE 0 END AS p FROM x)
SELECT event_id, CASE WHEN p >= 4 THEN 'highly_recommended' WHEN p >= 3 THEN 'recommended' WHEN p >= 2 THEN 'neutral' WHEN p >= 1 THEN 'avoid' ELSE 'strongly_avoid' END AS rec FROM p""")  # fmt: skip
def sc8(spark, sf):
    w = F.col("wait")
    return queue_log(spark, sf).select("event_id", L.recommendation(L.crowd_level(w / 2), w % 5 == 0, w % 3 == 0, w % 7 == 0, w % 100).alias("rec"))


def places(spark, sf) -> DataFrame:
    """Nations on the globe, by a fixed rule."""
    n = read(spark, sf, "nation")
    return n.select("n_nationkey", "n_name", "n_regionkey", ((F.col("n_nationkey") * 7) % 120 - 60).cast("double").alias("lat"), ((F.col("n_nationkey") * 29) % 340 - 170).cast("double").alias("lon"))


_PL = "pl AS (SELECT n_nationkey, n_name, n_regionkey, CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 29) % 340 - 170 AS DOUBLE) AS lon FROM nation)"
_HAV = "2 * 6371 * asin(least(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)), 1))"


@query("sc9_haversine", f"WITH {_PL} SELECT a.n_nationkey AS a, b.n_nationkey AS b, round({_HAV.format(a='a', b='b')}, 3) AS km FROM pl a JOIN pl b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def sc9(spark, sf):
    p = places(spark, sf)
    a, b = p.alias("a"), p.alias("b")
    rows = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return rows.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(X.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 3).alias("km"))


def nearest_places(places_: DataFrame, lat: float, lon: float, k: int, radius: float | None = None) -> DataFrame:
    """The k places nearest to a point, within a radius: a top-k without a full sort."""
    km = X.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    out = places_.withColumn("km", km)
    return (out if radius is None else out.filter(F.col("km") <= radius)).orderBy("km", "n_nationkey").limit(k)


@query("jn24_nearest_places", f"WITH {_PL}, me AS (SELECT 10.0 AS lat, 20.0 AS lon) SELECT n_nationkey, round({_HAV.format(a='me', b='pl')}, 3) AS km FROM pl, me WHERE {_HAV.format(a='me', b='pl')} <= 9000 ORDER BY {_HAV.format(a='me', b='pl')}, n_nationkey LIMIT 6")
def jn24(spark, sf):
    return nearest_places(places(spark, sf), 10.0, 20.0, 6, 9000).select("n_nationkey", F.round("km", 3).alias("km"))


@query("sc10_box", f"WITH {_PL} SELECT n_nationkey FROM pl WHERE lat BETWEEN -50 AND 20 AND lon BETWEEN -100 AND 100")
def sc10(spark, sf):
    return places(spark, sf).filter(X.in_box(F.col("lat"), F.col("lon"), (-50, -100, 20, 100))).select("n_nationkey")


@query("sc10_polygon", f"WITH {_PL}, e AS (SELECT * FROM (VALUES (-60.0, -160.0, -60.0, 170.0), (-60.0, 170.0, 60.0, 5.0), (60.0, 5.0, -60.0, -160.0)) t(y1, x1, y2, x2)) SELECT n_nationkey FROM pl, e GROUP BY n_nationkey HAVING count(*) FILTER (y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / CASE WHEN y1 = y2 THEN 1 ELSE y2 - y1 END + x1) % 2 = 1")
def sc10b(spark, sf):
    return places(spark, sf).filter(X.in_polygon(F.col("lat"), F.col("lon"), [(-60.0, -160.0), (-60.0, 170.0), (60.0, 5.0)])).select("n_nationkey")


@query("sc11_slugs", "SELECT doc_id, trim(regexp_replace(replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def sc11(spark, sf):
    return read(spark, sf, "documents").select("doc_id", L.slug(F.col("text")).alias("slug"))


_DICE = "CASE WHEN {a} = {b} THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


def _grams(t: str, n: int = 2) -> str:
    return f"list_distinct(list_transform(range(1, length({t}) - {n - 2}), lambda i: substring({t}, i, {n})))"


@query("sc12_dice", f"WITH p AS (SELECT p_partkey, p_name, p_type FROM part), g AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM p) SELECT p_partkey, round({_DICE.format(a='a', b='b', x=_grams('a'), y=_grams('b'))}, 4) AS dice FROM g")
def sc12(spark, sf):
    return read(spark, sf, "part").select("p_partkey", r4(X.dice(F.lower("p_name"), F.lower("p_type"))).alias("dice"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("sc13_trigrams", f"WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, {_TRI.format(t='p_name')} AS x, {_TRI.format(t=chr(39) + 'red widgets' + chr(39))} AS y FROM n) SELECT p_name, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) AS sim FROM t")
def sc13(spark, sf):
    return read(spark, sf, "part").select("p_name").distinct().select("p_name", r4(X.trigram_similarity(F.col("p_name"), F.lit("red widgets"))).alias("sim"))


@query("sc15_bounded_edits", "WITH n AS (SELECT DISTINCT p_name FROM part) SELECT p_name, CASE WHEN levenshtein(p_name, 'red widget') <= 5 THEN levenshtein(p_name, 'red widget') END AS edits FROM n")
def sc15(spark, sf):
    return read(spark, sf, "part").select("p_name").distinct().select("p_name", X.within_edits(F.col("p_name"), F.lit("red widget"), 5).cast("long").alias("edits"))


def search(rows: DataFrame, name: str, words: str, least: float = 0.3) -> DataFrame:
    """Tiers of how well a name fits: equal, prefix, word prefix, contained, sounding alike by trigrams, few edits; best first."""
    n, q = F.lower(name), words.lower()
    sim = X.trigram_similarity(F.col(name), F.lit(words))
    edits = X.within_edits(n, F.lit(q), 2)
    tier = F.when(n == q, 0).when(F.startswith(n, F.lit(q)), 1).when(n.rlike(rf"(^|[^a-z0-9])\Q{q.replace(chr(92) + 'E', '')}\E"), 2).when(F.contains(n, F.lit(q)), 3).when(sim >= least, 4).when(edits.isNotNull(), 5)
    return rows.withColumns({"tier": tier, "sim": r4(sim)}).filter("tier IS NOT NULL")


@query("sc31_fuzzy_search", f"WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, lower(p_name) AS n, {_TRI.format(t='p_name')} AS x, {_TRI.format(t=chr(39) + 'widget' + chr(39))} AS y FROM n), s AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim FROM t), r AS (SELECT p_name, round(sim, 4) AS sim, CASE WHEN n = 'widget' THEN 0 WHEN starts_with(n, 'widget') THEN 1 WHEN regexp_matches(n, '(^|[^a-z0-9])widget') THEN 2 WHEN contains(n, 'widget') THEN 3 WHEN sim >= 0.3 THEN 4 WHEN levenshtein(n, 'widget') <= 2 THEN 5 END AS tier FROM s) SELECT * FROM r WHERE tier IS NOT NULL")
def sc31(spark, sf):
    return search(read(spark, sf, "part").select("p_name").distinct(), "p_name", "widget")


def pair_score(names: Column, same_country: Column, same_zone: Column, km: Column, mismatch: Column, other_continent: Column) -> Column:
    """0.5 name + 0.15 country + 0.05 zone + 0.3 nearness - 0.4 for a water park beside a theme park; 0 across continents."""
    geo = F.greatest(F.lit(0.0), 1 - km / 50)
    s = 0.5 * names + F.when(same_country, 0.15).otherwise(0.0) + F.when(same_zone, 0.05).otherwise(0.0) + 0.3 * geo - F.when(mismatch, 0.4).otherwise(0.0)
    return F.when(other_continent, 0.0).otherwise(F.greatest(s, F.lit(0.0)))


@query("jn21_pair_score", f"WITH s AS (SELECT s_suppkey, lower(s_name) AS n, s_nationkey, s_acctbal FROM supplier), p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.n AS x, b.n AS y, a.s_nationkey % 5 = b.s_nationkey % 5 AS z, abs(a.s_acctbal - b.s_acctbal) / 100 AS km, (a.s_suppkey % 7 = 0) <> (b.s_suppkey % 7 = 0) AS m FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT a, b, round(greatest(0.5 * {_DICE.format(a='x', b='y', x=_grams('x'), y=_grams('y'))} + 0.15 + CASE WHEN z THEN 0.05 ELSE 0 END + 0.3 * greatest(0, 1 - km / 50) - CASE WHEN m THEN 0.4 ELSE 0 END, 0), 4) AS score FROM p")
def jn21(spark, sf):
    s = read(spark, sf, "supplier").withColumn("n", F.lower("s_name"))
    l, r = s.alias("l"), s.alias("r")
    rows = l.join(r, (F.col("l.s_nationkey") == F.col("r.s_nationkey")) & (F.col("l.s_suppkey") < F.col("r.s_suppkey")))
    score = pair_score(X.dice(F.col("l.n"), F.col("r.n")), F.lit(True), F.col("l.s_nationkey") % 5 == F.col("r.s_nationkey") % 5, F.abs(F.col("l.s_acctbal") - F.col("r.s_acctbal")) / 100, (F.col("l.s_suppkey") % 7 == 0) != (F.col("r.s_suppkey") % 7 == 0), F.lit(False))
    return rows.select(F.col("l.s_suppkey").alias("a"), F.col("r.s_suppkey").alias("b"), r4(score).alias("score"))


def one_to_one(pairs: DataFrame, block: str, least: float = 0.7) -> DataFrame:
    """Greedy matching inside each block: the best pair whose sides are both free, and so on. A block is one country's candidates."""

    def greedy(rows):
        rows = rows.sort_values(["score", "a", "b"], ascending=[False, True, True])
        used_a, used_b, keep = set(), set(), []
        for i, a, b in zip(rows.index, rows["a"], rows["b"]):
            if a not in used_a and b not in used_b:
                used_a.add(a), used_b.add(b), keep.append(i)
        return rows.loc[keep, [block, "a", "b", "score"]]

    return pairs.filter(F.col("score") >= least).groupBy(block).applyInPandas(greedy, f"{block} long, a long, b long, score double")


@query("jn20_greedy_matching")
def jn20(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    b = read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("y"))
    pairs = a.join(b, "nation").withColumn("score", F.round(1 - F.abs(F.col("x") - F.col("y")) / 1000, 6)).filter("score >= 0.7")
    return one_to_one(pairs.select("nation", "a", "b", "score"), "nation")


def merged_sources(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two sources joined in full on a normalised name: the first one's value, else the second's, and who had it."""
    rows = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key, "full")
    return rows.select(key, F.coalesce("x", "y").alias(value), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), "both").when(F.col("x").isNotNull(), "first").otherwise("second").alias("origin"))


@query("jn23_merged_sources", "WITH a AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def jn23(spark, sf):
    of = lambda s: read(spark, sf, "orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return merged_sources(of("F"), of("P"), "o_custkey", "v")


@query("dd17_existing_match", "SELECT c_custkey, coalesce(x.s_suppkey, y.s_suppkey) AS s_suppkey, CASE WHEN x.s_suppkey IS NOT NULL THEN 'id' WHEN y.s_suppkey IS NOT NULL THEN 'name' END AS by FROM customer LEFT JOIN supplier x ON c_custkey = x.s_suppkey * 10 LEFT JOIN (SELECT regexp_replace(s_name, '[^0-9]', '', 'g') AS k, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) y ON regexp_replace(c_name, '[^0-9]', '', 'g') = y.k")
def dd17(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    by_id = s.select((F.col("s_suppkey") * 10).alias("c_custkey"), F.col("s_suppkey").alias("x"))
    digits = lambda n: F.regexp_replace(n, "[^0-9]", "")
    by_name = s.groupBy(digits("s_name").alias("k")).agg(F.min("s_suppkey").alias("y"))
    rows = c.withColumn("k", digits("c_name")).join(by_id, "c_custkey", "left").join(by_name, "k", "left")
    return rows.select("c_custkey", F.coalesce("x", "y").alias("s_suppkey"), F.when(F.col("x").isNotNull(), "id").when(F.col("y").isNotNull(), "name").alias("by"))


@query("sc19_cyclic", f"WITH {Q} SELECT event_id, round(sin(2 * pi() * hour(lts) / 24), 4) AS sin_hour, round(cos(2 * pi() * month(lts) / 12), 4) AS cos_month, CASE WHEN month(lts) IN (12, 1, 2) THEN 0 WHEN month(lts) IN (3, 4, 5) THEN 1 WHEN month(lts) IN (6, 7, 8) THEN 2 ELSE 3 END AS season, round(5 + 10 * (1 + cos((hour(lts) - 15) / 24 * 2 * 3.141592653589793)) / 2, 4) AS temp FROM q")
def sc19(spark, sf):
    turn = lambda c, n: 2 * F.pi() * c / n
    t = L.temperature_at(F.lit(5.0), F.lit(15.0), F.hour("lts"))
    return queue_log(spark, sf).select("event_id", r4(F.sin(turn(F.hour("lts"), 24))).alias("sin_hour"), r4(F.cos(turn(F.month("lts"), 12))).alias("cos_month"), L.season(F.month("lts")).alias("season"), r4(t).alias("temp"))


@query("sc23_easter", "WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders) SELECT y AS year, CASE y WHEN 1995 THEN '1995-04-16' WHEN 1996 THEN '1996-04-07' WHEN 1997 THEN '1997-03-30' WHEN 1998 THEN '1998-04-12' WHEN 1999 THEN '1999-04-04' WHEN 2000 THEN '2000-04-23' WHEN 2001 THEN '2001-04-15' END AS easter FROM y")
def sc23(spark, sf):
    return read(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct().select("year", F.date_format(L.easter(F.col("year")), "yyyy-MM-dd").alias("easter"))


@query("sc24_region_codes", "SELECT n_nationkey, upper(regexp_extract(CASE n_nationkey % 3 WHEN 0 THEN 'de-by' WHEN 1 THEN 'US_fl' ELSE 'Bavaria' END, '^(?:[A-Za-z]{2}[-_])?(.*)$', 1)) AS region FROM nation")
def sc24(spark, sf):
    code = F.when(F.col("n_nationkey") % 3 == 0, "de-by").when(F.col("n_nationkey") % 3 == 1, "US_fl").otherwise("Bavaria")
    return read(spark, sf, "nation").select("n_nationkey", L.region_code(code).alias("region"))


@query("sc25_closing_time", f"WITH {Q}, t AS (SELECT event_id, date_trunc('day', ts) + INTERVAL 10 HOUR AS o, date_trunc('day', ts) + (wait % 24) * INTERVAL 1 HOUR AS c FROM q) SELECT event_id, strftime(CASE WHEN c < o THEN c + INTERVAL 1 DAY ELSE c END, '%Y-%m-%d %H') AS closes FROM t")
def sc25(spark, sf):
    day = F.date_trunc("DAY", "ts")
    closes = day + F.make_interval(hours=F.col("wait") % 24)
    return queue_log(spark, sf).select("event_id", F.date_format(L.closing_after_opening(day + F.expr("INTERVAL 10 HOURS"), closes), "yyyy-MM-dd HH").alias("closes"))


_W5 = "CAST(floor(({x} + 2.5) / 5) * 5 AS INT)"


@query("sc29_consensus", f"WITH {Q}, s AS (SELECT event_id, list_sort(list_filter([wait, CASE WHEN event_id % 2 = 0 THEN wait + event_id % 13 END, CASE WHEN event_id % 3 = 0 THEN wait + 7 END], lambda x: x IS NOT NULL)) AS w FROM q) SELECT event_id, CASE len(w) WHEN 1 THEN {_W5.format(x='w[1]')} WHEN 2 THEN {_W5.format(x='(w[1] + w[2]) / 2')} ELSE CASE WHEN w[2] - w[1] <= 5 AND w[2] - w[1] <= w[3] - w[2] THEN {_W5.format(x='(w[1] + w[2]) / 2')} WHEN w[3] - w[2] <= 5 THEN {_W5.format(x='(w[2] + w[3]) / 2')} ELSE {_W5.format(x='w[2]')} END END AS wait FROM s")
def sc29(spark, sf):
    e, w = F.col("event_id"), F.col("wait")
    waits = F.array(w, F.when(e % 2 == 0, (w + e % 13).cast("int")), F.when(e % 3 == 0, w + 7))
    return queue_log(spark, sf).select("event_id", L.consensus(waits).alias("wait"))


@query("sc30_status_override", f"WITH {Q} SELECT event_id, CASE WHEN status IN ('CLOSED', 'DOWN') AND max(CASE WHEN status = 'OPERATING' THEN wait END) OVER (PARTITION BY entity_id, CAST(ts AS DATE)) >= 5 THEN 'OPERATING' ELSE status END AS status FROM q")
def sc30(spark, sf):
    other = F.max(F.when(F.col("status") == "OPERATING", F.col("wait"))).over(Window.partitionBy("entity_id", F.to_date("ts")))
    return queue_log(spark, sf).withColumn("other", other).select("event_id", F.when(F.col("status").isin("CLOSED", "DOWN") & (F.col("other") >= 5), "OPERATING").otherwise(F.col("status")).alias("status"))


@query("sc34_deterministic_key", f"WITH {Q} SELECT event_id, md5(concat_ws('|', entity_id, strftime(ts, '%Y-%m-%d %H'))) AS key FROM q")
def sc34(spark, sf):
    return queue_log(spark, sf).select("event_id", F.md5(F.concat_ws("|", "entity_id", F.date_format("ts", "yyyy-MM-dd HH"))).alias("key"))


@query("sc36_keyword_type", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'ring|bolt') THEN 'small' WHEN regexp_matches(lower(p_name), 'gear|widget') THEN 'large' ELSE 'other' END AS kind FROM part")
def sc36(spark, sf):
    n = F.lower("p_name")
    return read(spark, sf, "part").select("p_partkey", F.when(n.rlike("ring|bolt"), "small").when(n.rlike("gear|widget"), "large").otherwise("other").alias("kind"))


@query("prj1_curated_resolution", f"WITH {Q} SELECT event_id, coalesce(CASE WHEN event_id % 4 = 0 THEN wait + 1 END, CASE WHEN event_id % 3 <> 0 THEN wait END, -1) AS fact, CASE WHEN event_id % 4 = 0 THEN 'curated' WHEN event_id % 3 <> 0 THEN 'source' ELSE 'none' END AS origin FROM q")
def prj1(spark, sf):
    curated, source = F.when(F.col("event_id") % 4 == 0, F.col("wait") + 1), F.when(F.col("event_id") % 3 != 0, F.col("wait"))
    return queue_log(spark, sf).select("event_id", L.resolved(curated, source, F.lit(-1)).alias("fact"), F.when(curated.isNotNull(), "curated").when(source.isNotNull(), "source").otherwise("none").alias("origin"))


@query("prj3_park_listing", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 2, 3, 4, 5, 6, 7) AND s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 3")
def prj3(spark, sf):
    return read(spark, sf, "supplier").filter(F.col("s_nationkey").between(1, 7) & (F.col("s_acctbal") > 0)).orderBy(F.desc("s_acctbal"), "s_suppkey").offset(3).limit(5).select("s_suppkey", "s_name")


@query("flt3_out_of_season", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NOT list_contains([1, 2, 12], 1) WHEN s_suppkey % 3 = 1 THEN NOT list_contains([5, 6], 1) ELSE s_acctbal < 0 END AS out FROM supplier")
def flt3(spark, sf):
    k = F.col("s_suppkey") % 3
    months = lambda *m: F.array(*(F.lit(x) for x in m))
    out = L.out_of_season(F.lit(1), F.when(k == 0, months(1, 2, 12)), F.when(k == 1, months(5, 6)), F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01")))
    return read(spark, sf, "supplier").select("s_suppkey", out.alias("out"))


@query("fp18_day_types", f"WITH {Q}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN day(day) < 3 THEN 'school' WHEN day(day) = 15 THEN 'public' WHEN extract(dow FROM day) IN (0, 6) THEN 'weekend' WHEN month(day) IN (6, 7, 8, 12) THEN 'peak_month' ELSE 'regular' END AS kind FROM d")
def fp18(spark, sf):
    d = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), L.day_type(F.dayofmonth("day") < 3, F.dayofmonth("day") == 15, F.dayofweek("day").isin(1, 7), F.month("day")).alias("kind"))


@query("ag61_decayed_popularity", "SELECT user_id, round(sum(pow(0.9, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31'))), 4) AS score FROM events GROUP BY 1 HAVING sum(pow(0.9, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31'))) >= 0.5 ORDER BY score DESC, user_id LIMIT 20")
def ag61(spark, sf):
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    hits = read(spark, sf, "events").groupBy("user_id").agg(F.sum(L.decayed(F.lit(1.0), days)).alias("score")).filter("score >= 0.5")
    return hits.select("user_id", r4(F.col("score")).alias("score")).orderBy(F.desc("score"), "user_id").limit(20)


@query("sc37_location_search", f"WITH t AS (SELECT n_nationkey, n_name, {_TRI.format(t='n_name')} AS x, {_TRI.format(t=chr(39) + 'nation 1' + chr(39))} AS y FROM nation) SELECT n_nationkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 4) AS sim FROM t WHERE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) >= 0.3")
def sc37(spark, sf):
    sim = X.trigram_similarity(F.col("n_name"), F.lit("nation 1"))
    return read(spark, sf, "nation").filter(sim >= 0.3).select("n_nationkey", r4(sim).alias("sim"))


def best_slots(hours: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Greedy choice of quiet hours: those near the least level, quietest first, at least an hour apart; a group is one day of 24 hours."""

    def pick(rows):
        rows = rows.sort_values(["level", "hour"])
        bound, out = max(rows["level"].iloc[0] * 1.25, rows["level"].iloc[0] + 5), []
        for i, h, x in zip(rows.index, rows["hour"], rows["level"]):
            if x <= bound and len(out) < most and all(abs(h - rows.loc[j, "hour"]) > 1 for j in out):
                out.append(i)
        return rows.loc[out, [key, "hour", "level"]]

    return hours.groupBy(key).applyInPandas(pick, f"{key} long, hour int, level double")


@query("so4_best_visit_times")
def so4(spark, sf):
    h = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.hour("lts").alias("hour")).agg(r4(F.avg("wait")).alias("level"))
    return best_slots(h.select("park_id", "hour", "level"), "park_id")


@query("so2_top_per_day", f"WITH {Q}, d AS (SELECT park_id, strftime(lts, '%Y-%m-%d') AS day, entity_id, max(wait) AS w FROM op GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY park_id, day ORDER BY w DESC, entity_id) AS k FROM d) SELECT park_id, day, round(avg(w), 4) AS mean, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS top FROM k GROUP BY 1, 2")
def so2(spark, sf):
    d = standby_operating(queue_log(spark, sf)).groupBy("park_id", F.date_format("lts", "yyyy-MM-dd").alias("day"), "entity_id").agg(F.max("wait").alias("w"))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy("park_id", "day").orderBy(F.desc("w"), "entity_id")))
    listed = F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "entity_id"))))
    return k.groupBy("park_id", "day").agg(r4(F.avg("w")).alias("mean"), F.array_join(F.transform(listed, lambda s: s["entity_id"].cast("string")), ",").alias("top"))


@query("se1_union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def se1(spark, sf):
    a, b = read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).distinct()


@query("se2_union_all", f"WITH {Q} SELECT entity_id, count(*) AS n FROM (SELECT entity_id FROM op WHERE wait > 100 UNION ALL SELECT entity_id FROM op WHERE wait % 2 = 0) GROUP BY 1")
def se2(spark, sf):
    rows = standby_operating(queue_log(spark, sf))
    return rows.filter("wait > 100").unionByName(rows.filter("wait % 2 = 0")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def first_choice(rows: DataFrame) -> DataFrame:
    return first_per(rows, ["entity_id"], "source", "event_id")


@query("fp25_serving_merge", f"WITH {Q}, s AS (SELECT entity_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS source, event_id, value FROM q WHERE event_type IN ('view', 'click')) SELECT entity_id, day, source, value FROM s QUALIFY row_number() OVER (PARTITION BY entity_id, day ORDER BY source, event_id) = 1")
def fp25(spark, sf):
    s = queue_log(spark, sf).filter(F.col("event_type").isin("view", "click")).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "source": F.when(F.col("event_type") == "view", 0).otherwise(1)})
    return first_per(s, ["entity_id", "day"], "source", "event_id").select("entity_id", "day", "source", "value")
