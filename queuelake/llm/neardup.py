"""Near-duplicates: universal-hash minima, banding, signature verification, confirmation on full sets, components by large-star and small-star.

1. A text's distinct word shingles are hashed to 64 bits; the set's own hash (``node``) stands for all documents with this very set, so copies
   are one node however many there are. HASHES universal hashes a*x+b over a set give its minima; BANDS bands of BAND_ROWS minima are hashed, and
   a bit of each minimum is its signature. At the least similarity, 0.75, two sets share no band with a probability of 1e-4; at 0.8 of 1e-6.
2. Buckets (nodes that share a band) are found by min and max, in a hash aggregation with partial sums: one value a bucket, no lists. The order in
   which least and greatest are taken differs from bucket to bucket, so leaders do. Members of a bucket are paired with its least and greatest
   member; buckets of up to SMALL members, with all. That is linear in bucket rows. What larger buckets may lack by that is in step 5.
3. Pairs whose signatures agree too seldom are dropped: the bound is 4.5 deviations below what 0.75 gives.
4. Pairs are confirmed on the full sets, read again in one pass over the texts of the nodes concerned. Only pairs between different components of what
   is confirmed already are, the likeliest of each node first, then all that are left.
5. Larger buckets that still hold several components are completed exactly, without comparing all their members (``_rest``). Let P be the shingles
   that more than WIDELY components hold, c how many of those a set x has, and g how many of the others x shares with a set y of another
   component. They share min(c_x, c_y) + g shingles at most, and a link needs 3/7 of both sizes together. First every member meets the members of
   its bucket with the largest share of P, the middles of the group. Then a pair is a candidate only if its sizes and c allow a link
   without any g (found by bucket and class of size: members that differ from the middle by more than a quarter have no such partner unless it
   is shorter), or if g makes up for it (found by the shingles that at most WIDELY components hold: at most WIDELY rows for each, first against
   whole components, then against the members of those that remain). So every pair that shares a bucket is either confirmed, refuted, ruled
   out by a bound, or inside one component. What may still grow with a product of sizes: two large components with middles of their own that
   are close to 0.75 to each other and don't link.

Nothing but counts reaches the driver. Joins are between written tables or scans, so AQE splits hot keys.

Defined results: a null or wordless text has an empty set: no links, its own component; a text with fewer words than SHINGLE has its whole sequence
as one shingle; rows with a null id are linked with nothing, have a null component and are kept; rows of a repeated id are each judged by
their own text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, written
from .components import components
from .workers import trimmed

SHINGLE, LEAST = 5, 75
BANDS, BAND_ROWS = 64, 7
HASHES = BANDS * BAND_ROWS
SMALL = 16
#: A shingle that more components than this hold is one of the group's own.
WIDELY = 32
#: Members of a bucket that the others meet before all that may link: the best of so many parts of it.
MIDDLES = 8
#: Classes of sizes: the size grows by a 1 / CLASSES power of e from one to the next.
CLASSES = 32
#: Minima whose bits agree: a pair of similarity s agrees in (1 + s) / 2 of them, with binomial noise.
LEAST_BITS = int(HASHES * (1 + LEAST / 100) / 2 - 4.5 * (HASHES * (1 + LEAST / 100) / 2 * (1 - LEAST / 100) / 2) ** 0.5)
_RND = np.random.default_rng(20240131)
_A = _RND.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RND.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32)
_PLACE = _RND.integers(0, 2**63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RND.integers(0, 2**63, (BANDS, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their shingles, all words of a text at once.

    A word's hash is its part of a polynomial over the text's bytes, shifted back to the word's start: BASE is odd, so it has an inverse.
    """

    def __init__(self):
        self.up = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("back", _BACK)):
                    row = np.full(n, base, np.uint64)
                    row[0] = 1
                    setattr(self, name, np.multiply.accumulate(row))

    def words(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode().lower(), np.uint8)  # of bytes, lower() is of A-Z alone
        if not len(data):
            return np.zeros(0, np.uint64)
        self._powers(len(data) + 1)
        edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return _mix((total[end] - total[start]) * self.back[start])

    def __call__(self, text: str | None) -> np.ndarray:
        h = self.words(text or "")
        if not len(h):
            return h
        n, k = max(1, len(h) - SHINGLE + 1), min(len(h), SHINGLE)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += h[j : j + n] * _PLACE[j]
        return np.unique(_mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(HASHES, np.uint32)
    step = max(1, 65536 // len(x))
    for at in range(0, HASHES, step):
        out[at : at + step] = (_A[at : at + step, None] * x[None, :] + _B[at : at + step, None]).min(axis=1)
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


SIGNED = "doc_id long, copy long, n_shingles long, node long, bits array<long>, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    names = ["doc_id", "copy", "n_shingles", "node", "bits", "bands"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n, nodes, bits, bands = [], [], [], []
            for t in part.column(2):
                s = shingler(t.as_py())
                n.append(len(s))
                if not len(s):
                    nodes.append(None), bits.append(None), bands.append(None)
                    continue
                m = minima(s)
                nodes.append(node_of(s))
                bits.append(np.packbits((m >> np.uint32(7)).astype(np.uint8) & 1).view(np.int64))
                bands.append(_mix((m.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [s for t in batch.column(0).slice(at, 256) if len(s := shingler(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _agree(a: str, b: str) -> Column:
    """The bits in which two signatures agree."""
    differ = [F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i))) for i in range(1, HASHES // 64 + 1)]
    return HASHES - sum(differ[1:], differ[0])


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose signatures agree often enough, with the number of bits that do."""
    bits = nodes.select("node", "bits")
    both = pairs.join(bits.select(F.col("node").alias("u"), F.col("bits").alias("ub")), "u").join(bits.select(F.col("node").alias("v"), F.col("bits").alias("vb")), "v")
    return both.withColumn("agree", _agree("ub", "vb")).filter(F.col("agree") >= LEAST_BITS).select("u", "v", "agree")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs between different components."""
    at = lambda k: comps.select(F.col("node").alias(k), F.col("component").alias(f"{k}c"))
    rows = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left")
    return rows.filter(F.coalesce("uc", "u") != F.coalesce("vc", "v")).select("u", "v", "agree")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) that reach LEAST on the full sets."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}s"))
    rows = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    both, total = F.size(F.array_intersect("us", "vs")), F.size("us") + F.size("vs")
    return rows.filter(100 * both >= LEAST * (total - both)).select("u", "v")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of each node, the pair that agrees most and the one with the least partner."""
    ends = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "agree"))
    best = ends.groupBy("u").agg(F.max_by("v", "agree").alias("a"), F.min("v").alias("b"))
    return _unordered(best.select("u", F.explode(F.array("a", "b")).alias("v")))


def _resolve(pairs: DataFrame, sets: DataFrame, links: DataFrame | None, comps: DataFrame | None, rounds: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Confirm pairs, a written table, until each lies inside a component or is refuted. links: star edges of the components so far."""
    left = pairs
    for k in range(rounds + 1):
        if comps is not None:
            left = materialize(_across(left, comps), "left")
        if left.isEmpty():
            break
        now = materialize(_likeliest(left), "now") if k < rounds else left.select("u", "v")
        new = materialize(_confirmed(now, sets), "links")
        if k < rounds:
            left = left.join(now, ["u", "v"], "left_anti")
        links = new if links is None else links.unionByName(new)
        comps = components(links)
        links = comps.filter("node != component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return links, comps


def near_components(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    return _components(docs, rounds).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, copy (hash of the text), n_shingles, node, component (a node of it), component_id (its least id)."""
    with written() as w:
        signed, ids = _placed(docs, rounds)
        w.keep(signed, ids)
    out = signed.select("doc_id", "copy", "n_shingles", "node").join(ids.select("node", "component", "component_id"), "node", "left")
    return out.select("doc_id", "copy", "n_shingles", "node", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _placed(docs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: a row for each document, with its node; and of each node the component and its least id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    signed = materialize(texts.mapInArrow(trimmed(_sign), SIGNED), "signed")
    known = signed.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    reps = materialize(known.groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")

    bands = known.select("node", F.explode("bands").alias("band"))
    turned = F.col("node").bitwiseXOR(F.xxhash64("band"))  # another order in each bucket
    spread = bands.groupBy("band").agg(F.min(turned).alias("low"), F.max(turned).alias("high")).filter("low < high")
    buckets = materialize(spread.select("band", F.col("low").bitwiseXOR(F.xxhash64("band")).alias("low"), F.col("high").bitwiseXOR(F.xxhash64("band")).alias("high")), "buckets")
    members = materialize(bands.join(buckets, "band").select("band", "node", "low", "high").distinct(), "members")
    sizes = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 3"), "sizes")
    few, many = sizes.filter(F.col("n") <= SMALL).select("band"), sizes.filter(F.col("n") > SMALL).select("band")
    inside = members.join(few, "band").select("band", "node")
    pairs = _unordered(
        members.select(F.col("node").alias("u"), F.explode(F.array("low", "high")).alias("v"))
        .unionByName(inside.select("band", F.col("node").alias("u")).join(inside.select("band", F.col("node").alias("v")), "band").filter("u > v").select("u", "v"))
    )
    concerned = materialize(members.select("node").distinct().join(reps, "node"), "concerned")
    nodes = materialize(known.join(concerned.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"]).select("node", "bits").dropDuplicates(["node"]), "nodes")
    tested = materialize(_alike(pairs, nodes), "alike")

    # the sets that are needed, in one pass over the texts: of pairs to confirm, and of all in larger buckets
    wide = materialize(members.join(many, "band", "left_semi").select("band", "node"), "wide")
    ends = tested.select(F.col("u").alias("node")).unionByName(tested.select(F.col("v").alias("node"))).unionByName(wide.select("node")).distinct()
    read = materialize(concerned.join(ends, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "read")
    held = texts.join(read, "doc_id", "left_semi").select("text").mapInArrow(trimmed(_sets), "node long, shingles array<long>")
    sets = materialize(held.join(ends, "node", "left_semi").dropDuplicates(["node"]), "sets")

    links, comps = _resolve(tested, sets, None, None, rounds)
    comps = _completed(wide, links, comps, nodes, sets)

    if comps is None:
        ids = reps.select("node", F.col("node").alias("component"), F.col("rep").alias("component_id"))
    else:
        placed = reps.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
        least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
        ids = placed.join(least, "component").select("node", "component", "component_id")
    return signed, materialize(ids, "ids")


def _mixed(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows (band, node) of the buckets that hold several components, with component and main, the bucket's largest one."""
    if comps is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(comps, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    rows = materialize(rows, "rows")
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return materialize(rows.join(main, "band"), "mixed")


def _completed(rows: DataFrame, links: DataFrame | None, comps: DataFrame | None, nodes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """comps after all links inside the buckets rows (band, node) are found; links: star edges of comps."""
    mixed = _mixed(rows, comps)
    if mixed.isEmpty():
        return comps
    placed = mixed.select("node", "component").distinct().join(sets, "node")
    held = placed.select("node", "component", F.explode("shingles").alias("shingle"))
    wide = held.select("shingle", "component").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    shared = materialize(held.join(wide, "shingle").select("node", "shingle", (F.col("holders") > WIDELY).alias("wide")), "shared")
    common = shared.filter("wide").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    size = F.size("shingles").cast("long")
    c = F.coalesce("c", F.lit(0).cast("long"))
    # with nothing else in common, a partner has at most so many shingles
    shapes = materialize(placed.select("node", size.alias("size")).join(common, "node", "left").select("node", "size", c.alias("c"), F.floor((7 * c - 3 * F.col("size")) / 3).alias("most")), "shapes")

    # who may link with the middles of a bucket by size meets them
    shaped = mixed.join(shapes, "node")
    part = F.pmod(F.xxhash64("node"), F.lit(MIDDLES)).alias("part")
    one = F.struct(*(F.col(x).alias(y) for x, y in zip(("node", "component", "size", "most"), ("v", "vc", "vs", "vm"), strict=True)))
    middles = materialize(shaped.groupBy("band", part).agg(F.max_by(one, F.struct(F.col("c") / F.col("size"), "c", "node")).alias("m")).select("band", "m.*"), "middles")
    fits = (F.col("vs") <= F.col("most")) & (F.col("size") <= F.col("vm"))
    meet = shaped.filter("4 * most >= 3 * size").join(middles, "band").filter(fits & (F.col("component") != F.col("vc"))).select(F.col("node").alias("u"), "v")
    tested = materialize(_alike(_unordered(meet), nodes), "alike")
    if not tested.isEmpty():
        links, comps = _resolve(tested, sets, links, comps, 0)

    mixed = _mixed(mixed.select("band", "node"), comps)
    if mixed.isEmpty():
        return comps
    pairs = _by_size(mixed, shapes, nodes).unionByName(_alike(_by_shingles(mixed, shapes, shared.filter("not wide")), nodes))
    pairs = materialize(pairs.distinct().join(tested.select("u", "v"), ["u", "v"], "left_anti"), "alike")
    return comps if pairs.isEmpty() else _resolve(pairs, sets, links, comps, 0)[1]


def _by_size(mixed: DataFrame, shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v, agree) of a bucket in different components that may link by their widely held shingles alone, and whose signatures agree."""
    rows = mixed.join(shapes, "node").join(nodes, "node")
    least = rows.groupBy("band").agg(F.min("size").alias("least"))
    of = lambda size: F.floor(F.log(size) * CLASSES)
    outside = rows.filter("component != main").join(least, "band").filter("most >= least and 4 * most >= 3 * size")
    reach = F.sequence(of(F.col("size") * 0.75), of(F.least(F.col("most"), F.col("size") * 4 / 3)))  # a partner has 3/4 to 4/3 of the size
    x = outside.select("band", F.explode(reach).alias("class"), F.col("node").alias("u"), F.col("component").alias("uc"), F.col("size").alias("us"), F.col("most").alias("um"), F.col("bits").alias("ub"))
    y = rows.select("band", of(F.col("size")).alias("class"), F.col("node").alias("v"), F.col("component").alias("vc"), F.col("size").alias("vs"), F.col("most").alias("vm"), F.col("bits").alias("vb"), "main")
    fits = (F.col("vs") <= F.col("um")) & (F.col("us") <= F.col("vm"))
    out = x.join(y, ["band", "class"]).filter(fits & (F.col("uc") != F.col("vc")) & (_agree("ub", "vb") >= LEAST_BITS))
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), _agree("ub", "vb").alias("agree"))


def _by_shingles(mixed: DataFrame, shapes: DataFrame, scarce: DataFrame) -> DataFrame:
    """Pairs (u, v) in different components that share scarce (node, shingle) enough for a link.

    A member of the smaller component looks the larger one up: which of its scarce shingles any member holds, then which members hold how many.
    """
    placed = materialize(mixed.select("node", "component").distinct().join(shapes, "node"), "placed")
    summary = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("most_c"), F.min("size").alias("least"))
    placed = materialize(placed.join(summary, "component"), "placed")
    held = materialize(scarce.join(placed, "node").select("node", "shingle", "component", "n", "c", "size", "most_c", "least"), "held")
    larger = held.select("shingle", F.col("component").alias("k"), F.col("n").alias("kn"), "most_c", "least").distinct()
    own = held.select("shingle", F.col("node").alias("u"), "component", "n", F.col("c").alias("uc"), F.col("size").alias("us"))
    first = own.join(larger, "shingle").filter(F.struct("n", "component") < F.struct("kn", "k"))
    counts = first.groupBy("u", "k").agg(F.count(F.lit(1)).alias("g"), *(F.first(x).alias(x) for x in ("uc", "us", "most_c", "least")))
    near = materialize(counts.filter(7 * (F.least("uc", "most_c") + F.col("g")) >= 3 * (F.col("us") + F.col("least"))).select("u", "k"), "near")
    looks = own.select("u", "shingle", "uc", "us").join(near, "u")
    each = held.select("shingle", F.col("component").alias("k"), F.col("node").alias("v"), F.col("c").alias("vc"), F.col("size").alias("vs"))
    both = looks.join(each, ["shingle", "k"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("g"), *(F.first(x).alias(x) for x in ("uc", "us", "vc", "vs")))
    return _unordered(both.filter(7 * (F.least("uc", "vc") + F.col("g")) >= 3 * (F.col("us") + F.col("vs"))).select("u", "v"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept(docs: DataFrame) -> DataFrame:
    """Of each component one row of docs, all columns: of its least id and, if that has several texts in it, of the one of the least hash.

    Rows with a null id and rows without words stay. Of rows repeated with id and text, one stays; which, where other columns differ, is open.
    """
    linked = F.col("doc_id").isNotNull() & F.col("node").isNotNull()
    with written() as w:
        rows = materialize(_components(docs).filter(linked).groupBy("doc_id", "copy", "component").agg(F.count(F.lit(1)).alias("n")), "copies")
        first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "copy")).alias("first"))
        stays = rows.join(first, "component").withColumn("stays", F.struct("doc_id", "copy") == F.col("first"))
        stays = materialize(stays.filter("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "stays"), "stays")
        w.keep(stays)
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_copy"))
    once = docs.join(stays, same, "left_anti").select(docs.columns)
    again = stays.filter("stays")  # of rows that are repeated
    if again.isEmpty():  # so the texts are shuffled once
        return once
    return once.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
