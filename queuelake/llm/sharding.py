"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly; each group goes where the dot product with the room left is highest.

Rows of equal text are a group. Groups are dealt by their hash into a fixed number of buckets, and a bucket is placed as one item, so the driver
places at most BUCKETS + 3 * (PART + SHARDS) items whatever the corpus holds: a few thousand vectors of three numbers. Items are placed largest first; the
last ones are small, so shards come out nearly equal. A group stays whole unless it alone has more than a shard's fair part of the bytes,
tokens or rows, which no law about equal sizes allows: then it is split
into as many parts as that needs, and each part is an item: copies of one text may be a third of the corpus and go to several shards.

The text is read once: what is needed of a row (five numbers) is written to the shared folder. Groups are counted with partial sums on the map
side, so a hot text is one row per task in the shuffle. Slots are running numbers inside a shard: rows are ranked in chunks of bounded size, by
a hash of the row, and a chunk starts where the counts of those before it end.

Law: ``bytes`` (sizes near equal).

Defined results: a null text has size 1 and is in the group of null texts; null ids are rows like others; repeated rows each get a slot of
their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

SHARDS, BUCKETS = 8, 16384
#: A group that is split has parts of about 1 / PART of the bytes, tokens or rows.
PART = 1024
#: Of bytes, tokens and rows in the dot product: the law is about bytes.
WEIGHTS = np.array([4.0, 1.0, 1.0])
CHUNK_ROWS = 4_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows: items, columns: dimensions). Largest first; to the shard whose room left has the highest dot product with the item.

    Room is measured in shares of a shard's fair part, and may fall below 0: nothing is left out.
    """
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1) * shards
    room = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.sum(axis=1), kind="stable"):
        out[i] = at = int(np.argmax(room @ (share[i] * WEIGHTS)))
        room[at] -= share[i]
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1  # words between spaces: the balance needs no more
    rows = materialize(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.cast("long").alias("tokens"),
            F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", F.lit("part")).alias("row_hash"),
        ),
        "rows",
    )
    groups = materialize(rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    if not total.rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*(F.col(c) / F.lit(float(total[c])) for c in ("bytes", "tokens", "rows")))
    own_hash = F.pmod(F.xxhash64("text_hash"), F.lit(buckets)).cast("int")
    weighed = groups.withColumns({"bucket": own_hash, "parts": F.when((share * shards > 1) & (F.col("rows") > 1), F.least(F.ceil(share * PART), F.col("rows"))).otherwise(1).cast("int")})
    heavy = weighed.filter("parts > 1").select("text_hash", "parts")  # at most 3 * shards rows: their shares add up to 3 at most
    light = weighed.filter("parts = 1").groupBy("bucket").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).collect()
    part = F.pmod("row_hash", "parts").cast("int").alias("part")
    split = rows.join(F.broadcast(heavy), "text_hash").groupBy("text_hash", part).agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).collect()
    light.sort(key=lambda r: r[0])
    split.sort(key=lambda r: (r[0], r[1]))
    to = [int(x) for x in place(np.array([r[1:] for r in light] + [r[2:] for r in split], float), shards)]
    shard_of = spark.createDataFrame([(r[0], k) for r, k in zip(light, to, strict=False)], "bucket int, shard int")
    hot_of = spark.createDataFrame([(r[0], r[1], k) for r, k in zip(split, to[len(light) :], strict=True)], "text_hash long, part int, hot_shard int")
    dealt = (
        rows.withColumn("bucket", own_hash)
        .join(F.broadcast(shard_of), "bucket", "left")  # at most BUCKETS rows
        .join(F.broadcast(heavy), "text_hash", "left")
        .withColumn("part", part)
        .join(F.broadcast(hot_of), ["text_hash", "part"], "left")  # at most 3 * (PART + shards) rows
        .withColumn("shard", F.coalesce("hot_shard", "shard"))
    )
    chunks = int(total.rows) // CHUNK_ROWS + 1
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row_hash", "text_hash"), F.lit(chunks)).alias("chunk"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = materialize(counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "starts")  # shards * rows / CHUNK_ROWS rows
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
