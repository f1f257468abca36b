"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Every anchor (a common word of a fixed list) gives one signature: the anchor and the next CHAIN content words, that is words that are no
anchors. The fingerprint of a text is the set of its signatures' hashes. Two fingerprints are compared by the Jaccard similarity of their sets:
sets are partitioned by length, so that a pair whose lengths alone rule out the wanted similarity isn't compared at all, and the
comparison of the others walks the sorted sets and stops when the rest can't reach it.

The query needs each document's neighbour in the order of ids. Rows are dealt to chunks by ranges of ids, with bounds taken from a sample;
a chunk's first row goes to the chunk before it as well, so that chunks are read one by one and a text crosses the network once. Only counts and
bounds reach the driver: at most MOST_CHUNKS numbers.

Defined results: a null text is empty; an empty text has an empty fingerprint, and two empty ones are alike (1.0); a text
without anchors has the chains of all its words, one without words the text itself as its signature; a null id comes last; equal ids are ordered by their text; repeated rows follow each other; extra columns are ignored; an empty table gives an empty
result; the neighbour of a single row is itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .workers import trimmed

CHAIN = 2
#: Common words of the languages at hand.
ANCHORS = frozenset(
    "a an and are as at be by for from has he in is it its not of on or that the this to was were which with you "
    "al como con de del el en es la las lo los no para por que se su un una y "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine er ie im in ist mit nicht sich sie und von zu".split()
)
WORD = re.compile(r"\w+")
ROWS_A_CHUNK, MOST_CHUNKS = 4_000, 10_000


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the signatures of a text. A chain at the end of a text may be shorter, but not empty."""
    words = WORD.findall(text.lower())
    anchors = ANCHORS
    content = [w for w in words if w not in anchors]
    spots, k = set(), 0
    n = len(content)
    for w in words:
        if w in anchors:
            if k < n:
                spots.add((w, *content[k : k + CHAIN]))
        else:
            k += 1
    if not spots:  # no anchor has a chain: then chains of any words, or the text itself
        spots = {tuple(words[i : i + CHAIN]) for i in range(max(1, len(words) - CHAIN + 1))} if words else {(text,)} if text else set()
    return np.unique(np.fromiter((int.from_bytes(hashlib.blake2b(" ".join(s).encode(), digest_size=4).digest(), "little") for s in spots), np.uint32, len(spots)))


def encoded(sigs: np.ndarray) -> str:
    """Eight hex digits for each signature, in order."""
    return sigs.astype(">u4").tobytes().hex()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted sets; 0 at once if their lengths rule out least. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def length_partitions(least: float, longest: int = 1 << 24) -> list[int]:
    """Lower bounds of the lengths of partitions: a set and a partner of at least this similarity are in the same or in neighbouring partitions."""
    bounds, at = [0, 1], 1
    while at < longest:
        at = max(at + 1, int(np.ceil(at / least)))
        bounds.append(at)
    return bounds


def near_pairs(sets: dict, least: float) -> list[tuple]:
    """All pairs of ids whose sets have this similarity (0 < least): for a partition's worth of sets, by lengths and then an index of signatures.

    A set is looked up by its rarest signatures only: n - ceil(least * n) + 1 of them, one of which any partner must hold.
    """
    counts: dict[int, int] = {}
    for s in sets.values():
        for x in s.tolist():
            counts[x] = counts.get(x, 0) + 1
    bounds = length_partitions(least)
    index: dict[tuple[int, int], list] = {}
    out = []
    empty = [i for i, s in sets.items() if not len(s)]
    out += [(a, b) for k, a in enumerate(empty) for b in empty[k + 1 :]]
    for i in sorted((i for i, s in sets.items() if len(s)), key=lambda i: (len(sets[i]), str(i))):
        s = sets[i]
        part = int(np.searchsorted(bounds, len(s), side="right")) - 1
        rare = sorted(s.tolist(), key=lambda x: (counts[x], x))[: len(s) - int(np.ceil(least * len(s))) + 1]
        seen = {j for p in (part - 1, part) for x in rare for j in index.get((p, x), ())}
        out += [(j, i) for j in seen if len(sets[j]) >= least * len(s) and jaccard(sets[j], s, least) >= least]
        for x in rare:
            index.setdefault((part, x), []).append(i)
    return out


def edited(text: str, follower: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def _neighbours(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(chunk, own, id, text) in order -> (id, text, text that follows)."""
    held = None
    for chunk, own, doc_id, text in rows:
        if held is not None and held[0] == chunk:
            yield held[1], held[2], text
            held = None
        if own:
            held = (chunk, doc_id, text)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, last = [], (None, None)
    for doc_id, text, follower in _neighbours(rows):
        own = last[1] if last[0] is text else signatures(text)
        nxt = signatures(follower)
        last = (follower, nxt)
        new = edited(text, follower)
        changed = signatures(new)
        held.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), encoded(own), encoded(changed), jaccard(own, changed), jaccard(own, nxt)))
        if len(held) >= 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    chunks = min(n // ROWS_A_CHUNK + 1, MOST_CHUNKS)
    cuts = ids.approxQuantile("doc_id", [k / chunks for k in range(1, chunks)], 0.25 / chunks) if chunks > 1 else []
    bounds = np.unique(np.array(cuts, "i8"))  # chunk: bounds that are below or at the id, counted from the top; null ids are in the last

    @F.pandas_udf("int")
    def chunk_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        at = np.searchsorted(bounds, doc_id.where(known, 0).astype("i8").to_numpy(), side="right")
        return pd.Series(np.where(known, len(bounds) - at, len(bounds)).astype("i4"))

    firsts = ids.groupBy(chunk_of("doc_id").alias("chunk")).agg(F.max("doc_id").alias("first")).collect()  # at most MOST_CHUNKS rows
    firsts = sorted(map(tuple, firsts))
    # the first row of a chunk follows the last of the chunk before it; the first of all follows the last of all
    follows = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    extra = spark.createDataFrame(follows, "first long, before int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = rows.select(chunk_of("doc_id").alias("chunk"), F.lit(True).alias("own"), "doc_id", "text")
    heads = rows.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("before").alias("chunk"), F.lit(False).alias("own"), "doc_id", "text")
    # of rows that share a first id, the first by text follows: the others come behind it and are passed over
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(firsts) // 2 + 1)
    dealt = own.unionByName(heads).repartition(partitions, "chunk").sortWithinPartitions("chunk", F.desc("own"), F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(trimmed(_judge), SCHEMA)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
