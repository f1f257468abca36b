"""Packing: first-fit decreasing over a tournament tree of bin capacities, run independently in randomised groups of documents.

Documents are dealt to partitions by a hash of id and text, so a hot source and null ids are spread; a partition is read in that hash's order,
tokenised in slices and packed in groups, each closed once it has GROUP_TOKENS tokens (a document longer than that closes its group). In a group,
a document gives its whole-length pieces of max_tokens, which are sequences already, and a rest; rests go, longest first, into the first
sequence with room. The tree holds the largest free room of each half, so a piece finds its sequence in log n steps. Then the emptiest
sequences are taken apart and their pieces cut to fill the gaps of the others, so a group ends with at most one sequence that is not full.

Only one group's ids are held at a time. Sequence ids are partition and running number: a task that runs again gives the same ids, as rows
are sorted within partitions by hash, id and length, and rows alike in all of them are the same.

Defined results: a null text is empty and has the end id alone; null ids are packed like others; repeated rows are packed as often as they
come; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .workers import trimmed

MAX_TOKENS = 2048
END_ID = 1
GROUP_TOKENS = 2_000_000
#: Fixed values of byte-level vocabularies: where a text may be cut, and the letters that stand for bytes.
BORDERS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Rows for each partition that the deal aims at.
ROWS_A_PARTITION = 8_000
#: Texts that are Python strings at once.
SLICE = 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WITH_IDS = SCHEMA + ", ids array<int>"


class Encoder:
    """Texts -> arrays of ids, end id included, equal to those of tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).

    The vocabulary is run by tiktoken, which takes a fifth of the time; a text that holds a special token's string goes to tokenizers itself.
    The file's ids must be the ranks of its merges, as in byte-level vocabularies of this kind; this is checked on PROBE.
    """

    PROBE = "Don't  stop:\n\n it's 12,345.6 \u00e9\u00fc\u00df \u4e2d\u6587 \U0001d11e\t end "

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(BYTES.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=BORDERS, mergeable_ranks=ranks, special_tokens={})
        if self.fast.encode_ordinary(self.PROBE) != self.tokenizer.encode(self.PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} isn't a byte-level vocabulary whose ids are the ranks of its merges")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if any(x in t for x in self.special):
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
            else:
                ids = self.fast.encode_to_numpy(t, disallowed_special=())
            out.append(np.append(ids.astype("<u4", copy=False), np.uint32(END_ID)))
        return out


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One a worker, whatever the number of its tasks."""
    return Encoder(path)


class Tree:
    """A tournament tree over the free room of n bins: the first bin with room, in log n steps."""

    def __init__(self, n: int, room: int):
        self.n = 1 << max(0, (n - 1).bit_length())
        self.top = [room] * (2 * self.n)

    def first(self, need: int) -> int:
        top, i = self.top, 1
        if top[1] < need:
            return -1
        while i < self.n:
            i *= 2
            if top[i] < need:
                i += 1
        return i - self.n

    def take(self, at: int, need: int) -> None:
        top, i = self.top, at + self.n
        top[i] -= need
        while i > 1:
            i //= 2
            new = max(top[2 * i], top[2 * i + 1])
            if top[i] == new:
                break
            top[i] = new


def first_fit_decreasing(lengths: list[int], room: int) -> list[int]:
    """The bin of each length (all of 1..room)."""
    tree, out = Tree(len(lengths) or 1, room), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = at = tree.first(lengths[i])
        tree.take(at, lengths[i])
    return out


def pack(lengths: list[int], room: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; every sequence but one is full."""
    out, n = [], 0
    rests: list[tuple[int, int, int]] = []
    for d, length in enumerate(lengths):
        whole = length - length % room
        for start in range(0, whole, room):
            out.append((d, start, room, n, 0))
            n += 1
        if length > whole:
            rests.append((d, whole, length - whole))
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for rest, at in zip(rests, first_fit_decreasing([r[2] for r in rests], room), strict=True):
        bins.setdefault(at, []).append(rest)
    fill = lambda b: sum(x[2] for x in b)
    rows = sorted(bins.values(), key=fill)
    gaps = [room - fill(b) for b in rows]
    # whole sequences go as long as the others can take their tokens, then part of one
    low, high = 0, len(rows) - 1
    while low < high:
        while rows[low] and low < high:
            d, start, length = rows[low].pop()
            while length and low < high:
                if not gaps[high]:
                    high -= 1
                    continue
                part = min(length, gaps[high])
                rows[high].append((d, start, part))
                gaps[high] -= part
                start, length = start + part, length - part
            if length:
                rows[low].append((d, start, length))
                break
        if not rows[low]:
            low += 1
    for b in rows:
        offset = 0
        for d, start, length in b:
            out.append((d, start, length, n, offset))
            offset += length
        n += bool(b)
    return out


def _emit(ids: list, docs: list[np.ndarray], first: int, keep_ids: bool) -> tuple[pa.RecordBatch, int]:
    pieces = pack([len(d) for d in docs])
    cut = [docs[d][s : s + n] for d, s, n, _, _ in pieces]
    cols = [
        pa.array([ids[p[0]] for p in pieces], pa.int64()),
        pa.array([p[1] for p in pieces], pa.int64()),
        pa.array([p[2] for p in pieces], pa.int64()),
        pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
        pa.array([len(docs[p[0]]) for p in pieces], pa.int64()),
        pa.array([first + p[3] for p in pieces], pa.int64()),
        pa.array([p[4] for p in pieces], pa.int64()),
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        cols.append(pa.array([c.astype("i4") for c in cut], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names), first + 1 + max((p[3] for p in pieces), default=-1)


def packer(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, nxt = encoder_of(path), TaskContext.get().partitionId() << 33
        ids, docs, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = encoder.encode([t or "" for t in batch.column(1).slice(at, SLICE).to_pylist()])
                ids += batch.column(0).slice(at, SLICE).to_pylist()
                docs += part
                held += sum(map(len, part))
                if held >= GROUP_TOKENS:
                    out, nxt = _emit(ids, docs, nxt, keep_ids)
                    yield out
                    ids, docs, held = [], [], 0
        if ids:
            yield _emit(ids, docs, nxt, keep_ids)[0]

    return trimmed(run)


def packed(docs: DataFrame, tokenizer: str, keep_ids: bool = False, partitions: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> pieces. keep_ids adds the ids of each piece."""
    spark = docs.sparkSession
    if partitions is None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_PARTITION + 1)
    deal = docs.select("doc_id", "text", F.xxhash64(F.lit("deal"), "doc_id", "text").alias("by"))
    rows = deal.repartition(partitions, "by").sortWithinPartitions("by", "doc_id", F.length("text")).select("doc_id", "text")
    return rows.mapInArrow(packer(tokenizer, keep_ids), WITH_IDS if keep_ids else SCHEMA)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
