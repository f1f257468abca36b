"""Benchmark decontamination: pigeonhole edit matching, verified by Myers' bit-parallel distance.

Texts and test items become lower-case words between single spaces. An item of m characters may lie in a document with k = floor(ERROR_RATE * m)
edits. It is split into k + 1 pieces: with k edits at most, one piece at least is untouched, so every match holds an exact piece hit. All
pieces of a block of items are searched at once by an Aho-Corasick automaton; the places around the hits, overlapping ones merged, are verified
by Myers' algorithm, in which a column of the edit matrix is one integer. A document's cost is its own length, plus the merged places.

The items are the stated query set: they are read in blocks of at most BLOCK_CHARS characters, each of which passes over all documents; a block
goes to the workers in the function's closure. No shuffle: documents are judged where they are, and only their ids leave.

Defined results: a null text is empty and holds nothing; null or empty items are none; equal items are each reported; repeated rows are judged
alike; ties in distance go to the first place; extra columns are ignored (``kept`` keeps them); an empty table on either side gives no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .workers import trimmed

ERROR_RATE = 0.08
BLOCK_CHARS = 1_000_000
WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, distance int, most int, text_end long"


def normal(text: str | None) -> str:
    words = WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def budget(item: str) -> int:
    return int(len(item) * ERROR_RATE)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 of them, of nearly equal lengths."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance between the pattern and any part of text, and the first end of such a part."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
    return best, end


class Block:
    """The items of a block and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, n, budget(n)) for i, t in items if (n := normal(t))]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item, _) in enumerate(self.items):
            for offset, piece in pieces(item):
                where.setdefault(piece, []).append((k, offset))
        for piece, at in where.items():
            self.auto.add_word(piece, (len(piece), at))
        self.auto.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            out: dict[str, int] = {}
            for i, c in enumerate(self.items[k][1]):
                out[c] = out.get(c, 0) | 1 << i
            self.masks[k] = out
        return self.masks[k]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end in the normal form) of each item that lies in the text."""
        if not self.items or not (norm := normal(text)):
            return []
        places: dict[int, list[int]] = {}
        for end, (length, at) in self.auto.iter(norm):
            for k, offset in at:
                places.setdefault(k, []).append(end + 1 - length - offset)
        out = []
        for k, starts in sorted(places.items()):
            item_id, item, most = self.items[k]
            exact = norm.find(item)
            if exact >= 0:
                out.append((item_id, 0, most, exact + len(item)))
                continue
            starts = sorted(set(starts))
            best, at = most + 1, 0
            low = high = None
            for s in [*starts, None]:
                if s is not None and high is not None and s - most <= high:
                    high = s + len(item) + most
                    continue
                if high is not None:
                    distance, end = myers(self._masks(k), len(item), norm[max(0, low) : high])
                    if distance < best:
                        best, at = distance, max(0, low) + end
                if s is not None:
                    low, high = s - most, s + len(item) + most
            if best <= most:
                out.append((item_id, best, most, at))
        return out


def blocks(items: DataFrame, most_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), a block at a time."""
    held, n = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull()).dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        if held and n + len(r.text) > most_chars:
            yield held
            held, n = [], 0
        held.append((r.item_id, r.text))
        n += len(r.text)
    if held:
        yield held


def _finder(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items)
        for batch in batches:
            found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in block.matches(t.as_py())]
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "most", "text_end"])

    return trimmed(run)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> one row for each document and item that lies in it."""
    rows, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for block in blocks(items):
        part = rows.mapInArrow(_finder(block), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def kept(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in whose text no item lies."""
    at = docs.columns.index("text")

    def clean(block_items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(block_items)
            for batch in batches:
                yield batch.filter(pa.array([not block.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return trimmed(run)

    for block in blocks(items):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
