"""Positions of regex matches with built-in functions only.

Spark gives the matches of a pattern and the text between them, but no positions; both together give them, by a running sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,hit:string,before:string>>"


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Of an array of ints, both(...) of all up to each place. Spans of 1, 2, 4, ... are joined, so a list of n costs n log n and is copied log n times."""

    def step(done: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(done, lambda v, i: F.when(i >= back, both(v, F.get(done, i - back))).otherwise(v))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step)


def found(text: Column, pattern: Column | str, words: bool = False, beside: int = 0) -> Column:
    """Leftmost non-overlapping matches as array of struct (start, end, hit, before), in code points, end exclusive.

    words: in words instead, for text of words with one space before, between and after them. before: the last ``beside`` code points between the
    match before it and a match. The pattern must not match the empty string.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    size = _spaces if words else F.length
    wide = lambda r: size(r["gap"]) + F.coalesce(size(r["hit"]), F.lit(0))

    def span(row: Column, end: Column) -> Column:
        start = end - F.coalesce(size(row["hit"]), F.lit(0)) - int(words)
        return F.struct(start.alias("start"), end.alias("end"), row["hit"].alias("hit"), F.right(row["gap"], F.lit(beside)).alias("before"))

    def walked(hits: Column) -> Column:
        rows = F.arrays_zip(hits.alias("hit"), F.split(text, rx, -1).alias("gap"))
        spans = bound(rows, lambda r: F.zip_with(r, running(F.transform(r, wide), lambda x, y: x + y), span))
        return F.filter(spans, lambda s: s["hit"].isNotNull())  # the last gap has no match behind it

    # the text is split only where there is a match
    return bound(F.regexp_extract_all(text, rx, F.lit(0)), lambda h: F.when(F.size(h) > 0, walked(h)).otherwise(F.array().cast(SPANS)))
