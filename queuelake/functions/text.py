"""Similarity of names, and distances on the globe."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams; a shorter text has none."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def dice(a: Column, b: Column) -> Column:
    """Of the sets of bigrams; equal texts are 1, texts without bigrams else 0."""
    x, y = ngrams(a, 2), ngrams(b, 2)
    total = F.size(x) + F.size(y)
    return F.when(a == b, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def trigrams(text: Column) -> Column:
    """Of words, each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: ngrams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / either)


def within_edits(a: Column, b: Column, most: int) -> Column:
    """The edit distance if it is at most that, else null."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def _folded(text: pd.Series) -> pd.Series:
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return text.map(plain)


def fold(text: Column) -> Column:
    """Lower case without marks of any script, and ss for its ligature."""
    return F.pandas_udf(_folded, "string")(text)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether an odd number of the ring's edges lies east of the point; the ring is a parameter, so its edges fold into one expression."""
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
            crossings = crossings + (spans & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)).cast("int")
    return crossings % 2 == 1


def metaphone(word: Column) -> Column:
    """The sound of a word as Spark has it (soundex): a coarser key than a double metaphone, for blocking alone."""
    return F.soundex(word)
