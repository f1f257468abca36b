"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, written


def _least(links: DataFrame) -> DataFrame:
    """links (u, v) -> u, m, the least of u and its neighbours, open: whether u has a smaller neighbour and another one besides."""
    ends = links.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    return materialize(ends.select("u", F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("most") != F.col("m"))).alias("open")), "least")


def _star(links: DataFrame, least: DataFrame, larger: bool) -> DataFrame:
    """links (u, v): every node u ties its neighbours to the least of them and itself: the larger ones, or the smaller ones and itself.

    The least neighbours are a written table, so the join is one of two shuffled sides, and AQE splits the links of a hub.
    """
    tied = links.join(least.select("u", "m"), "u")
    if larger:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter(F.col("u") != F.col("v"))
    return materialize(out if larger else out.distinct(), "edges")  # copies do no harm in between


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges (u, v), longs -> node, component, a written table: the least node that can be reached; of nodes with an edge to another node.

    Edges with a null end are none; repeated edges count once; no edges give no rows; further columns are ignored.

    Every round is O(edges) work and shuffle, and rounds are about the logarithm of the longest path; each is cut off by a written table.
    Edges are stars once no node is open (``_least``): who has a smaller neighbour has no other, so that one has larger neighbours only.
    The table that shows it is the result.
    """
    with written() as w:
        now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        for _ in range(most_rounds):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            with written() as step:
                least = _least(both)
                if least.filter("open").isEmpty():
                    step.keep(least)
                    break
                larger = _star(both, least, True)
                now = _star(larger, _least(larger), False)
                step.keep(now)
        else:
            raise RuntimeError("components didn't settle")
        w.keep(least)
    return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
