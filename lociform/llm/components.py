"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, meet


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a, b): component is its smallest reachable id.

    Alternates large-star and small-star steps: each links neighbours to their smallest neighbour, so the
    rounds grow with the logarithm of the diameter, and a vertex's neighbours are only aggregated to a minimum.
    A hub's edges are not brought together: hubs, with more than 1/HOT_KEYS of all edges each, are few, and their
    minima are broadcast to where the edges are. Edges are cut to the shared checkpoint folder after every round.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:
        # Large star: every larger neighbour is linked to the least of the neighbourhood.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = meet(both.filter("v > u"), least, "u", F.col("n") * HOT_KEYS > 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the vertex itself, is linked to the least smaller one.
        large = cut(large)
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, lows, "u", F.col("n") * HOT_KEYS > large.count())
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        now = cut(small.select(F.explode(ends).alias("e")).select("e.*").filter("u <> v").distinct())
        last, mark = mark, _mark(now)
        if last == mark:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """How many edges, and two sums that tell one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
