"""Connected components of a large graph, by alternating large and small stars.

A hub may have a large share of all edges. Its minimum comes from partial sums; the minima are
written out before they are joined to the edges, so that both sides of that join are plain
exchanges, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut, uncut


def oriented(edges: DataFrame) -> DataFrame:
    """``u > v``, no loops, no repeats."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    return oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return oriented(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def roots(edges: DataFrame) -> DataFrame:
    """``u, root``: for each node that has an edge and is not the least of its component, that least node.

    The rounds grow with the logarithm of the longest path. Each writes its edges to the checkpoint
    folder; two numbers reach the driver to tell whether anything has changed.
    """
    now = cut(oriented(edges))
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = sign(now)
    while True:
        last, now = now, cut(small_star(large_star(now)))
        uncut(last)
        after = sign(now)
        if after == before:
            return now.select("u", F.col("v").alias("root"))
        before = after
