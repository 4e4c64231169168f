"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

The smallest neighbours of the nodes are summed before the shuffle and checkpointed before they are joined back, so that both
sides of that join are plain exchanges: the edges of a node that a large component hangs on are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("b", "a").union(edges.select("a", "b")).toDF("u", "v")
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m")).checkpoint()
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m")).checkpoint()
    moved = edges.join(least, F.col("b") == F.col("w")).filter("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.union(least.select(F.col("w").alias("b"), F.col("m").alias("a")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) but the roots: root is the smallest node that it reaches.

    Each round's edges are checkpointed in the shared folder; there are about log2 of the longest path rounds. The end is a
    table of stars, which a round gives back unchanged: every node has one edge, and no root has an edge to a smaller node.
    Nulls and loops are left out; repeated edges count once.
    """
    prepare(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a < b").select("b", "a").distinct().checkpoint()
    mark = None
    while True:
        starred = _large_star(edges).distinct().checkpoint()
        edges = _small_star(starred).filter("a < b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = tuple(now)
