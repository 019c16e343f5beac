"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark.llm.common import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root): the least node of each node's component.

    Alternates the large-star and small-star steps until the edges are stars
    around the least nodes; the rounds grow with the logarithm of the longest
    path.  Every round is written to the shared folder, which cuts the lineage.
    Only nodes with an edge to another node appear; self-loops and repeated
    edges change nothing, and an empty table gives an empty one.
    """
    stars = cut(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while True:
        seen = stars.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub"))
        seen = seen.unionByName(stars.select(F.col("v").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("hub")))
        unfinished = seen.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
        unfinished = unfinished.where("leaf > 1 or (leaf = 1 and hub = 1)")
        below = stars.where("u < v")
        if below.isEmpty() and unfinished.isEmpty():
            break
        after = cut(_small_star(_large_star(stars)), "stars")
        release(stars)
        stars = after
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
