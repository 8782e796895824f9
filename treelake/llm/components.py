"""Connected components of an edge table, by rounds of contraction on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelake.llm.common import stored


def connected_components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """node, root of every node of edges (a, b): root is one node of the component, the same for all of it.

    Each round lets every node point at its smallest neighbour, shortens the pointers, and keeps the edges between
    different ends; nodes at least halve, so rounds grow with the logarithm of the input. Loops and repeated edges are
    fine; an empty table gives no rows.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "cc-roots")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        points = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("p")), "cc-points")
        for _ in range(jumps):
            ahead = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            points = stored(points.join(ahead, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "cc-points")
        for side in ("a", "b"):
            edges = edges.join(points.withColumnRenamed("u", side), side).drop(side).withColumnRenamed("p", side)
        edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        roots = roots.join(points.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = stored(roots, "cc-roots")
    return roots
