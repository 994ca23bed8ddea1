"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, upward: bool) -> DataFrame:
    """One contraction over (a, b): the neighbours above a node, or below it, move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if upward else both.filter("b < a")
    low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    if upward:
        moved = near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = (
            near.join(low, "a")
            .filter("b != low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b")))
        )
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b), for nodes with an edge.

    Every round writes its edges to the shared folder, so no lineage builds up; the rounds
    grow with the logarithm of the number of nodes. Loops (a, a) and repeated edges do no harm;
    nulls never get in, as the callers join on the ends.
    """
    edges = staged(edges.select("a", "b").filter("a != b").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(mark)
        edges = staged(_stars(_stars(edges, True), False))
