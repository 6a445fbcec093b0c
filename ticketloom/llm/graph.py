"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _toward_smallest(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead (itself,
    if it is smaller). The minima are formed before the shuffle; AQE splits the join of a hot node."""
    pairs = _both_ways(edges)
    smallest = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
    return pairs.join(smallest, "a").filter(F.col("b") > F.col("a")).select(
        F.col("_m").alias("a"), "b").filter("a < b").distinct()


def _among_smaller(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    smallest = edges.groupBy("b").agg(F.min("a").alias("_m"))
    joined = edges.join(smallest, "b")
    moved = joined.select(F.col("_m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.unionByName(smallest.select(F.col("_m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Two steps alternate until every node hangs on a root: large groups shrink to stars in a number of
    rounds that grows with the logarithm of their size. Edges with a null end or two equal ends count
    for nothing.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    current = stored(ordered, "edges")
    while True:
        inner = current.select(F.col("a").alias("b")).join(current.select("b"), "b", "left_semi")
        twice = current.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        if inner.select("b").unionByName(twice.select("b")).isEmpty():
            break
        current = stored(_among_smaller(_toward_smallest(current)), "edges")
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
