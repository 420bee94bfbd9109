"""Connected components of an edge table, by alternating large-star and small-star steps (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, staged, unstage


def _nearest(edges: DataFrame, rows: int) -> DataFrame:
    """(a, m, tangled), staged, of the nodes of edges (a, b), a > b: the smallest of a node and its neighbours, and whether
    it keeps the edges from being stars: by two smaller neighbours, or by a smaller and a larger one."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") < F.col("a")).alias("up"), F.count("*").alias("n"))
    return staged(narrow(seen.select("a", F.least("a", "m").alias("m"), ((F.col("up") > 0) & (F.col("n") > 1)).alias("tangled")), rows), "low")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Each step groups by node, stages the groups' minima and joins them back (plain equi-joins, so a hub's rows can be
    split over tasks); nothing is gathered per component. Steps repeat until all are stars, whose edges a further step
    would not change. Self edges only name a node. An empty table gives no rows. Nulls must not occur.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes, now = now.filter("a = b").select(F.col("a").alias("node")), now.filter("a > b")
    rows = now.count()  # no step makes more edges than there were
    low = _nearest(now, rows)
    while not low.filter("tangled").isEmpty():
        # each larger neighbour of a node meets the node's smallest one
        large = staged(narrow(now.select(F.col("b").alias("a"), F.col("a").alias("larger")).join(low, "a").select(F.col("larger").alias("a"), F.col("m").alias("b")).distinct(), rows), "large")
        small_low = staged(narrow(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), rows), "low")
        # a node with one smaller neighbour keeps it; only the others' edges move
        moved = large.join(small_low.filter("n > 1"), "a").filter("b > m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = staged(narrow(moved.union(small_low.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), rows), "edges")
        unstage(now, low, large, small_low)
        now, low = new, _nearest(new, rows)
    unstage(low)
    named = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).union(nodes).distinct()
    return named.union(roots.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
