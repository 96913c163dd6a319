"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import narrow, settle


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Connect the larger (large star) or the smaller and equal (small star) neighbours of each node to its least one."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = narrow(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        return narrow(narrow(near.where("v > u").join(least, "u"), 2 * n).select(F.col("v").alias("b"), F.col("m").alias("a")).distinct(), n)
    near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = narrow(near.groupBy("u").agg(F.min("v").alias("m")), n)
    moved = narrow(near.join(least, "u"), n).select(F.col("v").alias("b"), F.col("m").alias("a"))
    return narrow(moved.unionAll(least.select(F.col("u").alias("b"), F.col("m").alias("a"))).where("a <> b").distinct(), n)


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component), and how many: the least node reachable from every node of ``edges`` (a, b); self-links and
    nulls are ignored.

    Each round aggregates per node before it joins, so a hub's neighbours are never gathered; only a checksum reaches
    the driver.  Rounds grow with the logarithm of the longest path.
    """
    edges, n = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    before = None
    while True:
        edges, n = settle(_star(_star(edges, n, True), n, False).select("a", "b"), n)
        now = n, edges.agg(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()[0]
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    found = leaves.unionAll(narrow(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct(), n))
    return found, 2 * n
