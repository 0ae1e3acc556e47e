"""Connected components of a graph whose links fit on no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step on (u, v), u > v: hang neighbours of a node below the smallest node of its neighbourhood.

    both_ways: the larger neighbours of every node (large star), else its smaller ones and itself (small star). The
    smallest neighbours are written before they are joined: both sides of the join are then shuffled for it alone, so
    that Spark can split the rows of a node with very many neighbours among tasks.
    """
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    near = near.join(least, "u")
    if both_ways:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    edges: (a, b) of any orderable type, in any direction, repeats and loops allowed. Alternates large and small
    stars until the set of edges stays the same, which takes about log(n) rounds; every step is one table in the
    shared folder, and only a count and a checksum reach the driver. Nulls link nothing; no edges: no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e, before = materialize(e, "links"), None
    while True:
        mark = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before, old = mark, e
        large = materialize(_stars(e, True), "links")
        e = materialize(_stars(large, False), "links")
        discard(old)
        discard(large)
