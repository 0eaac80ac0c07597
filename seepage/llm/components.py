"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.tables import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    return _with_least(_both_ways(edges)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them (edges point down)."""
    tied = _with_least(edges)
    moved = tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = tied.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v); the component is its least node.

    The tables are never collected: each round is two aggregations and two
    joins on node ids, and is written to the shared folder.  Stars shrink the
    depth of every tree, so the rounds grow with the logarithm of the longest
    chain.  Null ends and loops are left out; an empty table gives no rows.
    """
    edges = links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u is not null and v is not null and u <> v").distinct()
    last = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
