"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ties = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) edges; the root is the least node of its component.

    Every round is written to the shared folder, which cuts the lineage. Rounds
    grow with the logarithm of the number of nodes; a node's edges are never
    gathered, only their least end is, which adds up before the shuffle.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialize(edges.where(F.col("a") != F.col("b")).select(u, v).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = materialize(_small_star(_large_star(now)), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select("root", "root").distinct())


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: two numbers for all of them."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
