"""Connected components by alternating large and small stars, as joins over written edge tables.

Each round links every node to the smallest one of its neighbourhood; edges are distinct pairs (node, smaller node), so a
hub's edges are rows, never one value. Rounds end when the edges no longer change: they are then stars, and the smaller
node is the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # an edge with both ends below its node's least stays as it is for the small star
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(scratch: Scratch, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link to another one; root is the smallest node reachable."""
    name = scratch.unused("edges")
    edges = scratch.table(_oriented(links, a, b), name)
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        stars = _oriented(_large_star(edges), "a", "b")
        edges = scratch.table(_oriented(_small_star(stars), "a", "b"), name)
        scratch.drop_older(name)
