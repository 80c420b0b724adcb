"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum per node and a join on the node; the
edges are written to the shared folder between rounds. Rounds grow with the
logarithm of the longest path. No component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import discard, materialize


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    """Every neighbour greater than the node is linked to the least neighbour."""
    both = _both(e)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and m <> b").select(F.col("m").alias("a"), "b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """The node and its lesser neighbours are linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    return near.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b) with a <> b;
    the component is its least node. Self loops are ignored."""
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-cc")
    last = None
    for _ in range(max_rounds):
        nxt = materialize(_small(_large(e)), f"{tag}-cc")
        sign = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = nxt
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
