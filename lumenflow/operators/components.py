"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.operators.joins import split_join
from lumenflow.session import durable, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected ``edges`` (u, v). Large: every neighbour above
    a node is linked to the node's smallest neighbour (itself included). Small:
    every neighbour below it, and the node itself, are."""
    both = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = split_join(both, least, ["u"])
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edges, in any order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` (u, v) of any orderable type -> (node, root), root the smallest
    node reachable. Nodes without edges don't appear; self-loops are ignored.

    Each round costs a few shuffles of the edges and is written to shared storage,
    where it replaces the round before; rounds end when they no longer change
    the edges, which then are a star around each root, after O(log^2 n) rounds.
    Minima are combined before the shuffle, and a hub's neighbours are joined
    with its minimum by a join that adaptive execution can split.
    """
    now = durable(edges.select("u", "v").filter("u <> v").distinct())
    was = _state(now)
    for _ in range(max_rounds):
        after = durable(_star(_star(now, True), False))
        release(now)
        state = _state(after)
        if state == was:
            stars = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        now, was = after, state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
