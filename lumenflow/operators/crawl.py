"""Breadth-first crawls over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.session import durable


def bfs(links: DataFrame, start: DataFrame, depth: int, budget: int | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` links of ``start`` (node), each at its smallest depth. With ``budget``, a level
    takes the smallest nodes until that many are visited. Each level is one join with the links and one with what was seen."""
    seen = durable(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, n = seen, seen.count() if budget is not None else 0
    for level in range(1, depth + 1):
        found = links.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level))
        if budget is not None:
            new = new.orderBy("node").limit(max(0, budget - n))
        frontier = durable(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        n += frontier.count() if budget is not None else 0
    return seen
