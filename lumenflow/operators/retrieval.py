"""Retrieval: nearest neighbours of given queries, score roll-up, candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.operators.vectorjoin import search


def roll_up(score: Column, how: str = "max", k: int = 3) -> Column:
    """Aggregate chunk scores: max, mean, top_k_mean, weighted_mean (weights e^score; the mean if they vanish). Other names count as max."""
    if how == "mean":
        return F.avg(score)
    if how == "top_k_mean":
        top = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, k)
        return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(k), F.count(score))
    if how == "weighted_mean":
        total = F.sum(F.exp(score))
        return F.when(total > 0, F.sum(score * F.exp(score)) / F.when(total > 0, total).otherwise(1.0)).otherwise(F.avg(score))
    return F.max(score)


def nearest(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, k: int, cosine: bool = False) -> DataFrame:
    """Each query (query_id, q array<double>) with its k best (vector_id, v) by inner product or cosine, ties to smaller ids."""
    found = search(queries.select(F.col(query_id).alias("query"), "q"), vectors.select(F.col(vector_id).alias("id"), "v"), k, cosine)
    return found.withColumnsRenamed({"query": query_id, "id": vector_id})


def select_candidates(df: DataFrame, keys: list[str], score: str, ties: list[str], least: float | None = None, margin: float | None = None, k: int | None = None) -> DataFrame:
    """Order by score, drop those under ``least``, then those more than ``margin`` below the best, then all but the first ``k``; adds ``rank``."""
    out = df if least is None else df.filter(F.col(score) >= least)
    w = Window.partitionBy(*keys)
    out = out.withColumn("__best", F.max(score).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), *ties)))
    if margin is not None:
        out = out.filter(F.col("__best") - F.col(score) <= margin)
    return (out if k is None else out.filter(F.col("rank") <= k)).drop("__best")
