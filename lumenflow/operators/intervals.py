"""Interval joins: overlap, best overlap, point in interval, range lookup, nearest value.

Inequality joins are made equi-joins on time buckets: an interval is listed in
every bucket it touches, and a pair counts only in the bucket of the later of
the two starts, so each pair appears once. Choose the bucket near the typical
interval length; adaptive execution splits hot (key, bucket) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(df: DataFrame, start: str, end: str, bucket: int, name: str) -> DataFrame:
    b = lambda c: F.floor(F.col(c) / bucket)
    return df.withColumn(name, F.explode(F.sequence(b(start), F.greatest(b(start), b(end)))))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, least: float = 0.0) -> DataFrame:
    """``left`` (keys, s, e, ...) and ``right`` (keys, ts, te, ...) -> overlapping pairs, with ``o_start``, ``o_end`` the
    intersection. Intervals that only touch don't overlap."""
    a, b = _listed(left, "s", "e", bucket, "__b"), _listed(right, "ts", "te", bucket, "__b")
    pairs = a.join(b, [*keys, "__b"]).filter((F.col("te") > F.col("s")) & (F.col("ts") < F.col("e")))
    o_start, o_end = F.greatest("s", "ts"), F.least("e", "te")
    pairs = pairs.filter(F.col("__b") == F.floor(o_start / bucket)).drop("__b")
    return pairs.withColumn("o_start", o_start).withColumn("o_end", o_end).filter(F.col("o_end") - F.col("o_start") >= least)


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_order: list[str], bucket: int) -> DataFrame:
    """Each left row with the right interval of the largest overlap (first in ``right_order`` on ties), or nulls."""
    pairs = overlap_join(left, right, keys, bucket)
    carried = [c for c in right.columns if c not in keys]
    best = F.max_by(F.struct(*carried), F.struct((F.col("o_end") - F.col("o_start")).alias("o"), *[(-F.col(c)).alias(f"t{i}") for i, c in enumerate(right_order)]))
    found = pairs.groupBy(*keys, left_id).agg(best.alias("__best"))
    return left.join(found, [*keys, left_id], "left").select(left["*"], "__best.*")


def point_in_interval(points: DataFrame, right: DataFrame, keys: list[str], point_id: str, right_order: list[str], bucket: int) -> DataFrame:
    """Each point (keys, p, ...) with the first interval [ts, te] that holds it, or nulls."""
    a = points.withColumn("__b", F.floor(F.col("p") / bucket))
    b = _listed(right, "ts", "te", bucket, "__b")
    carried = [c for c in right.columns if c not in keys]
    hits = a.join(b, [*keys, "__b"]).filter("p BETWEEN ts AND te")
    found = hits.groupBy(*keys, point_id).agg(F.min_by(F.struct(*carried), F.struct(*right_order)).alias("__hit"))
    return points.join(found, [*keys, point_id], "left").select(points["*"], "__hit.*")


def overlap_semi(windows: DataFrame, segments: DataFrame, keys: list[str], window_id: str, bucket: int, ratio: float, floor: float = 1e-6) -> DataFrame:
    """Windows that some segment overlaps by at least ``ratio`` of the shorter of the two."""
    pairs = overlap_join(windows, segments, keys, bucket)
    shorter = F.greatest(F.least(F.col("e") - F.col("s"), F.col("te") - F.col("ts")).cast("double"), F.lit(floor))
    hits = pairs.filter((F.col("o_end") - F.col("o_start")) >= shorter * ratio).select(*keys, window_id).distinct()
    return windows.join(hits, [*keys, window_id], "left_semi")


def nearest_fill(points: DataFrame, known: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each point with the value known nearest to it (the earlier on ties): two sorts per key, each passed once with the
    last value known so far; no pair is made."""
    both = points.select(*keys, at, F.lit(True).alias("__ask"), F.lit(None).cast(known.schema[value].dataType).alias(value))
    both = both.unionByName(known.select(*keys, at, F.lit(False).alias("__ask"), value))
    mark = F.when(~F.col("__ask"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    rows = Window.partitionBy(*keys)
    # a frame that reaches to the end is worked out anew for each row, so what follows is what went before in falling order
    before = F.last(mark, ignorenulls=True).over(rows.orderBy(at, "__ask").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(mark, ignorenulls=True).over(rows.orderBy(F.desc(at), "__ask").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__x", before).withColumn("__y", after).filter("__ask")
    pick = F.when(F.col("__y").isNull() | (F.col(at) - F.col("__x.at") <= F.col("__y.at") - F.col(at)), F.col("__x.v")).otherwise(F.col("__y.v"))
    return out.select(*keys, at, pick.alias(value))


def islands(df: DataFrame, keys: list[str], order: list[Column], new: Column, name: str = "island") -> DataFrame:
    """``name``: running number of runs, a run beginning where ``new`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
