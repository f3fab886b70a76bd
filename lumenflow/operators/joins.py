"""Joins whose hot keys adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, each side after a shuffle of its own.

    Adaptive execution splits a hot key of a sort-merge join only where both inputs come straight from the join's own
    shuffles. An aggregate on the same keys is already partitioned by them, so Spark would join it without one, and
    all of a hot key's left rows would stay in one task. A hash of the keys as a further key makes the partitionings
    differ. ``right`` should hold few rows a key, as they are read again for each part of a split key.
    """
    mark = F.xxhash64(*keys)
    return left.withColumn("__mark", mark).join(right.withColumn("__mark", mark), [*keys, "__mark"], how).drop("__mark")
