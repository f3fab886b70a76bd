"""Summaries of resource samples taken while a run goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resource_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (keys, cpu, ram, ram_gb, gpu, gpu_memory) -> averages and peaks by keys. Null samples count as not taken; a
    run without a GPU has null GPU figures."""
    figures = ("cpu", "ram", "ram_gb", "gpu", "gpu_memory")
    return samples.groupBy(*keys).agg(F.count("*").alias("samples"), *[F.avg(c).alias(f"{c}_mean") for c in figures], *[F.max(c).alias(f"{c}_max") for c in figures])
