"""Interval planners: chunks, samples and clips of media of known length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_chunks(media: DataFrame, total: str, size: int, overlap: int = 0) -> DataFrame:
    """One row a chunk: [start, stop) reaches ``overlap`` beyond its core [core_start, core_end) on either side."""
    n = F.greatest(F.lit(1), F.ceil(F.col(total) / size))
    rows = media.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    core_start, core_end = F.col("__i") * size, F.least(F.col(total), (F.col("__i") + 1) * size)
    return rows.select(
        *media.columns, F.col("__i").cast("int").alias("chunk"), F.greatest(F.lit(0), core_start - overlap).alias("start"), F.least(F.col(total), (F.col("__i") + 1) * size + overlap).alias("stop"), core_start.alias("core_start"), core_end.alias("core_end")
    )


def even_samples(media: DataFrame, total: str, n: int) -> DataFrame:
    """``n`` frames spread evenly over [0, total - 1], both ends included."""
    at = lambda i: F.floor((F.col(total) - 1) * i / max(1, n - 1)).cast("long")
    return media.withColumn("frame", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))))


def clip_starts(segments: DataFrame, start: str, end: str, span: float, overlap: float, least: int = 3) -> DataFrame:
    """Starts of clips of ``span`` seconds over a segment: strides of span * (1 - overlap), at least ``least`` clips, the
    last one ending with the segment; a segment shorter than a clip gets one, around its middle."""
    length = F.col(end) - F.col(start)
    stride = span * (1 - overlap)
    n = F.greatest(F.lit(least), F.ceil((length - span) / stride) + 1).cast("int")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(start) + (length - span) * i / (n - 1))
    one = F.array(F.greatest(F.lit(0.0), (F.col(start) + F.col(end)) / 2 - span / 2))
    return segments.withColumn("clip_start", F.explode(F.when(length <= span, one).otherwise(even)))
