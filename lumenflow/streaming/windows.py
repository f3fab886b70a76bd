"""Structured Streaming forms of the window operators over an event table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenflow.session import shared_dir


def read_events(spark: SparkSession, path: str, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A file stream with an event-time watermark; ``timestamp_ntz`` becomes ``timestamp``, on which watermarks work."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    # as a pattern, a path may also name a single file
    files = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).parquet(files).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def hopping(events: DataFrame, time: str, size: str, hop: str, keys: list[str], *aggs) -> DataFrame:
    return events.groupBy(F.window(time, size, hop), *keys).agg(*aggs)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], *aggs) -> DataFrame:
    return events.groupBy(F.session_window(time, gap), *keys).agg(*aggs)


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """Late repeats of a key inside the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(keys)


def last_kept(events: DataFrame, key: str, time: str, value: str, least: float) -> DataFrame:
    """(key, value): in the order of time (then value), values at least ``least`` away from the key's last kept value.

    The state is that value. Rows of one micro-batch are ordered as a whole; one that comes in a later micro-batch
    follows them, whatever its time. Null values go.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out, rows = [], pd.concat(list(batches))
        for v in rows.dropna(subset=[value]).sort_values([time, value])[value]:
            if last is None or abs(v - last) >= least:
                last = float(v)
                out.append((k[0], last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["k", "v"])

    return events.groupBy(key).applyInPandasWithState(step, "k long, v double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is available, with checkpoint and result in shared storage, and read the result.

    Batches are written by number, so a batch that is run again replaces its own files; in complete mode the last
    batch is the result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/lumenflow-stream-{uuid.uuid4().hex}"
    latest = [0]

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        latest[0] = max(latest[0], batch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")
    return (out.filter(F.col("batch") == latest[0]) if mode == "complete" else out).drop("batch")
