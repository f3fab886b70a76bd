"""Session and shared-storage helpers used by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def local_session(cpus: int | str = "*", app: str = "lumenflow") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary
    folder where that is unset (local sessions only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lumenflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation. The files go
    with release(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The durable() tables made inside, for release() once what is computed from them is written."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def release(df: DataFrame) -> None:
    """Delete the files of a durable() table, once all that is computed from it is written; else do nothing."""
    if path := getattr(df, "_durable_path", None):
        sc = df.sparkSession.sparkContext
        hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop_path, True)
