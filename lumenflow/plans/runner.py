"""Runs named operators with timing and status; a failure ends one operator, not the run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lumenflow.sources.sinks import run_summary


@dataclass(frozen=True)
class Step:
    module: str
    seconds: float
    status: str
    error: str = ""


def run_module(module: str, fn: Callable[..., Any], *args: Any, **kwargs: Any) -> tuple[Any, Step]:
    """(result, step): status ok or fail, where the result is None; an interrupt is passed on."""
    began = time.monotonic()
    try:
        return fn(*args, **kwargs), Step(module, time.monotonic() - began, "ok")
    except Exception as e:  # noqa: BLE001  any failure is the module's status
        return None, Step(module, time.monotonic() - began, "fail", str(e))


def summary(spark: SparkSession, planned: list[str], steps: list[Step]) -> DataFrame:
    done = spark.createDataFrame([(s.module, s.seconds, s.status) for s in steps], "module string, seconds double, status string")
    return run_summary(spark.createDataFrame([(p,) for p in planned], "module string"), done)
