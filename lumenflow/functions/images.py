"""Image-like arrays: perceptual hash, motion, polygon boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dct(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def phash(pixels: np.ndarray, size: int = 32, keep: int = 8) -> int:
    """64 bits of a square grey image: its low frequencies against their median (the constant term left out of it)."""
    m = _dct(size)
    low = (m @ pixels.reshape(size, size).astype(np.float64) @ m.T)[:keep, :keep].reshape(-1)
    return int(np.packbits(low > np.median(low[1:])).view(">u8")[0].astype(np.int64))


def phash_column(pixels: Column, size: int = 32) -> Column:
    """long hash of an array of size * size grey values; null for null or another length."""

    @F.pandas_udf("long")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([phash(np.asarray(r), size) if r is not None and len(r) == size * size else None for r in rows], dtype="Int64")

    return run(pixels)


def motion_ratio(before: Column, after: Column, least: float = 25.0) -> Column:
    """Share of elements that differ by more than ``least``."""
    moved = F.filter(F.zip_with(before, after, lambda a, b: F.abs(a - b)), lambda x: x > least)
    return F.size(moved) / F.greatest(F.size(before), F.lit(1))


def polygon_box(points: Column) -> Column:
    """struct(x1, y1, x2, y2) of an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
