"""Peak picking by height, distance and prominence over one media item's curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Positions of rises followed by falls; the middle of a flat top (the earlier of two)."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
    ends = np.append(starts[1:], len(x)) - 1
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    return (starts[top] + ends[top]) // 2


def prominence(x: np.ndarray, peak: int) -> float:
    """Height above the higher of the lowest points on either side, each side ending before a higher sample."""
    higher = np.flatnonzero(x[:peak] > x[peak])
    left = x[(higher[-1] + 1 if len(higher) else 0) : peak + 1].min()
    higher = np.flatnonzero(x[peak + 1 :] > x[peak])
    right = x[peak : peak + 1 + (higher[0] if len(higher) else len(x))].min()
    return float(x[peak] - max(left, right))


def find_peaks(x: np.ndarray, height: float | None = None, distance: float = 1, least: float = 0.0, most: int | None = None) -> np.ndarray:
    """Local maxima of at least ``height``; of two nearer than ``distance`` the higher stays (the later if equal); then those
    with a prominence of at least ``least``; with ``most``, the highest that many (the earlier if equal), in order."""
    p = local_maxima(x)
    if height is not None:
        p = p[x[p] >= height]
    keep, near = np.ones(len(p), bool), math.ceil(distance)
    for i in np.argsort(x[p], kind="stable")[::-1]:
        if keep[i]:
            close = np.abs(p - p[i]) < near
            close[i] = False
            keep[close] = False
    p = np.array([i for i in p[keep].tolist() if prominence(x, i) >= least], np.int64)
    return p if most is None else np.sort(p[np.argsort(-x[p], kind="stable")[:most]])


def median5(x: np.ndarray) -> np.ndarray:
    """Running median of five, zeros beyond the ends."""
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 2), 5), axis=1) if len(x) else x


def _peaks(df: DataFrame, media: str, order: str, x: str, pick) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at = pick(pdf[x].to_numpy(np.float64))
        return pdf[[media, order, x]].iloc[at]

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (media, order, x))
    return df.select(media, order, x).groupBy(media).applyInPandas(run, fields)


def chapter_peaks(df: DataFrame, media: str, order: str, x: str, distance: float = 1, least: float = 0.05, most: int | None = None) -> DataFrame:
    """Rows at peaks above the media item's 75th percentile."""
    return _peaks(df, media, order, x, lambda v: find_peaks(v, float(np.percentile(v, 75)), distance, least, most))


def energy_peaks(df: DataFrame, media: str, order: str, x: str, distance: float) -> DataFrame:
    """Rows at peaks of the median-filtered curve: height mean + 0.5 deviations, prominence 0.3 deviations."""

    def pick(v: np.ndarray) -> np.ndarray:
        s = median5(v)
        return find_peaks(s, float(s.mean() + 0.5 * s.std()), distance, 0.3 * float(s.std()))

    return _peaks(df, media, order, x, pick)
