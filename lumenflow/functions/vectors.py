"""Vector and box arithmetic over columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def unit(a: Column, eps: float = 0.0) -> Column:
    """a / (norm + eps); with eps 0 a zero vector stays zero."""
    n = norm(a) + eps
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return dot(a, b) / F.when(d == 0, F.lit(1.0)).otherwise(d)


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.transform(a, lambda x: F.exp(x / temperature))
    total = _sum(e)
    return F.transform(e, lambda x: x / total)


def hamming_share(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def argmax(a: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
