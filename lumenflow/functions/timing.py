"""Time and number formatting over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(seconds: Column) -> tuple[Column, Column, Column, Column]:
    ms = F.floor(F.round(seconds * 1000, 6)).cast("long")
    return F.floor(ms / 3600000).cast("long"), (F.floor(ms / 60000) % 60).cast("long"), (F.floor(ms / 1000) % 60).cast("long"), ms % 1000


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are cut, not rounded."""
    h, m, s, ms = _parts(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, s, ms)


def chapter_time(seconds: Column) -> Column:
    """[HH:]MM:SS.mmm, hours only where there are some."""
    h, m, s, ms = _parts(seconds)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, s, ms)).otherwise(F.format_string("%02d:%02d.%03d", m, s, ms))


def human_duration(seconds: Column) -> Column:
    """12.3s, 2m 5s, 1h 2m 3s."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%dh %dm %ds", h, m, s))


def parse_time(text: Column) -> Column:
    """Seconds of '90', '12.5', 'MM:SS(.f)' or 'HH:MM:SS(.f)'; null for anything else and for negative numbers."""
    pattern = r"^(?:(\d{1,2}):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))
    plain = text.try_cast("double")
    return F.when(plain >= 0, plain).when(plain.isNull() & text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def to_int(text: Column) -> Column:
    """int, else int of a float, else null."""
    return F.coalesce(text.try_cast("long"), F.floor(F.abs(text.try_cast("double"))).cast("long") * F.signum(text.try_cast("double")).cast("long"))


def frame_skip(native: Column, target: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(native / target).cast("long") - 1)
