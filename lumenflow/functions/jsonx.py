"""JSON found inside model output, and properties with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_object(raw: Column) -> Column:
    """From the first { to the last }, without <think> blocks; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0), F.lit(""))


def property_or(json: Column, path: str, default) -> Column:
    return F.coalesce(F.get_json_object(json, path), F.lit(default))


def document_type(raw: Column) -> Column:
    """struct(document_type, confidence): from the JSON object, else from a 'document_type:' line, else the first line up to 100 characters; the last two with confidence 0.5."""
    found = longest_object(raw)
    kind, conf = F.get_json_object(found, "$.document_type"), F.get_json_object(found, "$.confidence").try_cast("double")
    line = F.nullif(F.trim(F.regexp_extract(raw, r"(?im)^\s*document_type:\s*(.+)$", 1)), F.lit(""))
    first = F.substring(F.split_part(F.trim(raw), F.lit("\n"), F.lit(1)), 1, 100)
    return F.struct(F.coalesce(kind, line, first).alias("document_type"), F.when(kind.isNotNull(), F.coalesce(conf, F.lit(0.5))).otherwise(0.5).alias("confidence"))
