"""Markdown pages: header comments, directory scans, link and table extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions import text


def page_header(url: Column, status: Column) -> Column:
    """The comment lines that a crawl writes above a page."""
    return F.concat(F.lit("<!-- Source: "), url, F.lit(" -->\n<!-- Status: "), status, F.lit(" -->\n"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, metadata map, title) of every .md file below ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return named.select("path", "content", text.comment_metadata(F.col("content")).alias("metadata"), text.page_title(F.col("content"), F.col("path")).alias("title"))


def links(html: Column) -> Column:
    """Targets of <a href="...">, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def cells(table_html: Column) -> Column:
    """array<array<string>>: the non-empty rows of a flat HTML table, tags dropped, trimmed."""
    rows = F.regexp_extract_all(table_html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cell = F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>")
    clean = lambda c: F.trim(F.regexp_replace(c, "(?s)<[^>]*>", ""))
    return F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, cell, F.lit(1)), clean)), lambda r: F.size(r) > 0)
