"""Subtitle, text, table, Markdown, mosaic and run-summary sinks, as DataFrames ready to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import timing


def _joined(order: str, body: str, sep: str):
    rows = F.sort_array(F.collect_list(F.struct(order, body)))
    return F.array_join(F.transform(rows, lambda r: r[body]), sep)


def subtitles(segments: DataFrame, media: str, start: str, end: str, text: str) -> DataFrame:
    """(media, srt): numbered cues by start."""
    n = F.row_number().over(Window.partitionBy(media).orderBy(start, end, text))
    cue = F.concat(n.cast("string"), F.lit("\n"), timing.srt_time(F.col(start)), F.lit(" --> "), timing.srt_time(F.col(end)), F.lit("\n"), F.trim(F.col(text)), F.lit("\n"))
    return segments.select(media, n.alias("n"), cue.alias("cue")).groupBy(media).agg(_joined("n", "cue", "\n").alias("srt"))


def plain_text(segments: DataFrame, media: str, start: str, text: str) -> DataFrame:
    return segments.filter(F.trim(text) != "").groupBy(media).agg(_joined(start, text, " ").alias("text"))


def csv_lines(cells: DataFrame, doc: str, rows: str) -> DataFrame:
    """(doc, csv): a table's rows as CSV; fields with quotes, commas or breaks are quoted."""
    field = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, field), ","))
    return cells.select(doc, F.array_join(lines, "\n").alias("csv"))


def html_table(cells: DataFrame, doc: str, rows: str) -> DataFrame:
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return cells.select(doc, F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>")).alias("html"))


def snapshots(pages: DataFrame, url: str, status: str, body: str, taken: int = 0, ties: tuple[str, ...] = ()) -> DataFrame:
    """(name, content): crawled pages numbered by address, then by the columns of ``ties`` (nulls last), after ``taken`` existing files."""
    from lumenflow.sources.markdown import page_header

    n = F.row_number().over(Window.orderBy(*[F.asc_nulls_last(c) for c in (url, *ties)])) + taken  # a crawl's page budget bounds this
    return pages.select(F.format_string("page_%04d.md", n).alias("name"), F.concat(page_header(F.col(url), F.col(status)), F.lit("\n"), F.col(body)).alias("content"))


def mosaics(frames: DataFrame, media: str, frame: str, rows: int, cols: int) -> DataFrame:
    """(media, tile, frames): frames in order, rows * cols to a tile."""
    n = F.row_number().over(Window.partitionBy(media).orderBy(frame)) - 1
    return frames.select(media, frame, F.floor(n / (rows * cols)).cast("int").alias("tile")).groupBy(media, "tile").agg(F.sort_array(F.collect_list(frame)).alias("frames"))


def run_summary(planned: DataFrame, executed: DataFrame) -> DataFrame:
    """(module, seconds, status): planned modules that didn't run get 'not_run'."""
    return planned.join(executed, "module", "left").select("module", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("status", F.lit("not_run")).alias("status"))
