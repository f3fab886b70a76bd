"""Scans of transcripts, speaker turns, segments and structured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT = "struct<id:int,start:string,end:string,text:string,transcript:string,words:array<struct<word:string,start:double,end:double>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, start, end, text) of JSON files that hold a list of segments or {"segments": [...]}; other files give none."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return segments_of(raw, "path", "value")


def segments_of(raw: DataFrame, media: str, value: str) -> DataFrame:
    """Segments of JSON texts: text, else joined words, else transcript; a missing start is the previous end, a missing or
    earlier end the start; segments without text go, but count for what follows."""
    as_list, as_object = F.from_json(value, f"array<{SEGMENT}>"), F.from_json(value, f"struct<segments:array<{SEGMENT}>>")["segments"]
    is_list = F.startswith(F.ltrim(F.col(value)), F.lit("["))
    rows = raw.select(media, F.posexplode(F.when(is_list, as_list).otherwise(as_object)).alias("ord", "s")).filter("s IS NOT NULL")
    words = F.array_join(F.transform("s.words", lambda w: w["word"]), " ")
    body = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (F.col("s.text"), words, F.col("s.transcript"))])
    start, end = F.col("s.start").try_cast("double"), F.col("s.end").try_cast("double")
    rows = rows.select(media, "ord", start.alias("a"), end.alias("z"), body.alias("text"))
    w = Window.partitionBy(media).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.coalesce("z", "a"), ignorenulls=True).over(w)
    rows = rows.withColumn("start", F.coalesce("a", known, F.lit(0.0)))
    return rows.select(media, "ord", "start", F.greatest(F.coalesce("z", "start"), F.col("start")).alias("end"), "text").filter("text IS NOT NULL")


def parse_rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """(media, start, end, speaker) of RTTM lines with 8 fields or more; others are skipped."""
    f = F.split(F.trim(F.col(value)), r"\s+")
    part = lambda i: F.get(f, F.lit(i))
    rows = lines.filter(F.size(f) >= 8).select(part(1).alias("media"), part(3).try_cast("double").alias("start"), part(4).try_cast("double").alias("length"), part(7).alias("speaker"))
    return sane_turns(rows.select("media", "start", (F.col("start") + F.col("length")).alias("end"), "speaker"))


def sane_turns(turns: DataFrame) -> DataFrame:
    """Turns with numbers, a speaker, and an end after the start."""
    return turns.filter(F.col("speaker").isNotNull() & (F.col("end") > F.col("start")))


def word_rows(segments: DataFrame, media: str, order: str, words: str) -> DataFrame:
    """(media, ordinal, word, start, end): all segments' words; the ordinal counts blank words too, which then go."""
    rows = segments.select(media, order, F.posexplode(words).alias("i", "w"))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(media).orderBy(order, "i")) - 1)
    return rows.select(media, "ordinal", "w.*").filter(F.trim("word") != "")


def best_source(media: DataFrame, key: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """Rows of the first source, in the order given, that has any for a media item; ``source`` names it."""
    every = None
    for rank, (name, df) in enumerate(sources):
        own = df.withColumn("source", F.lit(name)).withColumn("__rank", F.lit(rank))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    first = F.min("__rank").over(Window.partitionBy(key))
    return every.join(media.select(key), key, "left_semi").withColumn("__first", first).filter("__rank = __first").drop("__rank", "__first")


def document_text(elements: DataFrame, doc: str, order: str, body: str, most: int | None = None) -> DataFrame:
    """(doc, text): element texts joined by line breaks, all of them, or while the characters before an element (breaks not counted) stay below ``most``; then cut to ``most``."""
    rows = elements.filter(F.trim(body) != "")
    if most is not None:
        w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("__before", F.coalesce(F.sum(F.length(body)).over(w), F.lit(0))).filter(F.col("__before") < most)
    listed = F.sort_array(F.collect_list(F.struct(order, body)))
    joined = F.array_join(F.transform(listed, lambda r: r[body]), "\n")
    return rows.groupBy(doc).agg((joined if most is None else F.substring(joined, 1, most)).alias("text"))


def json_items(raw: DataFrame, keep: list[str], value: str, item: str, under: str | None = None) -> DataFrame:
    """(keep, ord, item's fields) of JSON texts that hold a list of ``item`` (a struct type), or an object with that list
    ``under`` a name: captions (a plain list), text found in frames ("frames"), image manifests ("images"). Broken texts,
    and such without the list, give none."""
    listed = F.from_json(value, f"array<{item}>") if under is None else F.from_json(value, f"struct<{under}:array<{item}>>")[under]
    return raw.select(*keep, F.posexplode(listed).alias("ord", "__item")).filter("__item IS NOT NULL").select(*keep, "ord", "__item.*")


CAPTION = "struct<file:string,caption:string,caption_detailed:string>"
FRAME_TEXT = "struct<frame:int,time:double,text:string,confidence:double>"
MANIFEST_IMAGE = "struct<file:string,page:int,width:int,height:int>"


def captions(raw: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    """A caption file's entries; those without a caption go."""
    return json_items(raw, keep, value, CAPTION).filter(F.trim("caption") != "")


def frame_texts(raw: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    return json_items(raw, keep, value, FRAME_TEXT, "frames")


def manifest_images(raw: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    return json_items(raw, keep, value, MANIFEST_IMAGE, "images")
