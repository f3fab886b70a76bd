"""The four media pipelines as ladders of modules: chosen modules run in order, each if its inputs are there.

A module takes the tables made so far and gives one table. What fails or lacks
an input is recorded, and later modules that need it are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.functions import text
from lumenflow.operators import clustering, folds, intervals, sequences
from lumenflow.operators.keywords import tfidf_keywords
from lumenflow.plans import composites, models
from lumenflow.plans.gates import require
from lumenflow.plans.runner import Step, run_module, summary
from lumenflow.sources import markdown, sinks, transcripts

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Module:
    name: str
    needs: tuple[str, ...]
    run: Callable[[Tables], DataFrame]


#: tables: segments (media, ord, start, end, text), turns (media, turn, ts, te, speaker), tags (media, k, label, conf), moods (media, k, label, p), energy (media, at, x), vectors (media, id, v)
AUDIO = (
    Module("words", ("segments",), lambda t: sequences.word_timing(t["segments"], "text", "start", "end")),
    Module("speakers", ("segments", "turns"), lambda t: intervals.best_overlap(t["segments"].select("media", "ord", F.col("start").alias("s"), F.col("end").alias("e"), "text"), t["turns"], ["media"], "ord", ["turn"], 60)),
    Module("resegmented", ("words",), lambda t: folds.fold(t["words"], ["media"], ["ord", "word_index"], ["word", "word_start", "word_end"], folds.WordsToSegments, "segment int, start double, end double, n_words int, body string")),
    Module("subtitles", ("segments",), lambda t: sinks.subtitles(t["segments"], "media", "start", "end", "text")),
    Module("transcript", ("segments",), lambda t: sinks.plain_text(t["segments"], "media", "ord", "text")),
    Module("keywords", ("segments",), lambda t: tfidf_keywords(t["segments"].withColumn("id", F.concat_ws(":", "media", "ord")), "id", "text")),
    Module("entities", ("segments",), lambda t: models.find_entities(t["segments"].withColumn("id", F.xxhash64("media", "ord")), "id", "text")),
    Module("timeline", ("tags", "moods", "turns", "energy"), lambda t: composites.timeline(t["tags"], t["moods"], t["turns"], t["energy"], "media")),
    Module("chapters", ("vectors",), lambda t: composites.chapters(t["vectors"], "media", "id", "v", 3.0)),
)

#: tables: scenes (media, first, last), vectors (media, id, v), actions (media, ord, label, s, e, conf)
VIDEO = (
    Module("keyframes", ("scenes",), lambda t: sequences.keyframe_plan(t["scenes"], "media", "first", "last", 30.0).select("media", "first", "last", "frame")),
    Module("mosaics", ("keyframes",), lambda t: sinks.mosaics(t["keyframes"].distinct(), "media", "frame", 3, 3)),
    Module("clusters", ("vectors",), lambda t: clustering.frame_clusters(t["vectors"], "media", "id", "v", 0.995, 0.2)),
    Module("actions_merged", ("actions",), lambda t: sequences.action_merge(t["actions"], ["media"], "label")),
)

#: tables: questions (item_id, text), documents (doc_id, text), pages (url, html)
RESEARCH = (
    Module("retrieved", ("questions", "documents"), lambda t: composites.retrieve_rerank(t["questions"], t["documents"])),
    Module("snapshots", ("pages",), lambda t: sinks.snapshots(t["pages"].withColumn("status", F.lit("200")), "url", "status", "html")),
    Module("extracted", ("snapshots",), lambda t: t["snapshots"].select("name", text.comment_metadata(F.col("content")).alias("metadata"), text.page_title(F.col("content"), F.col("name")).alias("title"), markdown.links(F.col("content")).alias("links"))),
)


def element_entities(elements: DataFrame) -> DataFrame:
    """(id, ord, word, kind, score, start, end): entities of every element of 10 characters and more, white space around it stripped; ``id`` is the document's."""
    rows = elements.select("doc_id", "ord", F.regexp_replace("text", r"(?U)^\s+|\s+\z", "").alias("text")).filter(F.length("text") >= 10)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "ord"))
    found = models.find_entities(rows, "key", "text").withColumnRenamed("id", "key")
    return rows.select("key", F.col("doc_id").alias("id"), "ord").join(found, "key").drop("key")


#: tables: elements (doc_id, ord, type, text)
DOCS = (
    Module("text", ("elements",), lambda t: transcripts.document_text(t["elements"], "doc_id", "ord", "text")),
    Module("types", ("elements",), lambda t: t["elements"].groupBy("doc_id", "type").agg(F.count("*").alias("n"))),
    Module("chunks", ("text",), lambda t: folds.chunk_texts(t["text"], ["doc_id"], "text", folds.chunk_paragraphs)),
    Module("overview", ("text",), lambda t: composites.map_reduce_summary(t["text"])),
    Module("entities", ("elements",), lambda t: element_entities(t["elements"])),
    Module("forms", ("elements",), lambda t: t["elements"].select("doc_id", "ord", text.key_value(F.col("text")).alias("kv")).select("doc_id", "ord", "kv.*").filter(~F.lower("key").isin("", "nan", "none") & (F.col("value") != ""))),
)

PIPELINES = {"audio": AUDIO, "video": VIDEO, "research": RESEARCH, "docs": DOCS}


def run(spark: SparkSession, name: str, tables: Tables, chosen: list[str] | None = None, materialise: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Tables, DataFrame]:
    """(all tables, run summary). ``materialise`` runs a module's table (as session.durable does), so that its failures are its own."""
    made, steps = dict(tables), list[Step]()
    ladder = [m for m in PIPELINES[name] if chosen is None or m.name in chosen]
    for m in ladder:
        try:
            require(set(made), *m.needs)
        except ValueError as e:
            steps.append(Step(m.name, 0.0, "skipped", str(e)))
            continue
        out, step = run_module(m.name, lambda m=m: (materialise or (lambda df: df))(m.run(made)))
        steps.append(step)
        if out is not None:
            made[m.name] = out
    return made, summary(spark, [m.name for m in PIPELINES[name]], steps)
