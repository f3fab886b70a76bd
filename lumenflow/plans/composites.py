"""Composite plans: retrieval, chapters, timelines, transcript enrichment, map-reduce summaries.

Model steps use the deterministic stand-ins of lumenflow.plans.models.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import text
from lumenflow.operators import folds, intervals, retrieval, sequences, vectorjoin
from lumenflow.operators.numbering import numbered
from lumenflow.operators.peaks import chapter_peaks, energy_peaks
from lumenflow.plans import models
from lumenflow.session import durable


def retrieve_rerank(queries: DataFrame, docs: DataFrame, candidates: int = 50, least: float = 0.05, margin: float = 0.5, k: int = 5) -> DataFrame:
    """(item_id, doc_id, score, rank): sentence chunks, embeddings, the nearest chunks of each query, reranking of (query,
    chunk) pairs, weighted-mean roll-up by document, threshold, margin, top k. Blank queries find nothing.

    Queries travel past blocks of chunk vectors; texts are joined to the candidates only."""
    parts = docs.select("doc_id", text.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    parts = parts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.size("s") / 2).cast("int")) - 1)))
    chunks = parts.select("doc_id", "chunk", F.array_join(F.slice("s", 2 * F.col("chunk") + 1, F.lit(3)), " ").alias("body"))
    chunks = durable(numbered(chunks, ["doc_id", "chunk"], "id"))
    asked = queries.select(F.col("item_id").alias("query"), F.trim("text").alias("asked")).filter("asked <> ''")
    q = models.embed(asked, "query", "asked", prefix="search_query: ").withColumnsRenamed({"id": "query", "vector": "q"})
    v = models.embed(chunks, "id", "body", prefix="search_document: ").withColumnRenamed("vector", "v")
    hits = vectorjoin.search(q, v, candidates, others=False)
    pairs = hits.select("query", "id").join(chunks, "id").join(asked, "query")
    qt, bt = F.array_distinct(text.tokens(F.col("asked"))), text.tokens(F.col("body"))
    shared = F.size(F.array_intersect(qt, bt)) / F.greatest(F.size(qt), F.lit(1))
    scored = pairs.withColumn("rerank", models.rerank_score(shared, F.size(bt)))
    rolled = scored.groupBy(F.col("query").alias("item_id"), "doc_id").agg(F.round(retrieval.roll_up(F.col("rerank"), "weighted_mean"), 9).alias("score"))  # equal documents tie, whatever the order of the sum
    return retrieval.select_candidates(rolled, ["item_id"], "score", ["doc_id"], least, margin, k).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def chapters(rows: DataFrame, media: str, order: str, vector: str, least: float) -> DataFrame:
    """(media, boundary): peaks of the smoothed dissimilarities, short spans merged."""
    d = sequences.adjacent_dissimilarity(rows, [media], order, vector)
    peaks = chapter_peaks(d, media, order, "smooth").select(media, F.col(order).cast("double").alias("b"))
    ends = rows.groupBy(media).agg(F.min(order).cast("double").alias("lo"), F.max(order).cast("double").alias("hi"))
    both = peaks.unionByName(ends.select(media, F.explode(F.array("lo", "hi")).alias("b")))
    return folds.fold(both, [media], ["b"], ["b"], lambda: folds.MergeShort(least), "boundary double")


def timeline(tags: DataFrame, moods: DataFrame, speech: DataFrame, curve: DataFrame, media: str, size: float = 2.0, hop: float = 1.0, speech_tags: tuple[str, ...] = ("speech",), tag_above: float = 0.35, mood_least: float = 0.12, overlap: float = 0.15, max_gap: float = 1.5, least: float = 0.5, distance: float = 20) -> DataFrame:
    """(media, kind, label, s, e, conf) over windows [k * hop, k * hop + size): spans of moods and tags, and energy peaks.

    ``tags`` (media, k, label, conf): those above ``tag_above``, merged. ``moods`` (media, k, label, p), a row for every
    class of a window: of windows that ``speech`` (media, ts, te) overlaps by ``overlap`` or that carry one of
    ``speech_tags``, smoothed in order, the best class (the first by name on ties) of at least ``mood_least``, voted with
    its neighbours, merged. ``curve`` (media, at, x): its peaks, by ``distance`` samples.
    """
    bounds = [(F.col("k") * hop).alias("s"), (F.col("k") * hop + size).alias("e")]
    heard = tags.filter(F.col("conf") > tag_above)
    windows = moods.select(media, "k").distinct()
    spoken = intervals.overlap_semi(windows.select(media, "k", *bounds), speech, [media], "k", max(1, math.ceil(size)), overlap).select(media, "k")
    spoken = spoken.unionByName(heard.filter(F.col("label").isin(*speech_tags)).select(media, "k")).distinct()
    smooth = sequences.smooth_probabilities(moods.join(spoken, [media, "k"], "left_semi"), [media], "k", "label", "p")
    best = smooth.groupBy(media, "k").agg(F.min_by(F.struct("label", F.col("smooth").alias("conf")), F.struct(-F.round("smooth", 12), "label")).alias("m")).select(media, "k", "m.*")
    ordered = best.filter(F.col("conf") >= mood_least).withColumn("i", F.row_number().over(Window.partitionBy(media).orderBy("k")))
    voted = sequences.vote3(ordered, [media], "i", "label", "conf")
    rows = {
        "mood": voted.select(media, F.col("i").alias("ord"), F.col("voted").alias("label"), *bounds, "conf"),
        "tag": heard.select(media, F.row_number().over(Window.partitionBy(media).orderBy("k", "label")).alias("ord"), "label", *bounds, "conf"),
    }
    peaks = energy_peaks(curve, media, "at", "x", distance).select(media, F.lit("energy_peak").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("at").cast("double").alias("s"), F.col("at").cast("double").alias("e"), F.col("x").alias("conf"))
    for kind, r in rows.items():
        spans = sequences.timeline_merge(r, [media], "label", max_gap, least)
        peaks = peaks.unionByName(spans.select(media, F.lit(kind).alias("kind"), "label", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), F.round("conf", 6).alias("conf")))
    return peaks


def enrich(segments: DataFrame, turns: DataFrame, bucket: int = 43200) -> DataFrame:
    """Segments with their best speaker and all overlapping turns, clipped, by start."""
    parts = intervals.overlap_join(segments, turns, ["user_id"], bucket)
    listed = parts.groupBy("user_id", "seg").agg(F.sort_array(F.collect_list(F.struct("o_start", "o_end", "speaker"))).alias("speakers"))
    best = intervals.best_overlap(segments, turns, ["user_id"], "seg", ["turn"], bucket).select("user_id", "seg", "s", "e", "speaker")
    return best.join(listed, ["user_id", "seg"], "left").select("seg", "s", "e", "speaker", F.size(F.coalesce("speakers", F.array())).alias("n_speakers"), F.to_json("speakers").alias("speakers"))


def map_reduce_summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sections, summary): paragraph chunks, one stand-in summary each, joined as '[Section i]' parts, summarised again."""
    chunks = folds.chunk_texts(docs, ["doc_id"], "text", folds.chunk_paragraphs)
    parts = chunks.select("doc_id", "chunk", F.concat(F.lit("[Section "), (F.col("chunk") + 1).cast("string"), F.lit("]\n"), models.summary(F.col("body"))).alias("part"))
    joined = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("p"))
    whole: Column = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n")
    return joined.select("doc_id", F.size("p").alias("n_sections"), models.summary(whole, 400).alias("summary"))
