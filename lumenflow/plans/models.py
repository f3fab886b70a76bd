"""The boundary to models: typed batch functions, with deterministic stand-ins.

A model is ``fn(batch of rows) -> rows`` over Arrow batches of a fixed size, in
order. Stand-ins are pure functions of the input. They show that the data flows,
and say nothing about the accuracy of any model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenflow.functions import text


def apply_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, batch: int = 32) -> DataFrame:
    """Rows through a model made once a task, ``batch`` at a time, in order. A batch that fails fails the job, so no rows are lost unseen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            for at in range(0, len(b), batch):
                yield model(b.iloc[at : at + batch])

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class ModelKind:
    """What a model operator takes and gives."""

    name: str
    takes: str
    gives: str
    batch: int = 32


WORDS = "array<struct<word:string,start:double,end:double>>"
KINDS = (
    ModelKind("speech_to_text", "media string, audio binary", f"media string, id int, start double, end double, text string, words {WORDS}"),
    ModelKind("speech_to_text_long", "media string, audio binary", "media string, word string, start double, end double"),
    ModelKind("forced_alignment", "media string, word string, start double, end double", "media string, word string, start double, end double, confidence double"),
    ModelKind("diarization", "media string, audio binary", "media string, start double, end double, speaker string"),
    ModelKind("voice_activity", "media string, audio binary", "media string, id int, start double, end double"),
    ModelKind("speech_emotion", "media string, start double, end double", "media string, start double, end double, probs array<double>"),
    ModelKind("audio_tagging", "media string, start double, end double", "media string, start double, end double, label string, confidence double"),
    ModelKind("source_separation", "media string, audio binary", "media string, stem string, audio binary"),
    ModelKind("entities", "id long, text string", "id long, word string, kind string, score double, start int, end int", 8),
    ModelKind("embedding", "id long, text string", "id long, vector array<double>", 64),
    ModelKind("rerank", "query string, body string", "score double"),
    ModelKind("text_generation", "id long, prompt string", "id long, raw string"),
    ModelKind("image_caption", "id long, image binary", "id long, caption string, caption_detailed string, caption_more_detailed string", 8),
    ModelKind("object_detection", "frame int, image binary", "frame int, det_id int, class_name string, confidence double, x1 int, y1 int, x2 int, y2 int", 8),
    ModelKind("faces", "frame int, image binary", "frame int, x1 int, y1 int, x2 int, y2 int, vector array<double>"),
    ModelKind("image_features", "frame int, image binary", "frame int, vector array<double>, phash long", 96),
    ModelKind("text_in_images", "frame int, image binary", "frame int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"),
    ModelKind("frame_classes", "frame int, image binary", "frame int, label string, confidence double"),
    ModelKind("actions", "media string, start double, end double", "media string, start double, end double, label string, confidence double"),
    ModelKind("scenes", "media string, frame int, score double", "media string, scene int, first_frame int, last_frame int"),
)


def _stand_in_value(name: str, kind: T.DataType, seed: Column) -> Column:
    """A value of the type, drawn from a hash of the input: numbers in [0, 1) or 0 to 99, names of four classes, 8 probabilities."""
    share = lambda salt: F.pmod(F.xxhash64(seed, F.lit(name), F.lit(salt)), F.lit(1000)) / 1000.0
    if isinstance(kind, T.DoubleType):
        return share(0)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.floor(share(0) * 100).cast(kind)
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(f"{name}_"), F.floor(share(0) * 4).cast("string"))
    if isinstance(kind, T.BinaryType):
        return seed.cast("string").cast("binary")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
        raw = F.array(*[share(i) + 0.001 for i in range(8)])
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return F.transform(raw, lambda x: x / total)
    if isinstance(kind, T.ArrayType):
        return F.array(_stand_in_value(name, kind.elementType, seed))
    if isinstance(kind, T.StructType):
        return F.struct(*[_stand_in_value(f.name, f.dataType, seed).alias(f.name) for f in kind.fields])
    raise TypeError(f"no stand-in for {kind.simpleString()}")


def stand_in(kind: ModelKind, df: DataFrame) -> DataFrame:
    """One row of the contract's output for each input row: what the input has is passed on, boxes and intervals are put
    in order, all else is a pure function of the input. Runs inside the JVM."""
    takes, gives = T.StructType.fromDDL(kind.takes), T.StructType.fromDDL(kind.gives)
    if missing := [f.name for f in takes.fields if f.name not in df.columns]:
        raise ValueError(f"{kind.name} needs {', '.join(missing)}")
    seed = F.xxhash64(*[F.col(f.name) for f in takes.fields])
    value = {f.name: F.col(f.name).cast(f.dataType) if f.name in df.columns else _stand_in_value(f.name, f.dataType, seed) for f in gives.fields}
    for lo, hi in (("x1", "x2"), ("y1", "y2"), ("start", "end"), ("first_frame", "last_frame")):
        if hi in value and hi not in df.columns:
            value[hi] = (value[lo] + value[hi] + 1).cast(gives[hi].dataType)
    return df.select(*[value[f.name].alias(f.name) for f in gives.fields])


def hashed_vector(body: str, dim: int = 32) -> list[float]:
    """Stand-in embedding: signed counts of words, dealt to positions by their MD5, brought to unit length and rounded to
    multiples of 1 / 1024, so that inner products are exact and tie alike everywhere."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", body.lower()):
        h = hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] >= 128 else -1
    n = np.sqrt((v * v).sum())
    return (np.floor(v / n * 1024 + 0.5) / 1024 if n else v).tolist()


def embed(df: DataFrame, ident: str, body: str, dim: int = 32, prefix: str = "") -> DataFrame:
    """(id, vector) of ``prefix`` and the text."""
    rows = df.select(F.col(ident).cast("long").alias("id"), F.concat(F.lit(prefix), F.coalesce(F.col(body), F.lit(""))).alias("text"))
    return apply_model(rows, lambda: lambda b: pd.DataFrame({"id": b["id"], "vector": [hashed_vector(t, dim) for t in b["text"]]}), "id long, vector array<double>", 64)


def find_entities(df: DataFrame, ident: str, body: str, least: float = 0.6) -> DataFrame:
    """(id, word, kind, score, start, end): stand-in entities: capitalised words of 4 letters and more inside a line; kind and score from a hash."""
    pattern = re.compile(r"(?<=[a-zà-ÿ,;] )[A-ZÀ-Þ][\w]{3,}")

    def model(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, t in zip(b["id"], b["text"]):
            for m in pattern.finditer(t or ""):
                h = hashlib.blake2b(m[0].encode(), digest_size=2).digest()
                if (score := 0.5 + h[0] / 512) >= least:
                    rows.append((i, m[0], ("PER", "ORG", "LOC", "MISC")[h[1] % 4], score, m.start(), m.end()))
        return pd.DataFrame(rows, columns=["id", "word", "kind", "score", "start", "end"])

    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(body).alias("text"))
    return apply_model(rows, lambda: model, "id long, word string, kind string, score double, start int, end int", 8)


def summary(body: Column, most: int = 160) -> Column:
    """Stand-in summary: whole sentences from the start, up to ``most`` characters."""
    return text.sentence_cut(body, most)


def rerank_score(score: Column, size: Column) -> Column:
    """Stand-in cross-encoder: overlap, less for long chunks."""
    return score - F.log(1 + size) / 100
