"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts over ``CHUNK`` code points are cut into chunks that overlap by
``OVERLAP``; chunks are pre-tokenised independently, each as if a text began
there, and stitched at the first position in the overlap where both chunks have
a pre-token boundary after a character that isn't white space: from there on
they agree, as matching looks only forward. Where no boundary resynchronises
(one pre-token longer than the overlap), the next chunk is tokenised again from
the last sure boundary. Then the pieces between such boundaries are encoded.
Chunks of texts up to ``GIANT`` code points stay in one task, without a shuffle;
those of longer texts are dealt to many tasks.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 12
OVERLAP = 1 << 8
GIANT = 1 << 20
LOOKAHEAD = 3  # code points that decide a pre-token's end: the longest contraction
FLUSH = 1 << 20


class Codec:
    """The vocabulary of a ranks file, with its pre-token pattern and no special tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.finditer = regex.compile(pattern).finditer
        #: text -> uint32 ids, each match of the pattern by itself
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def ends(self, text: str, at: int = 0) -> np.ndarray:
        """Pre-token boundaries that follow a character other than white space, as positions from ``at``."""
        return np.fromiter((m.end() for m in self.finditer(text) if not m[0][-1].isspace()), np.int64) + at

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(ranks: str, pattern: str) -> Codec:
    """``ranks``: an absolute path, or the name of a public vocabulary, which is looked up where this runs."""
    return Codec(ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks), pattern)


def stitch(chunks: list[tuple[int, str, np.ndarray]], own: Codec) -> list[str]:
    """(start, text, boundaries) of overlapping chunks, in order -> pieces that end at boundaries and make up the text."""
    pieces: list[str] = []
    start, text, ends = chunks[0]
    done = start  # a sure boundary: all before it is in pieces
    for nxt, more, his in chunks[1:]:
        limit = start + len(text)  # what ends near the chunk's own end might go on
        both = ends[(ends <= limit - LOOKAHEAD) & (ends >= nxt) & (ends > done)]
        both = both[(both == nxt) | np.isin(both, his)]
        if len(both):
            pieces.append(text[done - start : int(both[0]) - start])
            done = int(both[0])
            start, text, ends = nxt, more, his
        else:
            text = text[done - start :] + more[limit - nxt :]
            start, ends = done, own.ends(text, done)
    return [*pieces, text[done - start :]]


def cut(text: str, own: Codec, chunk: int, overlap: int) -> list[tuple[int, str, np.ndarray]]:
    """The overlapping chunks of a text that isn't empty: (start, text, boundaries)."""
    parts = [(s, text[s : s + chunk + overlap]) for s in range(0, len(text), chunk)]
    return [(s, part, own.ends(part, s)) for s, part in parts]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, ranks: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP, giant: int = GIANT) -> DataFrame:
    """The columns ``keep`` (default: all) and ``out`` array<int>: the ids of the whole text, without special tokens.

    Null and empty texts give no ids; an empty table gives no rows; each repeated row is a row of the result. A column
    named as ``out`` is replaced. Texts over ``giant`` code points are shuffled, each different one once.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    pattern = public_tokenizers.PATTERN
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for b in batches:
            texts, at, ids, size = b.column(b.num_columns - 1), 0, [], 0
            for i, t in enumerate(texts):
                t = t.as_py()
                ids.append(own.encode(t) if len(t) <= chunk else np.concatenate([own.encode(p) for p in stitch(cut(t, own, chunk, overlap), own)]))
                size += len(t)
                if size >= FLUSH or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(ids)) for c in b.columns[:-1]], _lists(ids)], [*keep, out])
                    at, ids, size = i + 1, [], 0

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for b in batches:
            starts = b.column(2).to_pylist()
            for i, t in enumerate(b.column(3)):
                ends = pa.array([own.ends(t.as_py(), starts[i]).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns], ends], ["k1", "k2", "start", "part", "ends"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        own = codec(ranks, pattern)
        pdf = pdf.drop_duplicates("start").sort_values("start")
        chunks = [(int(s), p, np.asarray(e)) for s, p, e in zip(pdf["start"], pdf["part"], pdf["ends"])]
        ids = np.concatenate([own.encode(p) for p in stitch(chunks, own)]).astype(np.int32)
        return pd.DataFrame({"k1": pdf["k1"].iloc[:1].to_numpy(), "k2": pdf["k2"].iloc[:1].to_numpy(), out: [ids]})

    is_long = F.length("__text") > giant
    done = rows.filter(~is_long).mapInArrow(short, schema)
    big = rows.filter(is_long).withColumns({"__k1": F.xxhash64("__text"), "__k2": F.xxhash64(F.lit(0x5EED), "__text")})
    texts = big.groupBy("__k1", "__k2").agg(F.min("__text").alias("t")).select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "t")
    parts = texts.select("k1", "k2", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.length("t").cast("long") - 1, F.lit(chunk).cast("long"))).alias("start"))
    parts = parts.select("k1", "k2", "start", F.col("t").substr((F.col("start") + 1).cast("int"), F.lit(chunk + overlap)).alias("part"))
    parts = parts.repartition("k1", "k2", "start").mapInArrow(boundaries, "k1 long, k2 long, start long, part string, ends array<long>")
    stitched = parts.groupBy("k1", "k2").applyInPandas(whole, T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField(out, T.ArrayType(T.IntegerType()))]))
    stitched = stitched.withColumnsRenamed({"k1": "__k1", "k2": "__k2", out: "__ids"})
    back = big.drop("__text").join(stitched, ["__k1", "__k2"])
    return done.unionByName(back.select(*[F.col(f"`{c}`") for c in keep], F.col("__ids").alias(out)))


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """All columns and ``out`` binary: the tokens' raw bytes, concatenated. Null ids give null."""
    pattern = public_tokenizers.PATTERN
    kept = [c for c in encoded.columns if c != out]
    schema = T.StructType([*encoded.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(out, T.BinaryType())])
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for b in batches:
            lists = b.column(at)
            flat, offs, valid = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            first, raw, size = 0, [], 0
            for i, ok in enumerate(valid):
                raw.append(own.decode(flat[offs[i] : offs[i + 1]].tolist()) if ok else None)  # row by row: Python's numbers take much memory
                size += len(raw[-1] or b"")
                if size >= FLUSH or i + 1 == len(valid):
                    yield pa.RecordBatch.from_arrays([*[c.slice(first, len(raw)) for c in b.columns], pa.array(raw, pa.binary())], [*kept, out])
                    first, raw, size = i + 1, [], 0

    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
