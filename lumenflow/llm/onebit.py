"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's direction is padded with zeros to ``CODE_BITS`` dimensions, rotated
at random and stored as the signs, packed, with two scalars: its norm, and the
inner product of the direction with its own code. A query is rotated likewise
and rounded to ``QUERY_BITS`` bits a dimension, stored as bit planes, so that
its inner product with a code is a weighted sum of the set bits of plane AND
code. Divided by the vector's scalar it estimates the inner product of query
and vector without bias; the error is below ``EPSILON * sqrt((1 - ip^2) / ip^2)
/ sqrt(CODE_BITS - 1)`` times both norms, and what the rounding adds, except
with small probability. Vectors whose upper bound reaches the k-th best exact
score so far are reranked on the original vectors in double precision.

Vectors lie in blocks, dealt by a hash of id and vector; each is shuffled once.
Queries travel to every block and stream past it, so a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.session import durable

CODE_BITS = 256
QUERY_BITS = 4
EPSILON = 3.0
SEED = 11
FIRST = 4  # times k: how many of the best estimates are scored first
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 8192, 65536, 64


def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(bits, dim) with orthonormal columns: zero padding followed by a random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def bits_for(dim: int, bits: int = CODE_BITS) -> int:
    return max(bits, -(-dim // 64) * 64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, dim) nonzero -> packed codes (n, bits / 8), norms, inner products of directions and codes."""
    top = np.abs(vectors).max(axis=1)
    norm = np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1)) * top
    bits = bits_for(vectors.shape[1])
    turned = (vectors / norm[:, None]) @ rotation(vectors.shape[1], bits).T
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(bits)


def valid(vector: Column) -> Column:
    """Not null, not empty or zero, no null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, id, dim, vector array<double>, code binary, norm, ip) for every vector that takes part; rows alike in id and
    vector count once, ``row`` is a hash of both. Null ids take no part."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.filter(F.col("id").isNotNull() & valid(F.col("vector"))).distinct()
    rows = own.select(F.xxhash64("id", "vector").alias("row"), "id", F.size("vector").alias("dim"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                codes, norm, ip = encode(part.column(3).flatten().to_numpy().reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(ip)], ["row", "id", "dim", "vector", "code", "norm", "ip"])

    return rows.mapInArrow(run, "row long, id long, dim int, vector array<double>, code binary, norm double, ip double")


class Block:
    """Indexed vectors, ordered by id, against which queries are searched."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, ip: np.ndarray, epsilon: float = EPSILON):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.bits = codes.shape[1] * 8
        #: (words, vectors): packed signs; sums over 64 dimensions are one AND and one bit count
        self.words = np.ascontiguousarray(codes[order].view(np.uint64).T)
        self.ones = np.bitwise_count(self.words).sum(axis=0, dtype=np.int32)
        norm, ip = norm[order], ip[order]
        self.scale = norm / (ip * np.sqrt(self.bits))
        self.slack = epsilon * np.sqrt(np.maximum(1 - ip * ip, 0)) / ip / np.sqrt(self.bits - 1) * norm
        self.rounding = epsilon / np.sqrt(12) / ip * norm
        self.turn = rotation(vectors.shape[1], self.bits).T

    def estimates(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, what they may lack)."""
        turned = query @ self.turn
        low, steps = turned.min(), (1 << QUERY_BITS) - 1
        step = (turned.max() - low) / steps or 1.0
        level = np.rint((turned - low) / step).astype(np.uint8)
        total = np.zeros(len(self.ids), np.uint16 if self.bits << QUERY_BITS <= 1 << 16 else np.uint32)
        for j in range(QUERY_BITS):
            plane = np.packbits(level >> j & 1).view(np.uint64)
            for w in range(0, len(plane), 3):  # counts of three words fit in a byte
                count = np.bitwise_count(self.words[w] & plane[w])
                for x in range(w + 1, min(w + 3, len(plane))):
                    count += np.bitwise_count(self.words[x] & plane[x])
                total += count.astype(total.dtype) << j
        # signs are 2 bit - 1, coordinates low + step level
        dot = 2 * (low * self.ones + step * total) - (low * self.bits + step * int(level.sum()))
        return dot * self.scale, self.slack * np.sqrt(turned @ turned) + self.rounding * step

    def search(self, row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the block's other rows by exact score, ties by id: (ids, scores)."""
        est, lack = self.estimates(query)
        mine, n = np.flatnonzero(self.rows == row), min(FIRST * (k + 1), len(est))
        est[mine] = -np.inf  # the query itself
        best = np.argpartition(est, len(est) - n)[len(est) - n :]
        rough = self.vectors[best] @ query
        rough[np.isneginf(est[best])] = -np.inf
        if n > k + len(mine):
            least = np.partition(rough, n - k)[n - k]
            chosen = np.flatnonzero(est + lack >= least - 1e-9 * (1 + abs(least)))
        else:
            chosen = np.flatnonzero(self.rows != row)
        # equal vectors may differ in a product's last bits, so the k best are found roughly and scored row by row
        rough = self.vectors[chosen] @ query
        if len(chosen) > k:
            least = np.partition(rough, len(chosen) - k)[len(chosen) - k]
            chosen = chosen[rough >= least - 1e-9 * (1 + abs(least))]
        exact = (self.vectors[chosen] * query).sum(axis=1)
        order = np.lexsort((self.ids[chosen], -exact))[:k]
        return self.ids[chosen][order], exact[order]


def search(index: DataFrame, is_query: Column, k: int = 20, block: int | None = None) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best of all indexed vectors of the query's length, but itself.

    ``is_query``: a condition on ``id``. An id that repeats asks once for each of its different vectors. Ties go to
    smaller ids. ``index`` is written to shared storage once. ``block``: vectors a task; by default as many as make
    BLOCKS blocks, within LEAST_BLOCK and MOST_BLOCK. Each query meets each block, so work grows with the product of
    both counts; an empty index gives no rows.
    """
    index = durable(index.withColumn("asks", F.coalesce(is_query, F.lit(False))))
    n = index.count()
    size = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    n_blocks = max(1, -(-n // size))
    base = index.select("dim", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "row", "id", "vector", "code", "norm", "ip")
    ask = index.filter("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("asks"), "row", "id", "vector", F.lit(b"").alias("code"), F.lit(0.0).alias("norm"), F.lit(0.0).alias("ip"))
    dealt = base.unionByName(ask).repartition(n_blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    names = ["query_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, own = None, [], None

        def block_of(parts: list[pa.RecordBatch], dim: int) -> Block | None:
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
            if t is None:
                return None
            codes = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(t.num_rows, -1)
            return Block(t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).flatten().to_numpy().reshape(-1, dim), codes, t.column(7).to_numpy(), t.column(8).to_numpy())

        for b in batches:
            dims, blocks, asks = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if a == z:
                    continue
                dim, piece = int(dims[a]), b.slice(a, z - a)
                if (now := (dim, int(blocks[a]))) != key:
                    key, parts, own = now, [], None
                if not asks[a]:
                    parts.append(piece)
                    continue
                if own is None and parts:
                    own, parts = block_of(parts, dim), []
                if own is None:
                    continue
                rows, ids = piece.column(3).to_numpy(), piece.column(4).to_numpy()
                found = [own.search(int(r), v, k) for r, v in zip(rows, piece.column(5).flatten().to_numpy().reshape(-1, dim))]
                counts = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, counts)), pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names)

    near = dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
