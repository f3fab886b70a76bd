"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits are compared in blocks. A block stores its fingerprints
vertically: one bit string for each of the 64 bit positions, 64 fingerprints to
a machine word. For a query, the bit strings that differ from it are added up
by carry-save counters, so that one word operation advances 64 distances, and
64 fingerprints are abandoned once all their distances exceed the radius.

Blocks come from the pigeonhole principle: of ``pieces`` bit ranges at least
pieces - radius are equal in two fingerprints within the radius, so every
linked pair meets in a bucket of equal ranges. The number of pieces follows the
number of fingerprints, so that a bucket's expected size stays below ``CHUNK``:
5 pieces (5 keys of 12 bits and more) up to some 10 million fingerprints, 6
(15 keys of 20 bits) up to billions, and so on; all choices give the same
links. Buckets that are larger still are dealt out as pairs of chunks, so no
task holds a bucket whole; each block hands on a spanning forest of its links,
never all pairs.

64 bits tell near copies apart only roughly. ``wide_fingerprints`` have 64 bits
a lane, over sets of shingles, so that the share of differing bits estimates the
angle between two sets closely, and a radius stands for a Jaccard similarity.
Pairs meet where they agree in one of several tables of sampled bits; their
number and size follow the number of fingerprints and the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.operators.components import components
from lumenflow.operators.joins import split_join
from lumenflow.session import durable

SHINGLE = 4
RADIUS = 4
CHUNK = 4096
SLAB = 512
LANES = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.99  # of pairs at the similarity asked for: the share that meets in a table
MEET = 1024  # expected fingerprints a bucket of a table
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit k is set if it is set in over half the XXH64 hashes (seed 42) of the word shingles, repeats
    included. A-Z count as a-z, words are split at ASCII white space; fewer words make one shingle; none make 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    hash_ = xxhash.xxh64_intdigest
    h = np.array([hash_(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, the long columns ``keep``): the fingerprint of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["id", "fp", *keep])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", *keep)))


def ranges(pieces: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``pieces`` ranges that cover 64 bits."""
    cuts = [round(64 * i / pieces) for i in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def pieces_for(n: int, radius: int = RADIUS, chunk: int = CHUNK) -> int:
    """The least number of ranges with which ``n`` random fingerprints fill buckets of ``chunk`` at most."""
    for pieces in range(radius + 1, 64):
        bits = sum(sorted(size for _, size in ranges(pieces))[: pieces - radius])
        if n <= chunk << bits:
            return pieces
    return 64


def planes(fps: np.ndarray) -> np.ndarray:
    """(n,) or (n, lanes) -> (64 a lane, words) bit planes: bit j of word w of plane k is bit k of fingerprint 64 w + j;
    padding is 0."""
    fps = fps.reshape(len(fps), -1)
    words = -(-len(fps) // 64)
    padded = np.zeros((words * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder on every bit: (sum, carry)."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def within(queries: np.ndarray, block: np.ndarray, size: int, radius: int = RADIUS, skip: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """(len(queries), words) bit matrix: which of the block's ``size`` fingerprints lie within ``radius`` of each query.

    ``block``: from planes(); ``skip``: bit ranges known to be equal. Planes are taken eight at a time: full adders
    compress their differences and the counters' three lowest bits, so that one carry for eight planes ripples on.
    A query's words of 64 fingerprints are abandoned once all 64 exceed the radius; the last of the eight planes are zeros
    where too few are left.
    """
    words = block.shape[1]
    found = np.zeros((len(queries), words), np.uint64)
    if not len(queries) or not size:
        return found
    q = queries.reshape(len(queries), -1)
    cells = None  # (query, word) of what is still compared, once most are abandoned
    counter = [np.zeros((len(q), words), np.uint64) for _ in range(max(3, (radius + 1).bit_length()))]
    over = np.zeros((len(q), words), np.uint64)
    tail = size % 64
    if tail:
        over[:, -1] = _ONES << np.uint64(tail)
    order = [k for k in range(len(block)) if not any(a <= k < a + n for a, n in skip)]

    def differs(at: int) -> np.ndarray:
        if at >= len(order):
            return np.zeros_like(over)
        k = order[at]
        mask = np.uint64(0) - ((q[:, k >> 6] >> np.uint64(k & 63)) & np.uint64(1))
        return block[k][None, :] ^ mask[:, None] if cells is None else block[k][cells[1]] ^ mask[cells[0]]

    def above() -> np.ndarray:
        """Counters above the radius, bit by bit from the lowest."""
        gt = np.zeros_like(over)
        for i, c in enumerate(counter):
            gt = (c & gt) if radius >> i & 1 else (c | gt)
        return gt

    for step in range(0, len(order), 8):
        fours = []
        for at in (step, step + 4):
            counter[0], low = _add(counter[0], differs(at), differs(at + 1))
            counter[0], high = _add(counter[0], differs(at + 2), differs(at + 3))
            counter[1], carry = _add(counter[1], low, high)
            fours.append(carry)
        counter[2], carry = _add(counter[2], *fours)
        for i in range(3, len(counter)):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        over |= carry
        if step + 8 >= 2 * radius:
            over |= above()
            live = over != _ONES
            n = np.count_nonzero(live)
            if not n:
                return found
            if n * (4 if cells is None else 2) <= live.size:
                cells = np.nonzero(live) if cells is None else tuple(c[live] for c in cells)
                over, counter = over[live], [c[live] for c in counter]
    over |= above()
    found[... if cells is None else cells] = ~over
    return found


def _forest(fps: np.ndarray, left: int, radius: int, skip: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links in ``fps``: among all of them if left is 0, else between the
    first ``left`` and the rest."""
    block_at = left
    block = planes(fps[block_at:])
    label = np.arange(len(fps))
    us, vs = [], []
    for at in range(0, left or len(fps), SLAB):
        queries = fps[at : at + SLAB] if not left else fps[at : min(at + SLAB, left)]
        first = left or at  # earlier ones of the same block have met these queries; SLAB is whole words
        hit = within(queries, block[:, (first - block_at) // 64 :], len(fps) - first, radius, skip)
        for r in np.flatnonzero(np.bitwise_count(hit).sum(axis=1, dtype=np.int64) > (0 if left else 1)):
            i = at + r
            js = np.flatnonzero(np.unpackbits(hit[r].view(np.uint8), bitorder="little")) + first
            other = label[js]
            new, where = np.unique(other[other != label[i]], return_index=True)
            if len(new):
                js = js[other != label[i]][where]
                us += [i] * len(js)
                vs += js.tolist()
                label[np.isin(label, new)] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, pieces: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp long) -> (u, v): links within ``radius`` whose components are exactly those of all links."""
    pieces = pieces or pieces_for(distinct.count(), radius, chunk)
    cut = list(combinations(ranges(pieces), pieces - radius))

    def key(equal: tuple[tuple[int, int], ...]) -> Column:
        out = F.lit(0).cast("long")
        for a, n in equal:
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)))
        return out

    rows = distinct.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("t"), key(equal).alias("b")) for i, equal in enumerate(cut)])))
    return _compared(rows, 1, radius, chunk, lambda t: cut[t])


def _compared(rows: DataFrame, lanes: int, radius: int, chunk: int, skip: Callable[[int], tuple[tuple[int, int], ...]]) -> DataFrame:
    """Buckets (t, b, fp) -> (u, v): a spanning forest of each block's links. ``skip``: bits that are equal in table t."""
    kind = rows.schema["fp"].dataType.simpleString()
    sizes = rows.groupBy("t", "b").count().filter("count > 1")  # a bucket of one holds no pair
    rows = split_join(rows, sizes, ["t", "b"]).withColumn("c", F.ceil(F.col("count") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    # chunk i of c meets every chunk j >= i in block (i, j)
    meets = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j"), (F.lit(0) + (F.col("i") > j).cast("int")).alias("side")))
    rows = rows.withColumn("i", mine).withColumn("meets", meets).select("t", "b", "fp", F.inline("meets"))
    dealt = rows.repartition("t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(fps: np.ndarray, left: int, equal: tuple[tuple[int, int], ...]) -> pa.RecordBatch | None:
            us, vs = _forest(fps, left, radius, equal)
            if not len(us):
                return None
            if kind == "bigint":
                ends = [pa.array(fps[x, 0].view(np.int64)) for x in (us, vs)]
            else:
                ends = [pa.array([f.tobytes() for f in fps[x]], pa.binary()) for x in (us, vs)]
            return pa.RecordBatch.from_arrays(ends, ["u", "v"])

        def matrix(b: pa.RecordBatch) -> np.ndarray:
            if kind == "bigint":
                return b.column(5).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            return np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint64).reshape(-1, lanes)

        def blocks(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch | None]:
            """Blocks of whole buckets or pairs of chunks. Small neighbouring buckets of a table make one block: what else
            is compared there only finds links that hold."""
            if not len(fps):
                return
            change = np.flatnonzero((keys[:4, 1:] != keys[:4, :-1]).any(axis=0)) + 1
            cuts = [0, *change.tolist(), len(fps)]
            start = 0  # of the small buckets that wait
            for a, z in zip(cuts, cuts[1:]):
                own = keys[2, a] == keys[3, a]
                if start < a and (not own or keys[0, a] != keys[0, start] or z - start > SLAB):
                    yield block(fps[start:a], 0, skip(int(keys[0, start])) if (keys[1, start] == keys[1, start:a]).all() else ())
                    start = a
                if not own:
                    left = int(np.count_nonzero(keys[4, a:z] == 0))
                    if 0 < left < z - a:
                        yield block(fps[a:z], left, skip(int(keys[0, a])))
                    start = z
            if start < len(fps):
                yield block(fps[start:], 0, skip(int(keys[0, start])) if (keys[1, start] == keys[1, start:]).all() else ())

        keys, fps = np.zeros((5, 0), np.int64), np.zeros((0, lanes), np.uint64)
        for b in batches:
            keys = np.concatenate((keys, np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])), axis=1)
            fps = np.concatenate((fps, matrix(b)))
            change = np.flatnonzero((keys[:4, 1:] != keys[:4, :-1]).any(axis=0)) + 1
            whole = int(change[-1]) if len(change) else 0  # the last bucket may go on in the next batch
            yield from filter(None, blocks(keys[:, :whole], fps[:whole]))
            keys, fps = keys[:, whole:], fps[whole:]
        yield from filter(None, blocks(keys, fps))

    return dealt.select("t", "b", "i", "j", "side", "fp").mapInArrow(run, f"u {kind}, v {kind}")


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, lanes: int = LANES) -> np.ndarray:
    """``lanes`` words of 64 bits: a bit is set if it is set in over half the hashes of the text's different word shingles.
    Words as in fingerprint(); fewer words make one shingle; none make zeros."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(lanes, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(w))):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    h = np.unique(h)
    counts = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(h), 1 << 16):
        own = h[at : at + (1 << 16)]
        x = own[None, :] + (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        starts = np.arange(0, len(own), 255)  # so many ones fit in a byte
        for k in range(8):
            sums = np.add.reduceat((x >> np.uint64(k)) & np.uint64(0x0101010101010101), starts, axis=1)
            counts[:, k::8] += sums.view(np.uint8).reshape(lanes, len(starts), 8).sum(axis=1, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def wide_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = WIDE_SHINGLE, lanes: int = LANES, keep: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """(id, fp binary, the long columns ``keep``): the wide fingerprint of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [wide_fingerprint(t.as_py(), shingle, lanes).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), *b.columns[2:]], ["id", "fp", *keep])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *keep)
    return source.mapInArrow(run, "id long, fp binary" + "".join(f", {c} long" for c in keep))


def share_of(similarity: float) -> float:
    """The share of bits that differ, on average, in two sets of this Jaccard similarity (and about equal size)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float = SIMILARITY, lanes: int = LANES) -> int:
    """Differing bits that a pair of this similarity stays within but for two standard deviations."""
    n, s = 64 * lanes, share_of(similarity)
    return int(n * s + 2 * math.sqrt(n * s * (1 - s)))


def tables_for(n: int, similarity: float = SIMILARITY, recall: float = RECALL, meet: int = MEET) -> tuple[int, int]:
    """(sampled bits, tables) for ``n`` fingerprints: a pair of this similarity meets in a table with the probability ``recall``."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / meet)))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - share_of(similarity)) ** bits)) if bits else 1


def wide_links(distinct: DataFrame, similarity: float = SIMILARITY, lanes: int = LANES, chunk: int = CHUNK, meet: int = MEET) -> DataFrame:
    """Distinct wide fingerprints (fp binary) -> (u, v): links within radius_for(similarity) of pairs that meet in a table."""
    bits, tables = tables_for(distinct.count(), similarity, meet=meet)
    rng = np.random.default_rng(64)
    sampled = [np.sort(rng.choice(64 * lanes, bits, replace=False)) for _ in range(tables)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            ones = np.unpackbits(raw, axis=1, bitorder="little")
            for t, at in enumerate(sampled):
                key = ones[:, at].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key), b.column(0)], ["t", "b", "fp"])

    rows = distinct.select("fp").mapInArrow(listed, "t int, b long, fp binary")
    return _compared(rows, lanes, radius_for(similarity, lanes), chunk, lambda t: tuple((int(k), 1) for k in sampled[t]))


def groups(own: DataFrame, find: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """Rows (id, fp) in shared storage -> (fp, root, component_id) for every fingerprint. ``root`` names the component;
    ``component_id`` is its smallest id, null where all its ids are. ``find``: links() or wide_links()."""
    least = durable(own.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(find(least.select("fp")))
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = durable(grouped)
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return split_join(grouped, names, ["root"]).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id reachable over links of
    at most ``radius`` differing bits.

    Null and blank texts have fingerprint 0 and are linked like any others. Null ids belong to their component but
    never name it (a component of null ids only has a null one). Rows may repeat; other columns are ignored; ids are
    read as long numbers (others fail, or are null where the session isn't strict); an empty table gives no rows.
    """
    own = durable(fingerprints(docs, id_col, text_col, shingle))
    out = own.join(groups(own, lambda distinct: links(distinct, radius)), "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
