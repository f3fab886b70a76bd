"""Removal of repeated byte strings by depth-limited radix sorting of suffixes.

A string of ``SPAN`` bytes goes where it also starts in a document with a
smaller id. Equal strings are found by sorting suffixes through SPAN bytes
only, most significant digit (8 bytes) first: after each pass suffixes without
an equal are dropped, and the groups left after the last are exactly the
repeated strings.

Suffixes are dealt to sorters by their minimiser, the least hash of the GRAM-byte
strings inside their first SPAN bytes: equal strings have equal minimisers, and
about 14 neighbouring suffixes share one, so they travel as one piece of text
(a run). Runs are sent only if their minimiser occurs in two documents, which a
first exchange of 5 bytes a run finds out (chance agreements there cost time,
not correctness). Documents are packed into compressed units in shared storage;
a unit sends each different run once, with its least document id, and gets back
one bit a suffix, so what a sorter holds of one string grows with the number of
units, not of documents. A minimiser that very many units hold, as a popular
phrase gives it in ever different surroundings, does not go to one sorter: its
runs are cut and dealt by the second least hash inside each suffix. Two
exchanges (which minimisers are shared; which strings occur in a smaller
document) are answered unit by unit. Sizes of units and sorters follow the
text's total size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.session import durable

SPAN = 50
GRAM = 24
UNIT_BYTES = 4 << 20, 64 << 20  # the total divided by UNITS, within these bounds
UNITS = 1 << 15
PARTITIONS = 256
PARTITION_BYTES = 16 << 20, 64 << 20  # likewise, by SORTERS
SORTERS = 1 << 13
POPULAR = 64  # units that hold a minimiser
SEGMENT = 1 << 17
NO_ID = np.iinfo(np.int64).max

_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {k: np.uint64(pow(int(_B), k, 1 << 64)) for k in (1, 2, 4, 8)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """For each position with GRAM bytes from it on, the hash of these."""
    h = {1: raw.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8):
        h[2 * k] = h[k][:-k] * _POWERS[k] + h[k][k:]
    return _mix(h[16][:-8] * _POWERS[8] + h[8][16:])


def second_minimisers(raw: np.ndarray, span: int = SPAN) -> np.ndarray:
    """As minimisers(), but the least hash above the minimiser; all bits set where there is none."""
    low, width, k = gram_hashes(raw), span - GRAM + 1, 1
    high = np.full(len(low), np.iinfo(np.uint64).max)

    def both(step: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = low[:-step], low[step:], high[:-step], high[step:]
        return np.minimum(a, b), np.where(a == b, np.minimum(c, d), np.where(a < b, np.minimum(c, b), np.minimum(a, d)))

    while 2 * k <= width:
        (low, high), k = both(k), 2 * k
    return both(width - k)[1] if width > k else high


def minimisers(raw: np.ndarray, span: int = SPAN) -> np.ndarray:
    """For each position with ``span`` bytes from it on: the least hash of the GRAM-byte strings in these."""
    low = gram_hashes(raw)
    width, k = span - GRAM + 1, 1
    while 2 * k <= width:
        low, k = np.minimum(low[:-k], low[k:]), 2 * k
    return np.minimum(low[: len(low) - (width - k)], low[width - k :]) if width > k else low


def runs(raw: np.ndarray, lengths: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, suffixes, document number, hash) of each run of neighbouring suffixes of one document with one minimiser."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(raw) - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    cuts = [np.concatenate((starts, np.maximum(ends - span + 1, starts)))]
    values = []
    for a in range(0, n, SEGMENT):
        z = min(n, a + SEGMENT)
        m = minimisers(raw[a : z + span - 1], span)
        at = np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1))
        cuts.append(at + a)
        values.append((a, m))
    cut = np.unique(np.concatenate(cuts))
    cut = cut[cut < n]
    size = np.diff(np.append(cut, n))
    doc = np.searchsorted(starts, cut, "right") - 1
    # among empty documents at one position the last is found, which is the one that may hold bytes
    fits = cut + span <= ends[doc]
    cut, size, doc = cut[fits], size[fits], doc[fits]
    hashes = np.empty(len(cut), np.uint64)
    bounds = np.searchsorted(cut, [a for a, _ in values] + [n])
    for (a, m), lo, hi in zip(values, bounds, bounds[1:]):
        hashes[lo:hi] = m[cut[lo:hi] - a]
    return cut, size, doc, _mix(hashes * _B)


class Unit:
    """Documents packed together, with their runs dealt to ``parts`` sorters."""

    def __init__(self, ids: bytes, lengths: bytes, body: bytes, parts: int, span: int):
        self.ids, self.lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths, np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.lengths.sum()) or 1) if self.lengths.sum() else b""
        self.raw, self.span, self.n_parts = np.frombuffer(self.text, np.uint8), span, parts
        self.at, self.size, self.doc, h = runs(self.raw, self.lengths, span)
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        key = part << np.uint64(40) | (h & np.uint64((1 << 40) - 1))
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(key) else np.zeros(0, bool)
        self.keys = sorted_[new]
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.cumsum(new) - 1
        other = np.zeros(len(key), bool)
        who = self.ids[self.doc[order]]
        other[1:] = ~new[1:] & (who[1:] != who[:-1])
        self.several = np.logical_or.reduceat(other, np.flatnonzero(new)) if len(key) else other
        self.parts, counts = np.unique(self.keys >> np.uint64(40), return_counts=True)
        self.bounds = np.concatenate(([0], np.cumsum(counts)))

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """(sorter, its keys with their several-documents bits)."""
        for p, a, z in zip(self.parts.tolist(), self.bounds, self.bounds[1:]):
            five = np.ascontiguousarray(self.keys[a:z]).view(np.uint8).reshape(-1, 8)[:, :5]
            yield p, five.tobytes() + np.packbits(self.several[a:z]).tobytes()

    def share(self, answers: dict[int, bytes]) -> None:
        """Take the first answers; then ``sent`` holds, for each sorter, the different shared runs and their least ids."""
        shared, popular = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        for p, a, z in zip(self.parts.tolist(), self.bounds, self.bounds[1:]):
            both = np.unpackbits(np.frombuffer(answers[p], np.uint8)).astype(bool)
            shared[a:z], popular[a:z] = both[: z - a], both[len(both) // 2 :][: z - a]
        runs_ = np.flatnonzero(shared[self.which] & ~popular[self.which])
        found = [(self.at[runs_], self.size[runs_], self.doc[runs_], (self.keys[self.which[runs_]] >> np.uint64(40)).astype(np.int64))]
        found.append(self._dealt_again(np.flatnonzero(shared[self.which] & popular[self.which])))
        at, size, doc, part = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(part, kind="stable")
        self.my_at, self.my_size, self.my_doc, part = at[order], size[order], doc[order], part[order]
        at, stop = self.my_at, self.my_at + self.my_size + (self.span - 1)
        text, seen = self.text, {}
        bodies, content, parts = [], np.empty(len(at), np.int64), part.tolist()
        for i, (a, z) in enumerate(zip(at.tolist(), stop.tolist())):
            body = text[a:z]
            content[i] = k = seen.setdefault((parts[i], body), len(bodies))
            if k == len(bodies):
                bodies.append(body)
        self.content = content
        least = np.full(len(bodies), NO_ID, np.int64)
        np.minimum.at(least, content, self.ids[self.my_doc])
        self.least = least
        firsts = np.zeros(len(bodies), np.int64)
        firsts[content[::-1]] = part[::-1]
        self.sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        found, a = np.unique(firsts, return_index=True)
        self.sent = [(int(p), int(i), int(j), bodies[i:j]) for p, i, j in zip(found, a, [*a[1:], len(bodies)])]

    def _dealt_again(self, runs_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first positions, suffixes, documents, sorters) of the runs, cut where their second minimisers change."""
        if not len(runs_):
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        size = self.size[runs_]
        wide = size + (self.span - 1)
        starts = np.cumsum(wide) - wide
        here = np.arange(int(wide.sum())) - np.repeat(starts, wide) + np.repeat(self.at[runs_], wide)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        second = second_minimisers(self.raw[here], self.span)[np.repeat(starts, size) + inner]
        cut = np.flatnonzero((inner == 0) | np.concatenate(([True], second[1:] != second[:-1])))
        part = ((_mix(second[cut] * _B) >> np.uint64(32)) * np.uint64(self.n_parts)) >> np.uint64(32)
        return (np.repeat(self.at[runs_], size) + inner)[cut], np.diff(np.append(cut, len(inner))), np.repeat(self.doc[runs_], size)[cut], part.astype(np.int64)

    def offered(self) -> Iterator[tuple[int, bytes]]:
        """(sorter, its contents): number, lengths, least ids and texts, compressed."""
        for p, i, j, bodies in self.sent:
            sizes, ids = self.sizes[i:j].astype(np.int32).tobytes(), self.least[i:j].tobytes()
            yield p, zstandard.ZstdCompressor(level=1).compress(b"".join([(j - i).to_bytes(8, "little"), ids, sizes, *bodies]))

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Take the second answers (a bit for each suffix of each content) -> the bytes that go."""
        windows = self.sizes - (self.span - 1)
        base = np.cumsum(windows) - windows
        bits = np.zeros(int(windows.sum()), bool)
        for p, i, j, _ in self.sent:
            a, n = int(base[i]), int(windows[i:j].sum())
            bits[a : a + n] = np.unpackbits(np.frombuffer(answers[p], np.uint8), count=n)
        size, at = self.my_size, self.my_at
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        gone = bits[np.repeat(base[self.content], size) + inner] | np.repeat(self.ids[self.my_doc] > self.least[self.content], size)
        first = (np.repeat(at, size) + inner)[gone]
        n = len(self.raw)
        change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + self.span, minlength=n + 1)[: n + 1]
        return np.cumsum(change[:n]) > 0


def read_offer(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(lengths, least ids, texts)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64), np.frombuffer(raw, np.int64, n, 8), raw[8 + 12 * n :]


def radix_groups(text: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes that start at ``at``, through ``span`` bytes -> (suffix numbers,
    ordered by group; group starts): the suffixes whose first span bytes occur twice or more, equal ones together."""
    words = np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text), strides=(1,))
    left, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    starts = np.zeros(0, np.int64)
    for offset in sorted({*range(0, span - 7, 8), span - 8}):
        if not len(left):
            break
        values, digit = np.unique(words[at[left] + offset].astype(np.uint64), return_inverse=True)
        key = group * len(values) + digit
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        count = np.diff(np.append(np.flatnonzero(first), len(key)))
        kept = np.repeat(count > 1, count)
        left = left[order][kept]
        count = count[count > 1]
        starts = np.cumsum(count) - count
        group = np.repeat(np.arange(len(count)), count)
    return left, starts


def answer_offers(offers: list[bytes], span: int = SPAN) -> list[bytes]:
    """One bit for each suffix of each content of each offer: whether it occurs under an id smaller than the content's."""
    parsed = [read_offer(o) for o in offers]
    seen: dict[bytes, int] = {}
    least: list[int] = []
    numbers = []
    for sizes, ids, body in parsed:
        own, a = [], 0
        for size, ident in zip(sizes.tolist(), ids.tolist()):
            piece = body[a : a + size]
            a += size
            k = seen.setdefault(piece, len(least))
            if k == len(least):
                least.append(ident)
            elif ident < least[k]:
                least[k] = ident
            own.append(k)
        numbers.append(np.array(own, np.int64))
    text = np.frombuffer(b"".join(seen) + b"\0" * 8, np.uint8)
    length = np.fromiter(map(len, seen), np.int64, len(seen))
    windows = length - (span - 1)
    base = np.cumsum(windows) - windows
    at = np.arange(int(windows.sum())) + np.repeat(np.arange(len(windows)) * (span - 1), windows)
    smallest = np.repeat(np.array(least, np.int64), windows)
    members, starts = radix_groups(text, at, span)
    if len(members):
        low = np.minimum.reduceat(smallest[members], starts)
        smallest[members] = np.repeat(low, np.diff(np.append(starts, len(members))))
    out = []
    for (_, ids, _), own in zip(parsed, numbers):
        n = windows[own]
        where = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base[own], n)
        out.append(np.packbits(smallest[where] < np.repeat(ids, n)).tobytes())
    return out


def pack_units(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int) -> DataFrame:
    """(unit, n_bytes, ids, lengths, body): documents packed to about ``unit_bytes``, texts compressed; a unit holds whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def unit() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            cols = [[number], [int(lengths.sum())], [np.array(ids, np.int64).tobytes()], [lengths.tobytes()], [body]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["unit", "n_bytes", "ids", "lengths", "body"])

        for b in batches:
            for ident, t in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (t.as_py() or "").encode("utf-8")
                ids.append(NO_ID if ident is None else ident)
                texts.append(raw)
                held += len(raw) + 64
                if held >= unit_bytes:
                    yield unit()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield unit()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "unit long, n_bytes long, ids binary, lengths binary, body binary")


def sizes_for(total: int, partitions: int = PARTITIONS) -> tuple[int, int]:
    """(bytes a unit, number of sorters) for ``total`` bytes of text."""
    unit, part = (min(most, max(least, total // n)) for (least, most), n in ((UNIT_BYTES, UNITS), (PARTITION_BYTES, SORTERS)))
    return unit, max(partitions, -(-total // part))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, unit_bytes: int | None = None, partitions: int = PARTITIONS, popular: int = POPULAR) -> DataFrame:
    """(doc_id, n_bytes, removed array<struct<start,end>> in bytes, kept binary) for every row.

    ``span``: 32 to 1000 bytes. Null texts count as empty; texts under ``span`` bytes stay. Null ids count as greater
    than all others. Rows with one id don't remove each other's strings. What is kept may split a character, so it is
    binary. Other columns are ignored; an empty table gives no rows. A text is never split over tasks: one of n bytes
    needs some 60 n bytes of a task's memory.
    """
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    size, parts = sizes_for(total, partitions)
    units = durable(pack_units(docs, id_col, text_col, unit_bytes or size))
    columns = ["unit", "ids", "lengths", "body"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, ids, lengths, body in zip(*[b.column(c).to_pylist() for c in columns]):
                rows = list(Unit(ids, lengths, body, parts, span).asked())
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "unit", "blob"])

    def is_shared(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, several, counts = [], [], []
        for blob in pdf["blob"]:
            n = next(k for k in range(len(blob) * 8 // 41, -1, -1) if 5 * k + -(-k // 8) <= len(blob))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n).reshape(n, 5)
            keys.append(wide.reshape(-1).view(np.uint64))
            several.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=5 * n), count=n).astype(bool))
            counts.append(n)
        _, which, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared, often = seen > 1, seen > popular
        shared[which[np.concatenate(several)]] = True
        cuts = np.cumsum(counts)[:-1]
        return pd.DataFrame({"unit": pdf["unit"].to_numpy(), "step": 1, "part": pdf["part"].to_numpy(), "blob": [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared[which], cuts), np.split(often[which], cuts))]})

    def answers(right: pd.DataFrame, step: int) -> dict[int, bytes]:
        own = right[right["step"] == step]
        return dict(zip(own["part"].tolist(), own["blob"]))

    def offer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for number, ids, lengths, body in left[columns].itertuples(index=False):
            unit = Unit(ids, lengths, body, parts, span)
            unit.share(answers(right, 1))
            rows += [(p, number, blob) for p, blob in unit.offered()]
        return pd.DataFrame(rows, columns=["part", "unit", "blob"]).astype({"part": "int64", "unit": "int64"})

    def sort_part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        return pd.DataFrame({"unit": pdf["unit"].to_numpy(), "step": 2, "part": pdf["part"].to_numpy(), "blob": answer_offers(list(pdf["blob"]), span)})

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids_out, sizes, removed, kept = [], [], [], []
        for _, ids, lengths, body in left[columns].itertuples(index=False):
            unit = Unit(ids, lengths, body, parts, span)
            unit.share(answers(right, 1))
            gone = unit.removed(answers(right, 2))
            at = 0
            for ident, size in zip(unit.ids.tolist(), unit.lengths.tolist()):
                own = gone[at : at + size]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2) if own.any() else np.zeros((0, 2), np.int64)
                ids_out.append(ident)
                sizes.append(size)
                removed.append([{"start": int(a), "end": int(z)} for a, z in edges])
                kept.append(unit.raw[at : at + size][~own].tobytes() if len(edges) else unit.text[at : at + size])
                at += size
        return pd.DataFrame({"doc_id": pd.array([None if x == NO_ID else x for x in ids_out], dtype="Int64"), "n_bytes": np.array(sizes, np.int64), "removed": removed, "kept": kept})

    reply = "unit long, step int, part long, blob binary"
    first = durable(units.select(*columns).mapInArrow(ask, "part long, unit long, blob binary").groupBy("part").applyInPandas(is_shared, reply))
    offers = units.select(*columns).groupBy("unit").cogroup(first.groupBy("unit")).applyInPandas(offer, "part long, unit long, blob binary")
    second = durable(offers.groupBy("part").applyInPandas(sort_part, reply))
    both = first.unionByName(second)
    return units.select(*columns).groupBy("unit").cogroup(both.groupBy("unit")).applyInPandas(finish, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
