"""Secret scanning through a trigram inverted index.

For each rule a Boolean query over trigrams is derived from its regular
expression: what a match must contain. Texts are indexed in blocks; the
postings of the queries' trigrams are intersected and united as the query
says, and only the candidate texts are matched. Rules without a mandatory
trigram match every text. Trigrams are taken over ASCII-lower-cased UTF-8
bytes, so letters in either case share postings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose group ``group`` is under ``least`` long are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # as runs are matched whole, the same as [0-9a-f]+ of 24 and more
)
#: what looks behind starts a match at a run's first character only, so that long runs take linear time
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"Bearer [A-Za-z0-9._~+/=-]+", 0, 27),
    Rule("url_login", r"(?<![a-z])[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/]+@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: None (anything may match), or a set of alternatives, each a set of trigrams that must all occur.
Query = frozenset[frozenset[bytes]] | None


def _fold(s: set[str]) -> set[str]:
    return {"".join(c.lower() if c.isascii() else c for c in x) for x in s}


def _strings(op, arg) -> set[str] | None:
    """All strings that an element matches, folded, or None if they are many."""
    if op is C.LITERAL:
        return _fold({chr(arg)})
    if op is C.IN:
        out: set[str] = set()
        for kind, what in arg:
            if kind is C.LITERAL:
                out.add(chr(what))
            elif kind is C.RANGE and what[1] - what[0] < MOST_STRINGS:
                out |= {chr(x) for x in range(what[0], what[1] + 1)}
            else:
                return None
        out = _fold(out)
        return out if len(out) <= 4 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | {""} if arg[0] == 0 else inner
    if op is C.AT:
        return {""}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        own = _strings(op, arg)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _and(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else frozenset(x | y for x in a for y in b)


def _of_strings(found: set[str]) -> Query:
    parts = [frozenset(r[i : i + 3] for r in [s.encode()] for i in range(len(r) - 2)) for s in found]
    return None if not all(parts) else frozenset(parts)


def _query(items) -> Query:
    """What a run of elements must contain: strings of neighbouring elements are joined as far as they stay few."""
    out: Query = None
    run = {""}
    for op, arg in items:
        own = _strings(op, arg)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        out, run = _and(out, _of_strings(run)), own or {""}
        if own is None:
            inner: Query = None
            if op is C.SUBPATTERN:
                inner = _query(arg[3])
            elif op is C.BRANCH:
                parts = [_query(x) for x in arg[1]]
                inner = None if any(p is None for p in parts) else frozenset().union(*parts)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                inner = _query(arg[2])
            out = _and(out, inner)
    return _and(out, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; None if no trigram is mandatory."""
    return _query(_parser.parse(pattern))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.match = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.words = sorted({t for q in self.queries if q for alt in q for t in alt})
        self.number = {t: i for i, t in enumerate(self.words)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each indexed trigram, the ascending numbers of the texts that hold it."""
        raw = [t.encode().lower() for t in texts]
        joined = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
        bounds = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 2)
        ids = self.table[joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]]
        at = np.flatnonzero(ids >= 0)
        pairs = np.unique(ids[at].astype(np.int64) * len(raw) + np.searchsorted(bounds, at, "right"))
        cuts = np.searchsorted(pairs, np.arange(len(self.words) + 1) * len(raw))
        return [pairs[a:z] - i * len(raw) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]

    def candidates(self, texts: list[str]) -> list[list[int]]:
        """For each rule, the numbers of the texts that may match."""
        index, everyone, out = self.postings(texts), list(range(len(texts))), []
        for q in self.queries:
            if q is None:
                out.append(everyone)
                continue
            found: set[int] = set()
            for alt in q:
                lists = sorted((index[self.number[t]] for t in alt), key=len)
                own = lists[0]
                for other in lists[1:]:
                    own = np.intersect1d(own, other, assume_unique=True)
                found.update(own.tolist())
            out.append(sorted(found))
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text's spans, in order; code points."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, own, who) in enumerate(zip(self.rules, self.match, self.candidates(texts))):
            g, least = rule.group, rule.least
            for i in who:
                for m in own.finditer(texts[i]):
                    a, z = m.span(g)
                    if z - a >= least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``spans``, by start, then in the rules' order; ends are exclusive.

    Null and empty texts have no spans; rows that repeat get equal spans; an empty table gives no rows; a column named
    spans is replaced. The rules take time in proportion to the text. One pass, no shuffle; an index block holds
    about BLOCK_BYTES of text, or one longer text.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", T._parse_datatype_string(SPANS))])
    kinds = [r.kind for r in rules]
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for b in batches:
            at, block, held = 0, [], 0
            for i, t in enumerate(b.column(b.num_columns - 1)):
                block.append(t.as_py() or "")
                held += len(block[-1])
                if held >= BLOCK_BYTES or i + 1 == b.num_rows:
                    spans = [[{"kind": kinds[k], "start": a, "end": z} for a, k, z in x] for x in own.scan(block)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, len(block)) for c in b.columns[:-1]], pa.array(spans, span_type)], [*keep, "spans"])
                    at, block, held = i + 1, [], 0

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text")).mapInArrow(run, schema)
