"""What the registered queries return, column by column, against plain Python over a corpus with all edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lumenflow.llm import avi, bpe, langid, queries, secretscan, suffix

from .conftest import SCHEMA
from .test_ops import plain_components, plain_fingerprint, plain_line_dedup, plain_mix, plain_repeats, plain_shots

SECRETS = [
    (900, 'x = 1; Password: "hunter2secret" and api-key no; API_KEY=abcdef123', "en", "a", 0),
    (901, "AKIA" + "A1" * 10 + " AKIASHORT " + "0123456789abcdef" * 2 + " ſecret=longenough", "en", "a", 0),
    (902, "é-----BEGIN RSA PRIVATE KEY----- Bearer " + "t" * 30 + " https://u:p@host.org/x", "en", "a", 0),
    (903, "token=short token = 'long-enough' é secret:abc123 token=deadbeefdeadbeefdeadbeefdeadbeef", "en", "a", 0),
    (904, "日本 password = 語 secret_token:abcdefg\n\n\n", "en", None, 0),
]
LABELS = {i: i % 3 == 0 for i in range(0, 160, 2)}


@pytest.fixture(scope="module")
def rows(small):
    return [*small, *SECRETS, (905, "word " * 9000 + "ends", "en", "a", 0)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 64)).astype(np.float32)
    v[300] = v[60] = v[0]
    return v


@pytest.fixture(scope="module")
def folder(spark, rows, vectors, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("contracts"))
    documents = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("size", "ids", "spans", "fp", "shard", "kept", "row", "lines")})
    documents.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(q), 0) for i, q in LABELS.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    odd = [(2000, None, 1), (2020, [0.0] * 64, 1), (2040, [float("inf")] * 64, 1), (2060, [None] + [1.0] * 63, 1)]
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(vectors)] + odd, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def result(spark, folder, name, *columns):
    """The rows as sorted tuples of the contract's columns."""
    out = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()]
    return sorted(out, key=_key)


def _key(r):
    return tuple((x is None, str(x)) for x in r)


def plain(found):
    return sorted(found, key=_key)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, folder, rows):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    learned = documents.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0)
    model = langid.train(learned.select("doc_id", "text", "lang"))
    table, out = model.projected()
    want, right, judged = [], 0, 0
    for i, t, lang, *_ in rows:
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
        if not any(c.isalpha() for c in t or ""):
            want.append((i, held, "und", 0.0))
            continue
        p = model.score([t], table, out)[0]
        want.append((i, held, model.langs[int(p.argmax())], round(float(p.max()), 9)))
        if held and i is not None and i < 160:
            judged, right = judged + 1, right + (want[-1][2] == lang)
    got = [(i, h, lang, round(s, 9)) for i, h, lang, s in result(spark, folder, "op1_language_id", "doc_id", "held_out", "lang_pred", "score")]
    assert plain(got) == plain(want) and judged > 20 and right / judged > 0.95


def test_op2(spark, folder, rows):
    own = bpe.codec("byte_bpe_50k.tiktoken", public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(own.vocabulary) if t}
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert result(spark, folder, "op2_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == plain(want)


def test_op3(spark, folder, rows):
    base = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    more = [(r.kind, re.compile(r.pattern, re.ASCII), r.group, r.least) for r in secretscan.MORE_RULES]
    want = []
    for i, t, *_ in rows:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, rule, g, least) in enumerate(base + more) for m in rule.finditer(t or "") if len(m[g]) >= least]
        said = lambda kinds: ",".join(f"{kind}:{a}:{z}" for a, k, kind, z in sorted(spans) if k in kinds)
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        want.append((i, *counts, sha(said(range(3))), said(range(9))))
    assert result(spark, folder, "op3_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == plain(want)
    assert sum(w[1] for w in want) >= 5


def test_op4(spark, folder, rows):
    want = [(i, n, 0 if t is None else n - (len(t.split("\n")) if t or r[1] == "" else 0), t) for r, (i, n, t) in zip(rows, plain_line_dedup(rows))]
    assert result(spark, folder, "op4_line_dedup", "doc_id", "n_lines", "n_removed", "text") == plain(want)


def test_op5(spark, folder, rows):
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        body = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        frames = np.frombuffer(body, np.uint8).reshape(-1, 192)
        media = avi.write_avi(avi.encode_frames(frames))
        if len(body) < 4000:  # one code at a time
            assert b"".join(avi.block_means(avi.decode_any(f)).tobytes() for f in avi.read_avi(media)[1]) == body
        starts = plain_shots(frames)
        clips = ",".join(f"{a * 40}-{z * 40}" for a, z in zip(starts, [*starts[1:], len(frames)]))
        want.append((i, len(raw), len(body), sha(body), zlib.crc32(body[-16:]), len(media), sha(media), f"{len(starts)} shots, ms {clips}"))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert result(spark, folder, "op5_avi_clips", *columns) == plain(want)


def test_op6(spark, folder, rows):
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    group = plain_components({i: f for i, f in fps.items() if i is not None})
    want = [(r[0], f"{fps[r[0]]:016x}", group.get(r[0])) for r in rows]
    assert result(spark, folder, "op6_simhash", "doc_id", "fingerprint", "component_id") == plain(want)


def test_op7(spark, folder, rows):
    got = queries.QUERIES["op7_sharding"](spark, folder).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert plain((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == plain(want)
    counts = Counter(r["shard"] for r in got)
    assert {r["law"] for r in got} == {"rows"} and set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in counts) and {r["grown_shard"] for r in got} == {None}
    again = queries.QUERIES["op7_sharding"](spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op8(spark, folder, rows):
    target, taken = plain_mix(rows, quality={i: 1.0 + q for i, q in LABELS.items()})
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in rows:
        total[r[3]] += words(r[1])
    got = queries.QUERIES["op8_mixing"](spark, folder).collect()
    have, sums = defaultdict(list), Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"]) and r["taken"] <= 3 * r["size"]
        have[r["doc_id"] or 0, r["source"], r["size"]].append(r["taken"])
        sums[r["source"]] += r["taken"]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in taken.items()} and len(got) == len(rows)
    largest = max(words(r[1]) for r in rows)
    assert all(abs(sums[s] - target[s]) <= largest for s in total)


def test_op9(spark, folder, vectors):
    v = vectors.astype(np.float64)
    got = defaultdict(list)
    for r in queries.QUERIES["op9_one_bit_search"](spark, folder).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        exact = (v * v[q]).sum(axis=1)
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(abs(s - exact[i]) < 1e-9 for _, i, s in found) and [i for _, i, _ in found] == [i for _, i, _ in sorted(found, key=lambda x: (-x[2], x[1]))]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-exact[i], i))[:20]
        hits += len(set(want) & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_op10(spark, folder, rows):
    texts = [(suffix.NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], i), i)
    want = []
    for (i, t), (_, n, removed, kept) in zip(texts, plain_repeats(texts, 50)):
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k + 1 : k + 51] = True
        want.append((None if i == suffix.NO_ID else i, n, removed, int((gone[1:] & ~gone[:-1]).sum()), sha(kept)))
    assert result(spark, folder, "op10_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain(want)
