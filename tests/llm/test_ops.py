"""Each operator against a plain version, an exact round trip or held-out accuracy; with edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenflow.llm import avi, bpe, langid, linededup, mixing, onebit, ring, secretscan, simhash, suffix

from .conftest import SCHEMA


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r if not isinstance(x, (dict, list, bytearray))))


# 1 language ID
def test_language_id_held_out_accuracy(spark, docs):
    rows = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(rows.filter("NOT held_out"), sample=200)
    got = langid.predict(rows.withColumn("score", F.lit("clash")), model).collect()
    judged = [r for r in got if r["held_out"] and r["lang"] and re.search("[a-zA-Z]", r["text"] or "")]
    assert len(judged) > 20 and sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.95
    for r in got:
        blank = not re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
        assert r["accepted"] == (not blank and r["score"] >= model.threshold)


def test_language_id_same_text_same_score_and_empty_tables(spark, docs, no_docs):
    model = langid.train(docs, sample=100)
    table, out = model.projected()
    texts = ["the river and stone", "der fluß", "x", "the river and stone"]
    p = model.score(texts, table, out)
    assert (p[0] == p[3]).all() and (model.score(texts[1:2], table, out)[0] == p[1]).all()
    assert langid.train(no_docs) is None and langid.train(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_language_id_rejects_what_is_no_learned_language(spark, docs):
    """The whole table fits and calibrates; new texts of its words are accepted, other languages, code and noise aren't."""
    import random

    rows = docs.withColumn("doc_id", F.monotonically_increasing_id())
    model = langid.train(rows)
    rnd = random.Random(9)
    good = [" ".join(rnd.choices(w, k=rnd.randint(8, 40))) for w in ("the of and that with river stone house bright water under".split(), "der und nicht fluß stein haus über wasser größe schön".split()) for _ in range(40)]
    bad = [
        "Привет как дела сегодня вечером",
        "这是中文文本没有英文",
        "for (int i = 0; i < n; i++) { x[i] += y[i]; }",
        "def f(x): return lambda k: x[k] ** 2",
        "8f3a9c1d2e4b5f6a7c8d9e0f",
        "zxqj vkwp qqrt mmnp",
        *["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=200)) for _ in range(20)],
        *[langid.shuffled(t) for t in good],
    ]
    judged = langid.predict(spark.createDataFrame([(t,) for t in [*good, *bad]], "text string"), model).collect()
    accepted = [r["accepted"] for r in judged]
    assert sum(accepted[: len(good)]) >= 0.95 * len(good)
    assert not any(accepted[len(good) : len(good) + 26]) and sum(accepted[len(good) + 26 :]) <= 0.1 * len(good)


def test_language_id_threshold_is_a_quantile_of_the_calibration_scores():
    rng = np.random.default_rng(1)
    logits = np.concatenate((rng.normal(0, 1, (4000, 2)), np.full((4000, 1), -1.0)), axis=1)
    truth = logits[:, :2].argmax(axis=1)
    model = langid.Model(["a", "b"], np.zeros((0, 0)), np.zeros((2, 3)), np.zeros(3))
    for share in (0.01, 0.2):
        model.calibrate(logits, truth, share)
        best = model.probabilities(logits).max(axis=1)
        assert abs((best < model.threshold).mean() - share) < 0.001
    was = model.threshold
    model.calibrate(logits, np.full(4000, -1))
    assert model.threshold == was


# 2 byte-level BPE
def test_bpe_round_trip(spark, docs):
    import tiktoken

    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(own.vocabulary) if t}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap, giant in ((bpe.CHUNK, bpe.OVERLAP, bpe.GIANT), (50, 8, 1 << 20), (50, 8, 200)):
        out = bpe.decode(bpe.encode(docs.withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)}), chunk=chunk, overlap=overlap, giant=giant))
        got = out.collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["ids"] == plain.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_of_empty_tables(no_docs):
    assert bpe.decode(bpe.encode(no_docs)).collect() == []


def test_bpe_stitching_of_awkward_chunks():
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("a" * 300, " " * 300 + "b", "a  \n\n b" * 60, "it's we'll 12 345 " * 20, "\n\n\t x" * 50, "é　 ü" * 40):
        for chunk, overlap in ((1, 0), (7, 3), (16, 40), (40, 1)):
            parts = [(s, text[s : s + chunk + overlap], own.ends(text[s : s + chunk + overlap], s)) for s in range(0, len(text), chunk)]
            assert np.concatenate([own.encode(p) for p in bpe.stitch(parts, own)]).tolist() == own.encode(text).tolist()


# 3 secret scans
def test_secret_spans_match_a_full_scan(spark, docs):
    extra = [
        (900, 'x = 1; Password: "hunter2secret" and api-key no; API_KEY=abcdef123', "en", "a", 0),
        (901, "AKIA" + "A1" * 10 + " AKIASHORT " + "0123456789abcdef" * 2 + " ſecret=longenough", "en", "a", 0),
        (902, "-----BEGIN RSA PRIVATE KEY----- Bearer " + "t" * 30 + " https://u:p@host.org/x", "en", "a", 0),
        (903, "token=short token = 'long-enough' é secret:abc123", "en", "a", 0),
    ]
    every = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("spans", F.lit(1))
    for r in secretscan.scan_secrets(every).collect():
        want = []
        for k, rule in enumerate(secretscan.RULES):
            for m in re.finditer(rule.pattern, r["text"] or "", re.ASCII):
                if len(m.group(rule.group)) >= rule.least:
                    want.append((m.start(), k, rule.kind, m.end()))
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == [(a, n, z) for a, _, n, z in sorted(want)]
        if r["doc_id"] == 900:
            assert [s["kind"] for s in r["spans"]] == ["assign", "assign"]
        if r["doc_id"] == 901:
            assert [s["kind"] for s in r["spans"]] == ["access", "hex"]
        if r["doc_id"] == 903:
            assert len(r["spans"]) == 2


def test_secret_scan_of_empty_tables_and_long_runs(no_docs):
    import time

    assert secretscan.scan_secrets(no_docs).collect() == []
    n = 1_000_000
    runs = ["://" + "a" * n, "x://" + "a:" * (n // 2), "eyJ" * (n // 3), "eyJ." * (n // 4), "token" + " " * n, "-----BEGIN " + "A " * n, "Bearer " * (n // 7), "a" * n, "AKIA" * (n // 4), "pass" * (n // 4)]
    began = time.perf_counter()
    secretscan.scanner(secretscan.RULES).scan(runs)
    assert time.perf_counter() - began < 20
    found = secretscan.scanner(secretscan.RULES).scan(["see ftp://me:word@host.org and xhttps://a:b@c", "id eyJab.eyJcd.ef but xeyJab.eyJcd.ef"])
    assert found == [[(4, 6, 26), (31, 6, 45)], [(3, 4, 17)]]


def test_trigram_queries():
    q = secretscan.trigram_query
    assert q(r"[0-9a-f]{24,}") is None and q(r"a.c") is None
    assert q(r"AKIA[A-Z0-9]+") == {frozenset({b"aki", b"kia"})}
    assert q(r"(?:abc|xyz)d+e") == {frozenset({b"abc", b"bcd"}), frozenset({b"xyz", b"yzd"})} or q(r"(?:abc|xyz)d+e") == {frozenset({b"abc"}), frozenset({b"xyz"})}
    assert q(r"(abcd)?x") is None
    found = secretscan.scanner(secretscan.RULES).candidates(["nothing", "my PassWord: x", "AKIA", "pass wor"])
    assert found[0] == [1] and found[1] == [2] and found[2] == [0, 1, 2, 3]


# 4 line dedup
def plain_line_dedup(rows, span=3):
    order = sorted(((r[0] is None, r[0] or 0), r[1], i) for i, r in enumerate(rows) if r[1] is not None)
    first, out = {}, {}
    docs = {(k, t): t.split("\n") for k, t, _ in order}
    for key, lines in sorted(docs.items(), key=lambda x: x[0][0]):
        for p in range(len(lines) - span + 1):
            w = tuple(lines[p : p + span])
            if "".join(w).strip(" \t\r\x0b\x0c"):
                first.setdefault(w, (key, p))
    for key, lines in docs.items():
        gone = set()
        for p in range(len(lines) - span + 1):
            w = tuple(lines[p : p + span])
            if w in first and (first[w][0] != key or p >= first[w][1] + span):
                gone |= set(range(p, p + span))
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return [(r[0], len((r[1]).split("\n")) if r[1] is not None else 0, out[((r[0] is None, r[0] or 0), r[1])] if r[1] is not None else None) for r in rows]


def test_line_dedup(spark, docs, no_docs, small):
    rows = [*small, (300, "a\nb\nc\nd\na\nb\nc\nx", "en", "a", 0), (301, "q\nq\nq\nq\nq\nq\nq", "en", "a", 0), (302, "\n\n\n\n", "en", "a", 0), (303, "zz\na\nb\nc", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash")).repartition(4)
    got = linededup.dedup_lines(df).select("doc_id", "n_lines", "text")
    key = lambda r: (r[0] is None, r[0] or 0, str(r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_line_dedup(rows), key=key)
    by_id = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert by_id[300]["text"] == "a\nb\nc\nd\nx" and by_id[301]["text"] == "q\nq\nq" and by_id[303]["text"] == "zz" and by_id[302]["n_removed"] == 0
    assert linededup.dedup_lines(no_docs).count() == 0


# 5 media columns
def test_avi_round_trip(spark, docs):
    media = avi.text_to_avi(docs).collect()
    got = avi.read_clips(avi.text_to_avi(docs)).collect()
    texts = sorted((r["text"] or "").encode() for r in docs.collect())
    assert sorted(len(t) for t in texts) == sorted(r["n_bytes"] for r in media)
    assert sorted(bytes(r["payload"]) for r in got) == sorted(avi.payload(t.decode()) for t in texts)
    for r in got:
        n = len(r["payload"]) // avi.WIDTH
        assert [c["first_frame"] for c in r["clips"]][0] == 0 and sum(c["frames"] for c in r["clips"]) == n
        assert r["clips"][-1]["end_ms"] == n * 1000 // avi.FPS


def test_frames_decode_alike_one_code_at_a_time():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (5, avi.WIDTH)).astype(np.uint8)
    samples[1], samples[2], samples[3, ::2] = 255, 0, 255
    frames = avi.encode_frames(samples)
    assert (avi.decode_frames(frames) == samples).all()
    for f, s in zip(frames, samples):
        assert (avi.decode_any(f) == np.repeat(np.repeat(s[None], 8, 1), 8, 0)).all()
    rate, back = avi.read_avi(avi.write_avi(frames))
    assert rate == avi.FPS and back == frames
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFF\0\0\0\0WAVE")


def plain_jpeg(planes, sampling, tables=True, every=0):
    """Flat 8 x 8 blocks, given as (rows, columns) of sample values a component, as a baseline JPEG with the standard DC
    table 0 and an AC table whose only code is end of block, or with all standard tables."""
    import struct

    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    high, wide = (planes[0].shape[i] * 8 for i in (0, 1))
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64))
    head += seg(0xC0, struct.pack(">BHHB", 8, high, wide, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    if tables:
        head += seg(0xC4, b"\0" + bytes.fromhex(avi._STANDARD_TABLES[0])) + seg(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    if every:
        head += seg(0xDD, struct.pack(">H", every))
    head += seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + bytes([0, 63, 0]))
    of = {s: f"{c:0{n}b}" for (n, c), s in avi._tree(bytes.fromhex(avi._STANDARD_TABLES[0]))[0].items()}
    end = "0" if tables else {s: f"{c:0{n}b}" for (n, c), s in avi._tree(bytes.fromhex(avi._STANDARD_TABLES[0x10]))[0].items()}[0]
    (h0, v0), bits, scans, last = sampling[0] if len(planes) > 1 else (1, 1), "", [], [128] * len(planes)
    units = [(y, x) for y in range(-(-planes[0].shape[0] // v0)) for x in range(-(-planes[0].shape[1] // h0))]
    for u, (y, x) in enumerate(units):
        if every and u and u % every == 0:
            scans.append(bits)
            bits, last = "", [128] * len(planes)
        for c, (p, (h, v)) in enumerate(zip(planes, sampling if len(planes) > 1 else [(1, 1)])):
            for dy in range(v):
                for dx in range(h):
                    value = int(p[min(y * v + dy, p.shape[0] - 1), min(x * h + dx, p.shape[1] - 1)])
                    d, last[c] = value - last[c], value
                    n = abs(d).bit_length()
                    bits += of[n] + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + end
    scans.append(bits)
    out = head
    for i, b in enumerate(scans):
        b += "1" * (-len(b) % 8)
        out += (b"\xff" + bytes([0xD0 + (i - 1) % 8]) if i else b"") + int(b, 2).to_bytes(len(b) // 8, "big").replace(b"\xff", b"\xff\0")
    return out + b"\xff\xd9"


def test_other_baseline_frames():
    rng = np.random.default_rng(1)
    luma, grey = rng.integers(0, 256, (4, 6)), rng.integers(0, 256, (2, 3))
    for tables in (True, False):
        for every in (0, 1, 2):
            assert (avi.block_means(avi.decode_any(plain_jpeg([grey], [(1, 1)], tables, every))) == grey.reshape(-1)).all()
            for sampling in ([(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)]):
                colour = [luma, *[rng.integers(0, 256, (4 // sampling[0][1], 6 // sampling[0][0])) for _ in range(2)]]
                assert (avi.block_means(avi.decode_any(plain_jpeg(colour, sampling, tables, every))) == luma.reshape(-1)).all()
    frame = rng.integers(0, 256, (11, 20)).astype(np.uint8)
    want = [int(np.floor(frame[y : y + 8, x : x + 8].mean() + 0.5)) for y in (0, 8) for x in (0, 8, 16)]
    assert avi.block_means(frame).tolist() == want


def test_standard_tables_are_whole():
    for key, table in avi._STANDARD_TABLES.items():
        raw = bytes.fromhex(table)
        assert sum(raw[:16]) == len(raw) - 16 == len(set(raw[16:])) == (12 if key < 16 else 162)


def test_files_with_sound_without_index_and_broken_ones(spark, no_docs):
    frames = avi.encode_frames(np.arange(3 * avi.WIDTH).reshape(3, -1).astype(np.uint8))
    data = avi.write_avi(frames)
    index = data.index(b"idx1")
    silent = data[:index]
    silent = silent[:4] + (len(silent) - 8).to_bytes(4, "little") + silent[8:]
    assert avi.read_avi(silent)[1] == frames
    sound = avi._chunk(b"01wb", b"la" * 5)
    movi = data.index(b"movi")
    entry = data[index + 8 : index + 24]
    mixed = data[: movi + 4] + sound + data[movi + 4 : index] + avi._chunk(b"idx1", b"01wb" + bytes(4) + (4).to_bytes(4, "little") + (10).to_bytes(4, "little") + b"".join(data[index + 8 + 16 * i :][:8] + (int.from_bytes(data[index + 16 + 16 * i :][:4], "little") + len(sound)).to_bytes(4, "little") + data[index + 20 + 16 * i :][:4] for i in range(3)))
    mixed = mixed[:4] + (len(mixed) - 8).to_bytes(4, "little") + mixed[8:]
    mixed = mixed.replace(data[movi - 8 : movi], b"LIST" + (int.from_bytes(data[movi - 4 : movi], "little") + len(sound)).to_bytes(4, "little"), 1)
    assert entry[:4] == b"00dc" and avi.read_avi(mixed)[1] == frames
    still = data.replace(b"vids" + b"MJPG" + bytes(12) + (1).to_bytes(4, "little"), b"vids" + b"MJPG" + bytes(12) + bytes(4), 1)
    none = avi.write_avi([b""])
    rows = [(1, data), (2, silent), (3, mixed), (4, still), (5, data[:300]), (6, b"noise"), (7, None), (8, none), (9, data.replace(b"\xff\xd9", b"\xff\xd8"))]
    df = spark.createDataFrame(rows, "id long, media binary").withColumns({"clips": F.lit(1), "error": F.lit(2)})
    got = {r["id"]: r for r in avi.read_clips(df).collect()}
    want = np.arange(3 * avi.WIDTH).astype(np.uint8).tobytes()
    assert all(bytes(got[i]["payload"]) == want and got[i]["error"] is None and got[i]["clips"] for i in (1, 2, 3))
    assert all(got[i]["payload"] is None and got[i]["clips"] is None and got[i]["error"] for i in (4, 5, 6, 9))
    assert got[7]["payload"] is None and got[7]["error"] is None
    assert bytes(got[8]["payload"]) == b"" and got[8]["clips"] == [] and got[8]["error"] is None
    assert avi.read_clips(avi.text_to_avi(no_docs)).collect() == []


def plain_shots(frames):
    """Shot starts, one difference at a time."""
    import math

    hists = [[0] * avi.BINS for _ in frames]
    for hist, f in zip(hists, frames):
        for x in f:
            hist[int(x) * avi.BINS // 256] += 1
    d = [sum(abs(a - b) for a, b in zip(x, y)) for x, y in zip(hists, hists[1:])]
    out = [0]
    for i, x in enumerate(d):
        before = d[max(0, i - avi.HISTORY) : i]
        k, total, squares = len(before), sum(before), sum(y * y for y in before)
        if x > avi.LEAST_CHANGE * 2 * len(frames[0]) and x * k > total + avi.SIGMAS * math.sqrt(max(0, squares * k - total * total)):
            out.append(i + 1)
    return out


def test_shots_equal_a_plain_version(small):
    rng = np.random.default_rng(2)
    cases = [np.frombuffer(avi.payload(r[1]), np.uint8).reshape(-1, avi.WIDTH) for r in small]
    for _ in range(40):
        cuts = np.concatenate([np.clip(rng.normal(rng.integers(0, 256), rng.integers(1, 60), (rng.integers(1, 15), avi.WIDTH)), 0, 255) for _ in range(4)])
        cases.append(cuts.astype(np.uint8))
    assert all(avi.shots(c).tolist() == plain_shots(c) for c in cases) and any(len(plain_shots(c)) > 2 for c in cases)


def test_shots_follow_changes_of_the_histogram():
    dark, light = np.full((20, avi.WIDTH), 20, np.uint8), np.full((20, avi.WIDTH), 220, np.uint8)
    assert avi.shots(np.concatenate((dark, light, dark))).tolist() == [0, 20, 40]
    assert avi.shots(dark[:1]).tolist() == [0]


# 6 SimHash
def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(fps):
    ids = list(fps)
    root = {f: f for f in set(fps.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i in ids:
        r = find(fps[i])
        least[r] = min(least.get(r, i), i)
    return {i: least[find(fps[i])] for i in ids}


def test_simhash_groups(spark, docs, no_docs):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    want = plain_components(fps)
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")).withColumn("id", F.lit(7))).filter("doc_id IS NOT NULL").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    for r in got:
        assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and len(r["fingerprint"]) == 16 and r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base[:30].tolist() + [0] * 40:
        for _ in range(6):
            g = f
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                g ^= 1 << b
            fps.add(g)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    number = {f: i for i, f in fps.items()}
    for chunk, pieces in ((4096, None), (8, 5), (64, 6), (64, 8)):  # whole buckets, buckets dealt out as pairs of chunks, several equal ranges
        df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps.values()], "fp long")
        from lumenflow.operators.components import components

        found = {np.uint64(np.int64(r["node"])): np.uint64(np.int64(r["root"])) for r in components(simhash.links(df, chunk=chunk, pieces=pieces)).collect()}
        want = plain_components(fps)
        group = lambda m: sorted(sorted(v) for v in m.values() if len(v) > 1)
        a, b = defaultdict(list), defaultdict(list)
        for x, r in found.items():
            a[r].append(number[int(x)])
        for x, r in want.items():
            b[r].append(x)
        assert group(a) == group(b)


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps[100:] = fps[:50] ^ np.uint64(1 << 5 | 1 << 60 | 1)
    fps[::7] ^= np.uint64(0b11011 << 20)
    for radius in (0, 1, 3, 4, 7):
        hit = simhash.within(fps, simhash.planes(fps), len(fps), radius)
        bits = np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")
        assert (bits[:, :150] == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all() and not bits[:, 150:].any()


def plain_wide_fingerprint(text, shingle=5, lanes=8):
    """As simhash.wide_fingerprint(), one shingle and one bit at a time -> a number of 64 * lanes bits."""
    gold, ones = 0x9E3779B97F4A7C15, (1 << 64) - 1
    w = [xxhash.xxh64_intdigest(x) for x in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()]
    hashes = set()
    for i in range(max(1, len(w) - shingle + 1) if w else 0):
        h = 0
        for x in w[i : i + shingle]:
            h = ((h ^ h >> 31) * gold + x) & ones
        hashes.add(h)
    out = 0
    for lane in range(lanes):
        counts = [0] * 64
        for h in hashes:
            x = (h + (lane + 1) * gold) & ones
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ones
            x = (x ^ x >> 27) * 0x94D049BB133111EB & ones
            x ^= x >> 31
            for k in range(64):
                counts[k] += x >> k & 1
        out |= sum(1 << k for k in range(64) if counts[k] * 2 > len(hashes)) << 64 * lane
    return out


def test_wide_fingerprints(spark, docs, no_docs):
    texts = [None, "", "  ", "One two", "a b c d e", "a b c d e f " * 90, " ".join(f"w{i}" for i in range(700))]
    for t in texts:
        assert int.from_bytes(simhash.wide_fingerprint(t).tobytes(), "little") == plain_wide_fingerprint(t)
    got = simhash.wide_fingerprints(docs.withColumn("fp", F.lit("clash"))).collect()
    want = Counter((r["doc_id"], simhash.wide_fingerprint(r["text"]).tobytes()) for r in docs.collect())
    assert Counter((r["id"], bytes(r["fp"])) for r in got) == want
    assert simhash.wide_links(simhash.wide_fingerprints(no_docs)).collect() == []


def test_wide_bit_sliced_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, (150, 8), dtype=np.uint64)
    fps[100:] = fps[:50] ^ (rng.random((50, 8)) < 0.6) * rng.integers(0, 1 << 20, (50, 8)).astype(np.uint64)
    distance = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    for radius in (0, 20, 93, 250):
        bits = np.unpackbits(simhash.within(fps, simhash.planes(fps), 150, radius).view(np.uint8), axis=1, bitorder="little")
        assert (bits[:, :150] == (distance <= radius)).all() and not bits[:, 150:].any()


def test_wide_links_find_near_copies(spark):
    """Texts of 120 words with 1 to 3 changed ones: those of a similarity of 0.8 and more are linked, unrelated ones never;
    with one table, and with many of few bits."""
    import random

    from lumenflow.operators.components import components

    rnd = random.Random(3)
    pairs, texts = [], []
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for i in range(300):
        a = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        b = list(a)
        for at in rnd.sample(range(120), rnd.randint(1, 3)):
            b[at] = "other"
        texts += [" ".join(a), " ".join(b)]
        x, y = shingles(texts[-2]), shingles(texts[-1])
        pairs.append((simhash.wide_fingerprint(texts[-2]).tobytes(), simhash.wide_fingerprint(texts[-1]).tobytes(), len(x & y) / len(x | y)))
    df = spark.createDataFrame([(simhash.wide_fingerprint(t).tobytes(),) for t in texts], "fp binary").distinct()
    mate = {x: y for a, b, _ in pairs for x, y in ((a, b), (b, a))}
    for meet in (1024, 16):
        root = {bytes(r["node"]): bytes(r["root"]) for r in components(simhash.wide_links(df, meet=meet)).collect()}
        assert all(root[x] in (x, mate[x]) for x in root)
        near = [a in root for a, _, j in pairs if j >= 0.8]
        assert len(near) > 100 and sum(near) >= 0.95 * len(near)


def test_tables_follow_the_number_of_fingerprints():
    assert simhash.tables_for(0) == simhash.tables_for(1024) == (0, 1)
    for n in (10**4, 10**6, 10**9, 5 * 10**10):
        bits, tables = simhash.tables_for(n)
        p = (1 - simhash.share_of(0.8)) ** bits
        assert n / 2**bits <= 1024 and 1 - (1 - p) ** tables >= 0.99 and tables < 400
    assert simhash.radius_for() == 93


def test_pieces_follow_the_number_of_fingerprints():
    assert [simhash.pieces_for(n) for n in (0, 10**6, 10**8, 10**10, 10**11)] == [5, 5, 6, 7, 7]
    for pieces in (5, 6, 7, 8):
        assert sum(n for _, n in simhash.ranges(pieces)) == 64


# 7 sharding
def test_shards_equal_a_walk_round_the_ring(spark, docs, no_docs):
    out = ring.shard_documents(docs.withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(1)), 8).collect()
    assert len(out) == docs.count()
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    sizes = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sizes
    assert ring.shard_documents(no_docs).count() == 0
    alike = docs.limit(1).crossJoin(spark.range(1000)).unionByName(docs, allowMissingColumns=True)
    out = ring.shard_documents(alike, 8)
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in slots) == alike.count() and all(r["n"] == r["d"] == r["m"] + 1 for r in slots) and max(r["n"] for r in slots) - min(r["n"] for r in slots) <= 1


def test_allotment_key_by_key():
    rng = np.random.default_rng(4)
    for shards, slack in ((8, 0.0), (3, 0.25), (1, 0.0), (5, 0.1)):
        cells = Counter(rng.integers(0, 1 << 14, 3000).tolist())
        cells[17] = 1000  # a hot cell
        pieces = ring.allot(dict(cells), shards, slack)
        n = sum(cells.values())
        room = [n // shards + (s < n % shards) if not slack else -int(-(1 + slack) * n // shards) for s in range(shards)]
        arcs = ring.preferences(shards)
        prefer = lambda c: next((p for last, p in arcs if last >= c), arcs[0][1])
        left = {c: list(range(k)) for c, k in cells.items()}
        placed = {}
        for step in range(shards):
            for c in sorted(left):
                s = prefer(c)[step]
                while left[c] and room[s]:
                    placed[c, left[c].pop(0)] = s
                    room[s] -= 1
        assert placed == {(p["cell"], i): p["shard"] for p in pieces for i in range(p["lo"], p["hi"])}
        if slack:  # most keys stay on their own shard, and one more shard moves few of the others
            own = sum(s == prefer(c)[0] for (c, _), s in placed.items())
            assert own / n > 0.6


# 8 mixing
def plain_mix(rows, seed=17, quality=None):
    import math

    quality = quality or {}

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, s in zip(rows, size):
        total[r[3]] += s
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(size))
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            rest -= target[s]
        open_ -= full
    taken = defaultdict(list)
    for s in order:
        if not total[s]:
            continue
        whole = int(target[s] // total[s])
        left, at = target[s] - whole * total[s], 0
        keys = []
        for r, n in zip(rows, size):
            if r[3] == s:
                u = (int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                keys.append((-math.log(u) / quality.get(r[0], 1.0), r[0] is not None, r[0] or 0, n))
        for _, _, i, n in sorted(keys):
            taken[i, s, n].append(min(3, whole + (left > 0 and at + n / 2 <= left)) * n)
            at += n
    return target, taken


def test_mixing(spark, docs, no_docs, small):
    df = spark.createDataFrame(small, SCHEMA).repartition(3)
    sized = df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.lit(None).cast("double").alias("quality"))
    got = mixing.mix(sized).collect()
    target, taken = plain_mix(small)
    have = defaultdict(list)
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and r["taken"] <= 3 * r["size"]
        have[r["doc_id"] or 0, r["source"], r["size"]].append(r["taken"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in taken.items()}
    assert collected(mixing.mix(sized, bins=4)) == collected(mixing.mix(sized, bins=4096))
    clash = sized.withColumns({"bin": F.lit("x"), "key": F.lit("y"), "n": F.lit(1), "part": F.lit(2), "taken": F.lit(3)})
    assert collected(mixing.mix(clash)) == collected(mixing.mix(sized))
    heavy = sized.withColumn("quality", F.lit(1e6))
    own = mixing.es_key(F.col("doc_id"), F.lit(1e6), 17)
    assert heavy.select(F.floor(F.log2(own) * mixing.BINS)).distinct().count() > 140  # of 164 ids
    same = mixing.mix(sized.withColumn("quality", F.lit(1.0))).select("doc_id", "source", "size", "taken")
    assert collected(mixing.mix(heavy).select("doc_id", "source", "size", "taken")) == collected(same)
    empty = no_docs.select("doc_id", "source", F.lit(0).alias("size"), F.lit(1.0).alias("quality"))
    assert mixing.mix(empty).count() == 0


def test_mixing_prefers_heavy_documents(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit(10).alias("size"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(1.0).alias("quality"))
    got = mixing.mix(df, weights=(1, 3)).filter("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("epochs").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in got}
    assert n[0] + n[1] == 1000 and n[0] > 2 * n[1]


# 9 nearest neighbours
def test_one_bit_search_recall(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 64))
    v[100] = v[200] = v[0]
    rows = [(i, x.astype(np.float32).tolist(), "extra") for i, x in enumerate(v)]
    rows += [(2000, None, ""), (2020, [0.0] * 64, ""), (2040, [float("nan")] * 64, ""), (2060, [1.0] * 10, ""), (2061, [2.0] * 10, ""), (None, [1.0] * 64, ""), (2080, [None] + [1.0] * 63, ""), (2100, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in onebit.search(onebit.build_index(df), F.col("id") % 20 == 0, 20, block=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = v.astype(np.float32).astype(np.float64)
    hits = total = 0
    for q in range(0, 900, 20):
        exact = (v * v[q]).sum(axis=1)
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-exact[i], i))[:20]
        assert all(abs(s - exact[i]) < 1e-9 for i, s in got[q]) and len(got[q]) == 20
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-exact[i], i))
        hits, total = hits + len(set(want) & {i for i, _ in got[q]}), total + 20
    assert hits / total >= 0.98
    assert [i for i, _ in got[2060]] == [2061] and set(got) == {*range(0, 900, 20), 2060}
    assert onebit.search(onebit.build_index(df.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_one_bit_search_takes_every_vector_of_a_repeated_id(spark):
    v = np.random.default_rng(8).standard_normal((30, 64))
    rows = [(i // 3 * 20, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = onebit.search(onebit.build_index(df), F.col("id") == 20, 29, block=10).collect()
    want = [(i // 3 * 20, round(float(v[q] @ v[i]), 9)) for q in (3, 4, 5) for i in range(30) if i != q]
    assert sorted((r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 30)] * 3)


def test_one_bit_estimates_and_bounds():
    rng = np.random.default_rng(12)
    v = rng.standard_normal((3000, 64)) * rng.uniform(0.1, 5, (3000, 1))
    block = onebit.Block(np.arange(3000), np.arange(3000), v, *onebit.encode(v))
    outside, bias = 0, 0.0
    for q in rng.standard_normal((40, 64)):
        est, lack = block.estimates(q)
        error = (est - v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
        outside, bias = outside + (np.abs(est - v @ q) > lack).sum(), bias + error.mean() / 40
    assert outside / (40 * 3000) < 0.01 and abs(bias) < 0.005


# 10 suffix-array dedup
def plain_repeats(rows, span):
    first = {}
    for i, t in rows:
        for k in range(len(t) - span + 1):
            w = t[k : k + span]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((None if i == suffix.NO_ID else i, len(t), int(gone.sum()), kept))
    return out


@pytest.mark.parametrize("unit_bytes, popular", [(None, 64), (3000, 64), (3000, 1), (1, 2)])
def test_suffix_dedup(spark, docs, no_docs, small, unit_bytes, popular):
    rows = [*small, (400, "ab" * 200, "en", "a", 0), (401, "x" + "ab" * 100 + "é" * 60, "en", "a", 0), (402, "é" * 55, "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("clash")).repartition(3)
    got = suffix.remove_repeats(df, unit_bytes=unit_bytes, partitions=5, popular=popular).collect()
    have = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), bytes(r["kept"])) for r in got]
    want = plain_repeats([(suffix.NO_ID if r[0] is None else r[0], (r[1] or "").encode()) for r in rows], 50)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(have, key=key) == sorted(want, key=key)
    assert suffix.remove_repeats(no_docs).count() == 0


def test_second_minimisers_and_sizes():
    rng = np.random.default_rng(9)
    raw = rng.integers(97, 100, 400).astype(np.uint8)
    raw[100:200] = 97
    h = suffix.gram_hashes(raw)
    for span in (32, 50, 64):
        got, low = suffix.second_minimisers(raw, span), suffix.minimisers(raw, span)
        for i in range(len(raw) - span + 1):
            own = sorted(set(h[i : i + span - suffix.GRAM + 1].tolist()))
            assert low[i] == own[0] and got[i] == (own[1] if len(own) > 1 else np.iinfo(np.uint64).max)
    sizes = [suffix.sizes_for(10**k) for k in range(6, 15)]
    assert sizes == sorted(sizes) and sizes[0] == (4 << 20, 256) and sizes[-1][0] == 64 << 20


def test_radix_groups_are_the_repeated_windows():
    rng = np.random.default_rng(8)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:2300] = text[100:400]
    at = np.arange(4000 - 50 + 1)
    members, starts = suffix.radix_groups(np.concatenate((text, np.zeros(8, np.uint8))), at, 50)
    groups = sorted(sorted(g.tolist()) for g in np.split(members, starts[1:]) if len(g))
    want = defaultdict(list)
    for k in at.tolist():
        want[text[k : k + 50].tobytes()].append(k)
    assert groups == sorted(g for g in want.values() if len(g) > 1)


def test_bit_sliced_blocks_equal_all_pairs():
    rng = np.random.default_rng(3)
    for t in range(40):
        lanes = (1, 2, 8)[t % 3]
        n, radius = int(rng.integers(1, 700)), int(rng.integers(0, 9 if lanes == 1 else 110))
        fps = rng.integers(0, 1 << 63, (n, lanes), dtype=np.uint64)
        for _ in range(n // 2):
            i, j = rng.integers(0, n, 2)
            fps[i] = fps[j]
            for _ in range(int(rng.integers(0, radius + 4))):
                fps[i, rng.integers(0, lanes)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        want = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=2, dtype=int) <= radius
        got = np.unpackbits(simhash.within(fps, simhash.planes(fps), n, radius).view(np.uint8), axis=1, bitorder="little")
        assert (got[:, :n] == want).all() and not got[:, n:].any()

        def label(pairs):
            own = list(range(n))
            for u, v in pairs:
                a, b = own[u], own[v]
                if a != b:
                    own = [min(a, b) if x in (a, b) else x for x in own]
            return own

        left = int(rng.integers(0, n)) if t % 2 else 0
        linked = np.argwhere(np.triu(want, 1) if not left else want & (np.arange(n)[:, None] < left) & (np.arange(n) >= left))
        assert label(zip(*simhash._forest(fps, left, radius, ()))) == label(linked.tolist())
