"""WAV columns, image arrays, paths and retries."""

import numpy as np
import pytest

from lumenflow.functions import images
from lumenflow.operators.folds import Monotone
from lumenflow.sources import paths, wav
from lumenflow.sources.search import RecordedSearch


def test_wav_round_trip_and_resampling():
    x = np.sin(np.linspace(0, 40, 8000)) * 0.5
    back, rate = wav.read_wav(wav.write_wav(x, 8000))
    assert rate == 8000 and np.abs(back - x).max() < 1e-4
    up, rate = wav.read_wav(wav.write_wav(x, 8000), 16000)
    assert rate == 16000 and len(up) == 16000
    assert len(wav.read_wav(wav.write_wav(np.zeros(0), 8000), 16000)[0]) == 0


def test_slices_and_activity(spark):
    x = np.concatenate((np.zeros(8000), np.sin(np.arange(8000)) * 0.5, np.zeros(8000)))
    media = spark.createDataFrame([("m", bytearray(wav.write_wav(x, 16000)))], "media string, wav binary")
    got = wav.activity(media, "media").collect()
    assert [(round(r["start"], 2), round(r["end"], 2)) for r in got] == [(0.5, 1.0)]
    seg = spark.createDataFrame([("m", 0.5, 1.0), ("m", 1.25, 9.0), ("m", 5.0, 6.0), ("other", 0.0, 1.0)], "media string, start double, end double")
    lengths = sorted(len(wav.read_wav(bytes(r["wav"]))[0]) for r in wav.slices(media, seg, "media").collect())
    assert lengths == [4000, 8000]


def test_perceptual_hash_is_stable_under_brightness():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 200, (32, 32))
    other = rng.integers(0, 200, (32, 32))
    h = lambda x: np.uint64(np.int64(images.phash(x)))
    assert h(a) == h(a + 40) and int(np.bitwise_count(h(a) ^ h(other))) > 10


def test_paths_and_retries():
    assert paths.to_mount("/home/u/a/b.mp4", "/home/u", "/data") == "/data/a/b.mp4"
    assert paths.to_mount("https://x/y", "/home/u", "/data") == "https://x/y" and paths.to_mount("/etc/x", "/home/u", "/data") == "/etc/x"
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("no route")

    assert paths.first_answer([fails, lambda: [], lambda: ["hit"]], sleep=waits.append) == ["hit"]
    assert len(calls) == 3 and waits == [2.0, 4.0]


def test_recorded_search(spark):
    spark.dataSource.register(RecordedSearch)
    hits = '{"q1": {"web": [], "video": [{"title": "a"}, {"title": "b"}]}, "q2": {"web": [{"title": "c"}]}, "q3": {}}'
    got = spark.read.format("recorded_search").option("hits", hits).option("most", "1").load().collect()
    assert sorted((r["query"], r["source"], r["rank"], r["title"]) for r in got) == [("q1", "video", 1, "a"), ("q2", "web", 1, "c")]


def test_first_missing_time_is_zero():
    m = Monotone(10.0)
    assert m.row((0, None, None)) == [(0, 0.0, 0)] and m.row((1, None, None)) == [(1, 0.1, 1)]


def test_unknown_sample_widths():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(8000)
        w.writeframes(b"\0" * 9)
    with pytest.raises(ValueError):
        wav.read_wav(out.getvalue())


def test_every_model_contract_has_a_stand_in(spark):
    from pyspark.sql import types as T

    from lumenflow.plans import models

    examples = {"media": "m", "audio": bytearray(b"a"), "word": "w", "start": 1.0, "end": 2.0, "id": 5, "text": "t", "query": "q", "body": "b", "prompt": "p", "image": bytearray(b"i"), "frame": 3, "score": 0.5}
    assert len(models.KINDS) == 20
    for kind in models.KINDS:
        takes, gives = T.StructType.fromDDL(kind.takes), T.StructType.fromDDL(kind.gives)
        df = spark.createDataFrame([tuple(examples[f.name] for f in takes.fields)] * 2, takes)
        rows = models.stand_in(kind, df).collect()
        out = models.stand_in(kind, df).schema
        assert [(f.name, f.dataType.simpleString()) for f in out.fields] == [(f.name, f.dataType.simpleString()) for f in gives.fields]
        assert len(rows) == 2 and rows[0] == rows[1]
        if "x1" in out.names:
            assert rows[0]["x2"] > rows[0]["x1"] and rows[0]["y2"] > rows[0]["y1"]
        with pytest.raises(ValueError):
            models.stand_in(kind, df.drop(takes.fields[0].name))


def test_diverse_by_vector_and_hash():
    from lumenflow.operators.folds import Diverse

    a, b, far_bits = [1.0, 0.0], [0.0, 1.0], (1 << 63) - 1 - (1 << 63)
    rows = [(0, a, 0), (1, a, far_bits), (2, b, 0), (3, b, 0), (4, b, None)]
    keep = lambda f: [x[0] for r in rows for x in f.row(r)]
    assert keep(Diverse(0.5)) == [0, 2]
    assert keep(Diverse(0.5, 0.3, both=True)) == [0, 4]
    assert keep(Diverse(0.5, 0.3, both=False)) == [0, 1, 2]
