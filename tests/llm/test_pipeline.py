"""The pipeline and the registered queries, at the smallest scale."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenflow.llm import queries
from tests.test_queries import compare, con  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, con, sf_dir, name):  # noqa: F811
    compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], sf_dir)


def test_stages_take_effect(spark, docs, sf_dir):
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language"](spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS and kept.filter("text IS NULL OR trim(text) = ''").count() == 0
    once = steps["near_dedup"](spark, docs, sf_dir)
    assert once.count() == once.select("doc_id").distinct().count() < docs.count()
    lines = steps["line_dedup"](spark, docs, sf_dir)
    assert lines.filter("n_chars <> length(text)").count() == 0
    taken = steps["mixing"](spark, once, sf_dir)
    assert taken.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens"] and out.filter("n_tokens <> size(ids)").count() == 0 and out.count() > 0


def test_run_equals_a_plain_version(spark, small, tmp_path):
    import re

    import public_tokenizers

    from lumenflow.llm import bpe, langid, simhash

    from .conftest import SCHEMA
    from .test_ops import plain_line_dedup, plain_mix, plain_wide_fingerprint

    labels = {i: i % 3 == 0 for i in range(0, 160, 2)}
    documents = spark.createDataFrame(small, SCHEMA)
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(q), 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    model = langid.train(documents.filter(~langid.held_out(F.col("doc_id"))))
    table, out = model.projected()
    rows = [r for r in small if re.search(r"[^\W\d_]", r[1] or "") and model.score([r[1]], table, out).max() >= model.threshold]
    assert len(rows) > 150
    lines = plain_line_dedup(rows)
    rows = [(r[0], t, r[2], r[3], len(t)) for r, (_, n, t) in zip(rows, lines) if t or not r[1]]
    fps = [plain_wide_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (fps[i] ^ fps[j]).bit_count() <= simhash.radius_for():
                root = [root[j] if x == root[i] else x for x in root]
    groups = {}
    for r, g in zip(rows, root):
        groups.setdefault(g, []).append(r)
    assert len(groups) < len(rows) - 5
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    rows = [min(g, key=order) for g in groups.values()]
    keys = {(r["doc_id"], r["text"]): f":{r['k0']}:{r['k1']}" for r in corpus_pipeline.with_row(spark.createDataFrame(rows, SCHEMA)).collect()}
    name = lambda r: keys[r[0], r[1]] if r[0] is None else str(r[0])
    _, taken = plain_mix([(name(r), *r[1:]) for r in rows], quality={str(i): 1.0 + q for i, q in labels.items()})
    own = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        want += [(r[0], r[3] or "", own.encode(r[1]).tolist())] * ((taken[name(r), r[3], size][0] // size) if taken[name(r), r[3], size] else 0)
    got = [(r["doc_id"], r["source"] or "", r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 50


def test_null_and_repeated_ids_keep_a_row_of_each_group(spark, sf_dir):
    from .conftest import SCHEMA

    def text(i):
        return " ".join(f"w{i}x{j}" for j in range(60))

    rows = [(3, text(0)), (7, text(0)), (7, text(1)), (7, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (None, text(2)), (9, text(4))]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    once = steps["near_dedup"](spark, frame, sf_dir)
    want = [(3, text(0)), (7, text(1)), (7, text(2)), (None, text(3)), (9, text(4))]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.text) for r in once.collect()), key=key) == want[:3] + [want[4], want[3]]
    # one source: the budget is the whole source, each row once
    assert sorted(((r.doc_id, r.text) for r in steps["mixing"](spark, once, sf_dir).collect()), key=key) == want[:3] + [want[4], want[3]]


def test_run_with_ids_equals_a_plain_version(spark, small, tmp_path):
    test_run_equals_a_plain_version(spark, [r for r in small if r[0] is not None], tmp_path)
