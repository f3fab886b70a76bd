"""Micro-cases of rules that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.functions import jsonx, text, timing, vectors
from lumenflow.operators import clustering, crawl, folds, intervals, planners, retrieval, sequences, spatial, vectorjoin
from lumenflow.operators.components import components
from lumenflow.plans import config, gates, runner
from lumenflow.sources import markdown, sinks, transcripts


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_overlap_join_touching_excluded_and_clipped(spark):
    seg = spark.createDataFrame([(0, 1, 2, 5)], "k int, seg int, s int, e int")
    turn = spark.createDataFrame([(0, "A", 0, 2), (0, "B", 4, 9), (0, "C", 5, 6)], "k int, speaker string, ts int, te int")
    assert rows(intervals.overlap_join(seg, turn, ["k"], 2), "speaker", "o_start", "o_end") == [("B", 4, 5)]


def test_best_overlap_first_wins_on_ties(spark):
    seg = spark.createDataFrame([(0, 1, 0, 4), (0, 2, 90, 91)], "k int, seg int, s int, e int")
    turn = spark.createDataFrame([(0, 1, 0, 2), (0, 2, 2, 4)], "k int, turn int, ts int, te int")
    assert rows(intervals.best_overlap(seg, turn, ["k"], "seg", ["turn"], 3).select("seg", F.coalesce("turn", F.lit(-1)).alias("turn"))) == [(1, 1), (2, -1)]


def test_point_in_interval_default(spark):
    p = spark.createDataFrame([(0, 99), (0, 49)], "k int, p int").withColumn("id", F.col("p"))
    scenes = spark.createDataFrame([(0, 0, 0, 49), (0, 1, 50, 98)], "k int, scene int, ts int, te int")
    out = intervals.point_in_interval(p, scenes, ["k"], "id", ["scene"], 10)
    assert rows(out.select("p", F.coalesce("scene", F.lit(-1)).alias("s"))) == [(49, 0), (99, -1)]


def test_overlap_semi_ratio(spark):
    w = spark.createDataFrame([(0, 1, 0.0, 2.0)], "k int, w int, s double, e double")
    seg = spark.createDataFrame([(0, 1.9, 5.0)], "k int, ts double, te double")
    assert intervals.overlap_semi(w, seg, ["k"], "w", 2, 0.15).count() == 0
    assert intervals.overlap_semi(w, seg, ["k"], "w", 2, 0.04).count() == 1


def test_nearest_fill_earlier_on_ties(spark):
    p = spark.createDataFrame([(0, 5), (0, 0), (0, 9)], "k int, t int")
    known = spark.createDataFrame([(0, 3, "a"), (0, 7, "b")], "k int, t int, v string")
    assert rows(intervals.nearest_fill(p, known, ["k"], "t", "v"), "t", "v") == [(0, "a"), (5, "a"), (9, "b")]


def test_smoothing_and_edges(spark):
    d = spark.createDataFrame([(0, i, x) for i, x in enumerate([1.0, 0.0, 0.0])], "m int, i int, p double").withColumn("label", F.lit("a"))
    out = sequences.smooth_probabilities(d.unionByName(d.withColumn("label", F.lit("b")).withColumn("p", 1 - F.col("p"))), ["m"], "i", "label", "p", 5, 1.0)
    assert [round(r["smooth"], 6) for r in out.filter("label = 'a'").orderBy("i").collect()] == [0.6, 0.4, 0.2]


def test_timeline_merge(spark):
    data = [(0, 0, "speech", 0.0, 2.0, 0.8), (0, 1, "speech", 2.0, 4.0, 0.6), (0, 2, "music", 4.0, 4.2, 0.9), (0, 3, "speech", 10.0, 12.0, 0.7)]
    df = spark.createDataFrame(data, "m int, ord int, label string, s double, e double, conf double")
    out = rows(sequences.timeline_merge(df, ["m"], "label").select("label", "s", "e", F.round("conf", 4)))
    assert out == [("speech", 0.0, 4.0, 0.7333), ("speech", 10.0, 12.0, 0.7)]
    mixed = [(0, i, x, s, s + 2.0, 0.5) for i, (x, s) in enumerate([("speech", 0.0), ("music", 0.0), ("speech", 2.0), ("music", 2.0)])]
    assert sequences.timeline_merge(spark.createDataFrame(mixed, df.schema), ["m"], "label").count() == 4


def test_action_merge(spark):
    data = [(0, 0, "run", 0.0, 2.0, 0.6), (0, 1, "run", 2.5, 4.0, 0.9), (0, 2, "jump", 4.0, 5.0, 0.5), (0, 3, "run", 4.2, 6.0, 0.7)]
    df = spark.createDataFrame(data, "m int, ord int, label string, s double, e double, conf double")
    assert rows(sequences.action_merge(df, ["m"], "label"), "label", "s", "e", "conf") == [("jump", 4.0, 5.0, 0.5), ("run", 0.0, 4.0, 0.9), ("run", 4.2, 6.0, 0.7)]


def test_activity_padding_after_merge(spark):
    df = spark.createDataFrame([(0, f, 1.0) for f in [*range(31), *range(100, 131)]], "m int, f int, s double")
    assert rows(sequences.activity_segments(df, ["m"], "f", "s", 0.5, 10, 10, 50, 200), "start", "end") == [(0, 80), (50, 180)]


def test_hysteresis(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([-70.0, -40.0, -50.0, -65.0, -70.0])], "m int, i int, x double")
    out = sequences.hysteresis(df, ["m"], "i", "x", -45.0, -60.0, 0.1, 0.15)
    assert [(round(r["start"], 3), round(r["end"], 3)) for r in out.collect()] == [(0.1, 0.3)]


def test_word_timing_and_vote(spark):
    df = spark.createDataFrame([("aa b", 0.0, 3.0)], "t string, a double, z double")
    assert rows(sequences.word_timing(df, "t", "a", "z"), "word", "word_start", "word_end") == [("aa", 0.0, 2.0), ("b", 2.0, 3.0)]
    v = spark.createDataFrame([(0, 0, "a", 0.5), (0, 1, "b", 0.6), (0, 2, "a", 0.2)], "m int, i int, label string, c double")
    assert [r["voted"] for r in sequences.vote3(v, ["m"], "i", "label", "c").orderBy("i").collect()] == ["b", "a", "b"]


def test_fps_sample(spark):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate([0.0, 0.4, 0.8, 1.2, 1.6, 2.0])], "m int, f int, t double")
    assert rows(sequences.fps_sample(df, ["m"], "f", "t", 1.0), "f") == [(0,), (3,), (5,)]
    assert sequences.fps_sample(df, ["m"], "f", "t", None).count() == 6


def test_last_kept_and_diverse(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([a, a, b, a])], "m int, i long, v array<double>")
    assert rows(folds.fold(df, ["m"], ["i"], ["i", "v"], lambda: folds.LastKept(0.95), "kept long"), "kept") == [(0,), (2,), (3,)]
    assert rows(folds.fold(df, ["m"], ["i"], ["i", "v"], lambda: folds.Diverse(0.5), "kept long"), "kept") == [(0,), (2,)]


def test_words_to_segments_breaks(spark):
    words = [("a.", 0.0, 0.1), ("b", 0.2, 0.3), ("c.", 0.9, 1.0), ("d", 1.25, 1.3), ("", 1.3, 1.4)]
    df = spark.createDataFrame([(0, i, *w) for i, w in enumerate(words)], "m int, i int, w string, s double, e double")
    out = folds.fold(df, ["m"], ["i"], ["w", "s", "e"], folds.WordsToSegments, "segment int, start double, end double, n int, body string")
    assert rows(out, "segment", "body") == [(0, "a. b"), (1, "c."), (2, "d")]
    fifteen = folds.WordsToSegments()
    got = [x for i in range(17) for x in fifteen.row((f"w{'.' if i == 15 else ''}", i * 0.1, i * 0.1))]
    assert len(got) == 1 and got[0][3] == 16


def test_chunkers():
    assert folds.chunk_paragraphs("x" * 50, 100, 10) == ["x" * 50]
    got = folds.chunk_paragraphs("aaaa\nbbbb\ncccc", 10, 2)
    assert got == ["aaaa\nbbbb", "bb\ncccc"]
    assert folds.chunk_sentences(["a", "b", "c"], [3, 2, 3], "t", 5, 2) == ["Title: t. Text: a b", "Title: t. Text: b c"]
    assert folds.chunk_sentences(["a", "b", "c"], [3, 3, 3], "t", 5, 2) == ["Title: t. Text: a", "Title: t. Text: b", "Title: t. Text: c"]


def test_merge_short_keeps_both_ends(spark):
    df = spark.createDataFrame([(0, float(b)) for b in (0, 2, 6, 7, 12, 13)], "m int, b double")
    assert rows(folds.fold(df, ["m"], ["b"], ["b"], lambda: folds.MergeShort(5.0), "x double"), "x") == [(0.0,), (6.0,), (12.0,), (13.0,)]


def test_drop_repeated_and_monotone():
    f = folds.DropRepeated()
    got = [x for v in [(1, "hi", 0.0, 2.0), (2, "hi", 2.2, 3.0), (3, "", 3.0, 4.0), (4, "hi", 9.0, 9.5)] for x in f.row(v)]
    assert got == [(1,), (4,)]
    m = folds.Monotone(2.0)
    assert [m.row(v)[0] for v in [(0, 1.0, 0), (1, None, 0), (2, 0.5, 7)]] == [(0, 1.0, 0), (1, 1.5, 1), (2, 1.5, 7)]


def test_roll_up(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 1.0)], "s double")
    assert round(df.agg(retrieval.roll_up(F.col("s"), "weighted_mean")).first()[0], 4) == 0.7311
    df = spark.createDataFrame([(float(s),) for s in (1, 2, 3, 4)], "s double")
    assert df.agg(retrieval.roll_up(F.col("s"), "top_k_mean")).first()[0] == 3.0
    assert df.agg(retrieval.roll_up(F.col("s"), "nosuch")).first()[0] == 4.0
    c = spark.createDataFrame([("q", "a", 5.0), ("q", "b", 4.0), ("q", "c", -6.0)], "q string, d string, s double")
    assert retrieval.select_candidates(c, ["q"], "s", ["d"], least=-5.0, k=3).count() == 2


def test_iou_argmax_then_threshold(spark):
    box = "frame int, id int, x1 int, y1 int, x2 int, y2 int"
    left = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (0, 2, 50, 50, 60, 60)], box)
    right = spark.createDataFrame([(0, 7, 0, 0, 10, 9), (0, 8, 0, 0, 10, 5)], box).withColumnRenamed("id", "other")
    out = spatial.iou_argmax(left, right, "frame", "id", "other", 0.5)
    assert rows(spatial.unmatched_ids(out, "frame", "id", "other"), "id", "track") == [(1, 7), (2, 100000)]


def joined_rows(out):
    """Rows that the joins of an executed plan put out."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        n = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        kids = node.children()
        return n + sum(walk(kids.apply(i)) for i in range(kids.size()))

    out.collect()
    return walk(out._jdf.queryExecution().executedPlan())


def copied_boxes(spark, shift):
    """One frame of 2,000 boxes, 4 of them different."""
    k = F.col("id") % 4
    return spark.range(2000).select(F.lit(0).alias("frame"), "id", (k * 3 + shift).alias("x1"), (k * 0).alias("y1"), (k * 5 + 10 + shift).alias("x2"), (k * 0 + 10).alias("y2"))


def test_iou_argmax_compares_different_boxes_only(spark):
    left, right = copied_boxes(spark, 0), copied_boxes(spark, 1).withColumnRenamed("id", "other")
    out = spatial.iou_argmax(left, right, "frame", "id", "other", 0.5)
    assert joined_rows(out) < 10000  # not 4,000,000 pairs
    assert {(r["id"] % 4, r["other"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_iou_argmax_repeated_ids_and_nulls(spark):
    box = "frame int, id int, x1 int, y1 int, x2 int, y2 int"
    left = spark.createDataFrame([(0, 1, 0, 0, 10, 10), (0, 1, 50, 50, 60, 60), (0, 2, 0, 0, None, 10), (None, 3, 0, 0, 10, 10), (0, None, 0, 0, 10, 10)], box)
    right = spark.createDataFrame([(0, 9, 0, 0, 10, 10), (0, 8, 0, 0, 10, 10), (None, 7, 0, 0, 10, 10)], box).withColumnRenamed("id", "other")
    out = spatial.iou_argmax(left, right, "frame", "id", "other", 0.5)
    got = sorted(out.select("frame", "id", "x1", "other", "iou").collect(), key=str)
    assert [tuple(r) for r in got] == [(0, 1, 0, 8, 1.0), (0, 1, 50, 8, 1.0), (0, 2, 0, None, None), (0, None, 0, None, None), (None, 3, 0, None, None)]


def test_mask_join_compares_different_boxes_only(spark):
    masks = copied_boxes(spark, 1).withColumnRenamed("id", "other").withColumn("mask", F.concat(F.lit("m"), F.col("other").cast("string")))
    out = spatial.mask_join(copied_boxes(spark, 0), masks, "frame", "id", "other", "mask", 0.5)
    assert joined_rows(out) < 15000
    assert {(r["id"] % 4, r["mask"]) for r in out.collect()} == {(0, "m0"), (1, "m1"), (2, "m2"), (3, "m3")}


def test_strict_low_threshold_over_copies(spark):
    right = copied_boxes(spark, 9).withColumnRenamed("id", "other")
    out = spatial.iou_argmax(copied_boxes(spark, 0), right, "frame", "id", "other", 0.01, True).filter("other IS NOT NULL")
    assert joined_rows(out) < 10000
    assert {(r["id"] % 4, r["other"]) for r in out.collect()} == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_unmatched_ids_over_copies_and_null_frames(spark):
    right = copied_boxes(spark, 1).withColumnRenamed("id", "other")
    far = spark.createDataFrame([(0, 5000, 900, 900, 910, 910), (None, 1, 0, 0, 10, 10)], "frame int, id long, x1 long, y1 long, x2 long, y2 long")
    out = spatial.unmatched_ids(spatial.iou_argmax(copied_boxes(spark, 0).unionByName(far), right, "frame", "id", "other", 0.5, True), "frame", "id", "other")
    assert joined_rows(out) < 30000
    assert [(r["frame"], r["track"]) for r in out.filter("track >= 100000").orderBy("track").collect()] == [(0, 100000), (None, 100001)]


def shuffled_rows(out):
    """Rows that the exchanges of an executed plan write."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        n = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        kids = node.children()
        return n + sum(walk(kids.apply(i)) for i in range(kids.size()))

    out.collect()
    return walk(out._jdf.queryExecution().executedPlan())


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_iou_argmax_shuffles_left_boxes_once(spark, small_broadcasts):
    right = copied_boxes(spark, 9).withColumnRenamed("id", "other")
    left = copied_boxes(spark, 0).withColumn("id", F.col("id") * 5)  # a range's own ids would need no exchange
    out = spatial.iou_argmax(left, right, "frame", "id", "other", 0.01, True).filter("other IS NOT NULL")
    assert shuffled_rows(out) == 2000  # not again to be joined with the 4 different boxes
    assert {(r["id"] % 4, r["other"]) for r in out.collect()} == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_mask_join_shuffles_neither_masks_nor_boxes_again(spark, small_broadcasts):
    masks = copied_boxes(spark, 1).withColumn("other", F.col("id") * 5).drop("id").withColumn("mask", F.concat(F.lit("m"), F.col("other").cast("string")))
    boxes = copied_boxes(spark, 0).withColumn("id", F.col("id") * 5)
    out = spatial.mask_join(boxes, masks.union(masks.filter("other = 5").withColumn("mask", F.lit("second"))), "frame", "id", "other", "mask", 0.5)
    assert shuffled_rows(out) == 2000  # the boxes, once by id
    got = out.collect()
    assert {(r["id"] % 4, r["mask"]) for r in got} == {(0, "m0"), (1, "m5"), (1, "second"), (2, "m10"), (3, "m15")}
    assert len(got) == 2500  # both masks of the repeated id


def test_text_functions(spark):
    assert one(spark, text.speech_word(F.col("a")), a="Don’t-stop!") == "don't stop"
    kv = one(spark, text.key_value(F.col("a")), a="a=b: c")
    assert (kv["key"], kv["value"]) == ("a=b", "c")
    assert one(spark, text.overlap_score(text.tokens(F.col("q")), text.tokens(F.col("d"))), q="AI ai agents", d="AI news") == 0.5
    assert one(spark, text.strip_intro(F.col("a")), a="This image shows a cat") == "Cat"
    assert one(spark, text.clean_title(F.col("a")), a='Title: "Short"') == "Short"
    assert one(spark, text.clean_title(F.col("a")), a="..") == "Discussion"
    assert one(spark, text.comment_metadata(F.col("a")), a="<!-- Source: x --><!-- Source: y -->") == {"Source": "y"}
    assert one(spark, text.sentence_cut(F.col("a"), 12), a="One two. Three four.") == "One two."


def test_sentences_are_trimmed_of_spaces_only(spark):
    df = spark.createDataFrame([(" 0 zero. 1 one! 2? ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.sentences(F.col("t"))).collect()] == [["0 zero.", "1 one!", "2?"], None, []]


def test_times(spark):
    assert one(spark, timing.srt_time(F.col("a")), a=3661.9996) == "01:01:01,999"
    for said, want in (("1:02:03.5", 3723.5), ("02:03", 123.0), ("90", 90.0), ("x", None), ("-3", None)):
        assert one(spark, timing.parse_time(F.col("a")), a=said) == want
    assert one(spark, timing.human_duration(F.col("a")), a=3723.0) == "1h 2m 3s"
    assert gates.slice_bounds("01:00", "900", 600.0) == (60.0, 600.0)
    for bad in (("-1", None), ("10", "5"), ("700", None), ("x", None)):
        with pytest.raises(ValueError):
            gates.slice_bounds(*bad, 600.0)


def test_vectors_and_json(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("z")).alias("z"), vectors.softmax(F.col("a")).alias("s"), vectors.cosine(F.col("a"), F.col("z")).alias("c")).first()
    assert r["u"] == [0.6, 0.8] and r["z"] == [0.0, 0.0] and abs(sum(r["s"]) - 1) < 1e-12 and r["c"] == 0
    k = one(spark, jsonx.document_type(F.col("a")), a='<think>{"a":1}</think> x {"document_type": "memo"} y')
    assert (k["document_type"], k["confidence"]) == ("memo", 0.5)


def _groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b] + [(i, i + 1) for i in range(200, 260)] + [(500, x) for x in range(501, 540)]
    assert rows(components(spark.createDataFrame(pairs, "u long, v long")), "node", "root") == _groups(pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_split_join_lets_a_hot_key_be_split(spark):
    from lumenflow.operators.joins import split_join

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 100_000, 1, 16).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("u"), F.xxhash64("id").alias("v"))
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        plans = []
        for joined in (rows.join(least, "u"), split_join(rows, least, ["u"])):
            out = joined.agg(F.count("*"), F.bit_xor("m"), F.bit_xor("v"))
            plans.append((out.collect(), "skew=true" in out._jdf.queryExecution().executedPlan().toString()))
        assert plans[0][0] == plans[1][0] and [split for _, split in plans] == [False, True]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dbscan_against_plain_version(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    near = 1 - v @ v.T <= 0.25
    near[np.diag_indices(60)] = True
    core = near.sum(axis=1) >= 3
    group = dict(_groups([(i, j) for i in range(60) for j in range(60) if core[i] and core[j] and near[i, j]]))
    number = {r: k for k, r in enumerate(sorted(set(group.values())))}
    want = []
    for i in range(60):
        own = [number[group[j]] for j in range(60) if core[j] and near[i, j]] if not core[i] else [number[group[i]]]
        want.append((i, min(own, default=-1)))
    assert rows(clustering.dbscan(df, "id", "v", 0.25, 3)) == want
    got = vectorjoin.neighbours(df, "id", "v", 2, block=16).filter("rank = 2")
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    assert rows(got, "a", "b") == [(i, int(np.argsort(d[i], kind="stable")[1])) for i in range(60)]


def test_peaks():
    from lumenflow.operators import peaks

    x = np.array([0, 2, 0, 1, 1, 1, 0, 3, 2.9, 3, 0, 1.0])
    assert peaks.local_maxima(x).tolist() == [1, 4, 7, 9]
    assert [round(peaks.prominence(x, i), 3) for i in (1, 4, 7, 9)] == [2, 1, 3, 3]
    assert peaks.find_peaks(x, 1.5).tolist() == [1, 7, 9]
    assert peaks.find_peaks(x, distance=3).tolist() == [1, 4, 9]
    assert peaks.find_peaks(x, distance=7).tolist() == [1, 9]
    assert peaks.find_peaks(x, least=1.5, most=2).tolist() == [7, 9]
    assert peaks.find_peaks(np.zeros(5)).tolist() == [] and peaks.median5(np.array([0, 9, 0, 9, 9.0])).tolist() == [0, 0, 9, 9, 0]


def test_bfs_budget(spark):
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert rows(crawl.bfs(links, start, 2), "node", "depth") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(crawl.bfs(links, start, 5, budget=3), "node") == [(1,), (2,), (3,)]


def test_sources_and_sinks(spark):
    raw = spark.createDataFrame([("m", '[{"text": "a", "start": 1, "end": 2}, {"text": " "}, {"words": [{"word": "b"}, {"word": "c"}], "end": 1}]')], "m string, v string")
    assert rows(transcripts.segments_of(raw, "m", "v"), "text", "start", "end")[:1] == [("a", 1.0, 2.0)]
    lines = spark.createDataFrame([("SPEAKER f 1 0.5 2.0 <NA> <NA> spk <NA>",), ("SPEAKER f 1 0.5",), ("SPEAKER f 1 0.5 0 <NA> <NA> spk",)], "value string")
    assert rows(transcripts.parse_rttm(lines), "media", "start", "end", "speaker") == [("f", 0.5, 2.5, "spk")]
    html = spark.createDataFrame([(1, "<table><tr><th>a</th></tr><tr></tr><tr><td> <b>b</b> </td><td>c,d</td></tr></table>")], "d int, h string")
    cells = html.select("d", markdown.cells(F.col("h")).alias("c"))
    assert cells.first()["c"] == [["a"], ["b", "c,d"]]
    assert sinks.csv_lines(cells, "d", "c").first()["csv"] == 'a\nb,"c,d"'


def test_markdown_directory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "some-page.md").write_text("<!-- Source: u -->\nno heading")
    (tmp_path / "b.md").write_text("# Head\nx")
    got = {r["title"]: r["metadata"] for r in markdown.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"Some Page": {"Source": "u"}, "Head": {}}


def test_planners(spark):
    df = spark.createDataFrame([(1, 100)], "id int, total int")
    assert rows(planners.fixed_chunks(df, "total", 60, 5), "start", "stop", "core_start", "core_end") == [(0, 65, 0, 60), (55, 100, 60, 100)]


def test_config_and_runner(spark):
    got = config.load('{"lumenflow": {"classify_timeline": {"hop": 1.0}}}')
    assert got["timeline"].hop == 1.0 and got["timeline"].window == 2.0
    with pytest.raises(ValueError):
        config.load({"nosuch": {}})
    result, step = runner.run_module("x", lambda: 1 / 0)
    assert result is None and step.status == "fail"
    out = runner.summary(spark, ["x", "y"], [step])
    assert rows(out, "module", "status") == [("x", "fail"), ("y", "not_run")]
    with pytest.raises(ValueError):
        gates.require({"a"}, "a", "b")


def plain_adaptive(v, base, least, attempts, same, farthest):
    v, kept = v / np.linalg.norm(v, axis=1, keepdims=True), []
    for i in range(len(v)):
        if not kept or v[kept[-1]] @ v[i] < same:
            kept.append(i)
    c = v[kept]
    d = 1 - c @ c.T
    for _ in range(attempts):
        k = min(max(2 * least, 4), len(c)) - 1
        far = np.sort(d + np.diag([np.inf] * len(c)), axis=1)[:, k - 1]
        eps = base if len(c) < max(least + 1, 4) else min(max(np.percentile(far, 40), min(np.percentile(far, 75), base), 0.02), base)
        near = d <= min(max(eps, 0.05), 0.95)
        core, label, n = near.sum(axis=1) >= least, np.full(len(c), -1), 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if label[j] < 0:
                        label[j] = n
                        todo += np.flatnonzero(near[j] & (label < 0)).tolist() if core[j] else []
                n += 1
        if n > 1:
            break
        base *= 0.85
    if not n:
        label[:], n = 0, 1
    cents = np.array([c[label == i].mean(axis=0) for i in range(n)])
    sims = v @ (cents / np.linalg.norm(cents, axis=1, keepdims=True)).T
    out = np.where(sims.max(axis=1) < 1 - farthest, -1, sims.argmax(axis=1))
    return [-1 if x < 0 else sorted(set(out[out >= 0].tolist())).index(x) for x in out.tolist()]


@pytest.mark.parametrize("least, cut", [(1, {"farthest": 0.3}), (3, {})])
def test_adaptive_clusters_assigns_every_row_and_cuts_noise(spark, least, cut):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((3, 12))
    v = np.concatenate([np.repeat(c + 0.3 * rnd.standard_normal((6, 12)), 2, axis=0) for c in centres] + [rnd.standard_normal((4, 12)), np.repeat(rnd.standard_normal((1, 12)), 4, axis=0)])
    arc = np.radians(np.arange(0, 160, 20))
    v = np.concatenate([v, np.pad(np.stack([np.cos(arc), np.sin(arc)], axis=1), ((0, 0), (0, 10)))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = rows(clustering.adaptive_clusters(df, "vec_id", "embedding", 0.35, least, **cut))
    want = plain_adaptive(v, 0.35, least, 4, 0.95, cut.get("farthest", 0.6))
    assert got == list(enumerate(want)) and -1 in want


def test_scratch_lists_tables_made_inside(spark):
    from lumenflow.session import durable, release, scratch

    before = durable(spark.range(2))
    with scratch() as made:
        inside = durable(spark.range(3))
        kept = durable(inside.filter("id > 0"))
    assert [m._durable_path for m in made] == [inside._durable_path, kept._durable_path]
    release(inside)
    assert kept.count() == 2 and before.count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(inside._durable_path).count()
