"""Remaining scalar, ordering, set and media operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import images, text, timing, vectors
from lumenflow.operators import clustering, folds, spatial
from lumenflow.plans.registry import query
from lumenflow.queries.vectorsets import _EDGE, _diverse_sql
from lumenflow.session import durable, table


@query("p06_frame_gate", "SELECT l_orderkey, round(avg(l_discount) FILTER (l_discount >= 0.03), 6) AS mean FROM lineitem GROUP BY 1 HAVING avg(l_discount) FILTER (l_discount >= 0.03) >= 0.0601")
def p06(spark, d):
    mean = F.avg(F.when(F.col("l_discount") >= 0.03, F.col("l_discount")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(mean.alias("m")).filter("m >= 0.0601").select("l_orderkey", F.round("m", 6).alias("mean"))


@query("p18_drop_private", "SELECT event_id, event_type FROM events")
def p18(spark, d):
    e = table(spark, d, "events").withColumn("_feature", F.col("value")).select("event_id", "event_type", "_feature")
    return e.drop(*[c for c in e.columns if c.startswith("_")])


@query("p22_optional_metadata", "SELECT doc_id, lang FROM documents")
def p22(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.struct("source", "n_chars").alias("metadata"))
    return docs.drop("metadata")


@query("j18_parent_reattach", "SELECT c.event_id, o.o_orderpriority FROM events c JOIN orders o ON o.o_orderkey = c.event_id + 1")
def j18(spark, d):
    chunks = table(spark, d, "events").select("event_id", (F.col("event_id") + 1).alias("o_orderkey"))
    return chunks.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").select("event_id", "o_orderpriority")


@query("j20_collected_children", "SELECT o_orderkey, coalesce(string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS faces FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_tax > 0.05 GROUP BY 1")
def j20(spark, d):
    li = table(spark, d, "lineitem").filter("l_tax > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("f"))
    said = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left").select("o_orderkey", F.coalesce(said, F.lit("")).alias("faces"))


@query("a22_score_ranges", "SELECT user_id % 10 AS q, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS span FROM events GROUP BY 1")
def a22(spark, d):
    g = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("q"))
    return g.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query("o01_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def o01(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(50).select("event_id", "value")


@query("o04_reading_order", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY coalesce(CASE WHEN l_tax > 0.01 THEN l_linenumber END, 0), l_extendedprice, l_partkey) AS read FROM lineitem GROUP BY 1")
def o04(spark, d):
    page = F.coalesce(F.when(F.col("l_tax") > 0.01, F.col("l_linenumber")), F.lit(0)).alias("page")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(page, "l_extendedprice", "l_partkey"))).alias("r"))
    return g.select("l_orderkey", F.array_join(F.transform("r", lambda x: x["l_partkey"].cast("string")), ",").alias("read"))


@query("o05_time_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), value DESC, event_id)::INTEGER AS i FROM events")
def o05(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.date_trunc("day", "ts"), F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("i"))


@query("o06_limit_per_kind", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i <= 10")
def o06(spark, d):
    w = Window.partitionBy("event_type").orderBy("event_id")
    return table(spark, d, "events").withColumn("i", F.row_number().over(w)).filter("i <= 10").select("event_type", "event_id")


@query("o07_truncations", "SELECT doc_id, left(text, 200) AS preview, array_to_string(string_split(text, ' ')[1:8], '|') AS tags FROM documents")
def o07(spark, d):
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(200)).alias("preview"), F.array_join(F.slice(F.split("text", " ", -1), 1, 8), "|").alias("tags"))


@query("u01_union_tagged", "SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer")
def u01(spark, d):
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))
    return s.unionByName(table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")))


@query("u03_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u03(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").subtract(used)


@query("u06_chunk_concatenation", "SELECT event_id, row_number() OVER (ORDER BY event_id % 3, event_id)::BIGINT - 1 AS ord FROM events")
def u06(spark, d):
    # three chunks' outputs in order: counts by chunk give offsets, so no row passes through a single task
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("chunk"))
    offsets = e.groupBy("chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy("event_id")) - 1
    return e.withColumn("i", inside).join(offsets.select("chunk", before.alias("b")), "chunk").select("event_id", (F.col("b") + F.col("i")).alias("ord"))


@query("f11_key_phrase", "SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(split_part(text, '.', 1)), '[\\p{L}\\p{N}_]+'), lambda w: length(w) > 3)[1:4], ' ') AS phrase FROM conversations")
def f11(spark, d):
    words = F.filter(text.tokens(F.split_part("text", F.lit("."), F.lit(1))), lambda w: F.length(w) > 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(words, 1, 4), " ").alias("phrase"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("f12_fallback_summary", f"SELECT doc_id, array_to_string(s[1:2], ' ') || CASE WHEN len(s) > 4 THEN ' Overall: ' || s[len(s)] ELSE '' END AS summary FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def f12(spark, d):
    s = text.sentences(F.col("text"))
    tail = F.when(F.size(s) > 4, F.concat(F.lit(" Overall: "), F.element_at(s, -1))).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat(F.array_join(F.slice(s, 1, 2), " "), tail).alias("summary"))


@query("m03_slice_display", "SELECT event_id, format('{:02d}:{:02d}:{:06.3f}', (value * 20)::BIGINT // 3600, (value * 20)::BIGINT // 60 % 60, round(value, 3) % 60) AS shown FROM events")
def m03(spark, d):
    whole = F.round(F.col("value") * 20).cast("long")
    return table(spark, d, "events").select("event_id", F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor(whole / 60) % 60, F.round("value", 3) % 60).alias("shown"))


@query("m07_sample_index", "SELECT event_id, round_even(value * 16, 0)::BIGINT AS nearest, floor(value * 16)::BIGINT AS cut FROM events")
def m07(spark, d):
    from lumenflow.sources.wav import sample_index

    return table(spark, d, "events").select("event_id", sample_index(F.col("value"), 16, True).alias("nearest"), sample_index(F.col("value"), 16, False).alias("cut"))


@query("m08_overlap_length", "SELECT a.event_id, greatest(0, least(a.value + 10, b.value + 30) - greatest(a.value, b.value)) AS o FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def m08(spark, d):
    e = table(spark, d, "events")
    nxt = e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("v"))
    return e.join(nxt, "event_id").select("event_id", timing.overlap(F.col("value"), F.col("value") + 10, F.col("v"), F.col("v") + 30).alias("o"))


@query("m10_polygon_boxes", "SELECT l_orderkey, min(l_linenumber) AS x1, min(l_suppkey) AS y1, max(l_linenumber) AS x2, max(l_suppkey) AS y2 FROM lineitem GROUP BY 1")
def m10(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y"))).alias("p"))
    return g.select("l_orderkey", images.polygon_box(F.col("p")).alias("b")).select("l_orderkey", "b.*")


@query("m11_cosines", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m11(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("c"))


@query("m13_perceptual_hash", None)
def m13(spark, d):
    tile = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.col("embedding").cast("array<double>")))
    h = table(spark, d, "embeddings").select("vec_id", images.phash_column(tile).alias("h"))
    return h.select("vec_id", "h", F.round(vectors.hamming_share(F.col("h"), F.lit(0).cast("long")), 6).alias("share"))


@query("m15_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding))::INTEGER - 1 AS best, list_max(embedding)::DOUBLE >= 0.25 AS sure FROM embeddings")
def m15(spark, d):
    v = vectors.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", vectors.argmax(v).alias("best"), (F.array_max(v) >= 0.25).alias("sure"))


@query("m16_motion_ratio", "SELECT a.vec_id, round(len(list_filter(generate_series(1, 64), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) > 0.15)) / 64.0::DOUBLE, 6) AS moved FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m16(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(images.motion_ratio(F.col("v"), F.col("w"), 0.15), 6).alias("moved"))


@query("m19_label_scores", "SELECT user_id, arg_max(event_type, (n, event_type)) AS top, max(n)::BIGINT AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def m19(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("scores"))
    best = F.array_max(F.transform(F.map_entries("scores"), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    return m.select("user_id", best["k"].alias("top"), best["n"].alias("n"))


@query("k01_json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def k01(spark, d):
    c = table(spark, d, "conversations")
    lines = c.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    from lumenflow.session import shared_dir

    import uuid

    path = f"{shared_dir(spark)}/lumenflow-json-{uuid.uuid4().hex}"
    lines.write.text(path)
    return spark.read.schema(c.select("conv_id", "turn", "role", "text").schema).json(path)


@query("s03_tolerant_json", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 2 ELSE 0 END::INTEGER AS n FROM events")
def s03(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "[{broken").otherwise(F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]")))
    items = F.coalesce(F.from_json(raw, "array<struct<k:int>>"), F.expr("cast(array() as array<struct<k:int>>)"))
    return table(spark, d, "events").select("event_id", F.size(F.filter(items, lambda x: x.isNotNull() & x["k"].isNotNull())).alias("n"))


@query("s12_frame_times", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 0 THEN value * 2 END, value * 3) AS t FROM events")
def s12(spark, d):
    said = [F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")), F.when(F.col("event_id") % 3 == 0, (F.col("value") * 2).cast("string")).otherwise("N/A"), (F.col("value") * 3).cast("string")]
    return table(spark, d, "events").select("event_id", F.coalesce(*[c.try_cast("double") for c in said]).alias("t"))


@query("s14_wav_envelope", None)
def s14(spark, d):
    return _tones(spark, d, "envelope").groupBy("vec_id").agg(F.count("*").alias("frames"), F.round(F.max("db"), 3).alias("peak"))


@query("x05_voice_activity", None)
def x05(spark, d):
    return _tones(spark, d, "activity").select("vec_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def _tones(spark, d, what: str):
    """A short WAV made from each vector: its components as loudness steps of a tone."""
    import numpy as np
    import pandas as pd

    from lumenflow.sources import wav

    def tone(batches):
        t = np.arange(16000) / 16000
        for b in batches:
            steps = [np.repeat(np.asarray(v, np.float64), 250) for v in b["embedding"]]
            yield pd.DataFrame({"vec_id": b["vec_id"], "wav": [wav.write_wav(np.sin(2 * np.pi * 440 * t) * np.abs(s), 16000) for s in steps]})

    media = table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(tone, "vec_id long, wav binary")
    return wav.envelope(media, "vec_id") if what == "envelope" else wav.activity(media, "vec_id", -22.0, -35.0, 0.05)


@query("c05_cluster_keyframes", _diverse_sql("SELECT cluster, vec_id, embedding FROM embeddings JOIN cl ON cl.id = vec_id", "cluster", 0.6, f"{_EDGE % '0.65'}, cc AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e0.b, cc.root FROM cc JOIN e0 ON e0.a = cc.id WHERE cc.root < e0.b), cl AS (SELECT id, (dense_rank() OVER (ORDER BY min(root)) - 1)::INTEGER AS cluster FROM cc GROUP BY 1),"))
def c05(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", vectors.doubles(F.col("embedding")))
    own = clustering.dbscan(e, "vec_id", "embedding", 0.65, 1).withColumnRenamed("id", "vec_id")
    return folds.fold(e.join(own, "vec_id"), ["cluster"], ["vec_id"], ["vec_id", "embedding"], lambda: folds.Diverse(0.6), "kept long")


@query("c06_face_aware_clusters", None)
def c06(spark, d):
    # persons whose box matches a face take the face's vector
    box = lambda shift: table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("frame"), F.col("vec_id").alias("id"), ((F.col("vec_id") * 7 + shift) % 40).alias("x1"), ((F.col("vec_id") * 13 + shift) % 40).alias("y1")).withColumn("x2", F.col("x1") + 12).withColumn("y2", F.col("y1") + 12)
    faces = box(2).withColumnRenamed("id", "face")  # boxes too far from any stay without a face
    matched = spatial.iou_argmax(box(0), faces, "frame", "id", "face", 0.4, True).select("id", "face")
    v = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    own = matched.join(v.withColumnsRenamed({"vec_id": "id", "v": "own"}), "id").join(v.withColumnsRenamed({"vec_id": "face", "v": "fv"}), "face", "left")
    return clustering.adaptive_clusters(own.select("id", F.coalesce("fv", "own").alias("v")), "id", "v", 0.6, 1, attempts=6, same=0.99, farthest=0.4)


@query("x11_rerank", f"SELECT event_id, round(value / 500 - ln(1 + user_id) / 100, 6) AS score FROM events")
def x11(spark, d):
    from lumenflow.plans.models import rerank_score

    return table(spark, d, "events").select("event_id", F.round(rerank_score(F.col("value") / 500, F.col("user_id")), 6).alias("score"))


@query("x20_scenes", f"""WITH d AS (SELECT label, vec_id, abs(embedding[1]::DOUBLE - lag(embedding[1]::DOUBLE) OVER (PARTITION BY label ORDER BY vec_id)) AS ch FROM embeddings),
s AS (SELECT label, vec_id, sum((coalesce(ch, 1) > 0.2)::INT) OVER (PARTITION BY label ORDER BY vec_id) AS scene FROM d) SELECT label, (scene - 1)::INTEGER AS scene, min(vec_id) AS first_frame, max(vec_id) AS last_frame FROM s GROUP BY 1, 2""")
def x20(spark, d):
    # stand-in scene detection: a change of the feature above a threshold
    from lumenflow.operators.intervals import islands

    w = Window.partitionBy("label").orderBy("vec_id")
    x = F.get("embedding", F.lit(0)).cast("double")
    rows = islands(table(spark, d, "embeddings").withColumn("x", x), ["label"], [F.col("vec_id")], F.abs(F.col("x") - F.lag("x").over(w)) > 0.2)
    return rows.groupBy("label", (F.col("island") - 1).cast("int").alias("scene")).agg(F.min("vec_id").alias("first_frame"), F.max("vec_id").alias("last_frame"))
