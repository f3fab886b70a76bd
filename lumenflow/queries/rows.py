"""Queries for operators that others only use in passing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import text, timing, vectors
from lumenflow.operators import planners, resources, sequences, spatial
from lumenflow.plans.registry import query
from lumenflow.queries.timelines import EV, _box_sql, _boxes, _events
from lumenflow.session import table
from lumenflow.sources import paths, transcripts


@query("s15_fixed_split", "SELECT o_orderkey, i::INTEGER AS chunk, i * 90000 AS start, least(total, (i + 1) * 90000) AS stop FROM (SELECT o_orderkey, total, unnest(range(0, greatest(1, (total + 89999) // 90000))) AS i FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS total FROM orders))")
def s15(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("total"))
    return planners.fixed_chunks(o, "total", 90000).select("o_orderkey", "chunk", "start", "stop")


@query("s24_captions", "SELECT conv_id, turn, 0 AS ord, 'img_' || turn || '.png' AS file, text AS caption FROM conversations WHERE turn % 4 <> 3 AND trim(text) <> ''")
def s24a(spark, d):
    c = table(spark, d, "conversations")
    whole = F.to_json(F.array(F.struct(F.format_string("img_%d.png", "turn").alias("file"), F.col("text").alias("caption")), F.struct(F.lit("none.png").alias("file"), F.lit(" ").alias("caption"))))
    raw = c.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    return transcripts.captions(raw, ["conv_id", "turn"]).select("conv_id", "turn", "ord", "file", "caption")


@query("s24_frame_texts", "SELECT event_id, k::INTEGER AS ord, (user_id + k)::INTEGER AS frame, event_type || k AS text, value AS confidence FROM events, (VALUES (0), (1)) t(k) WHERE event_id % 5 <> 0")
def s24b(spark, d):
    entry = lambda k: F.struct((F.col("user_id") + k).cast("int").alias("frame"), F.lit(1.5).alias("time"), F.concat("event_type", F.lit(str(k))).alias("text"), F.col("value").alias("confidence"))
    whole = F.to_json(F.struct(F.lit(30).alias("fps"), F.array(entry(0), entry(1)).alias("frames")))
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit('{"fps": 30}')).otherwise(whole).alias("value"))
    return transcripts.frame_texts(raw, ["event_id"]).select("event_id", "ord", "frame", "text", "confidence")


@query("s24_manifest", "SELECT p_partkey, 0 AS ord, p_name AS file, (p_partkey % 9)::INTEGER AS page, p_size::INTEGER AS width, 2 * p_size::INTEGER AS height FROM part")
def s24c(spark, d):
    entry = F.struct(F.col("p_name").alias("file"), (F.col("p_partkey") % 9).alias("page"), F.col("p_size").alias("width"), (F.col("p_size") * 2).alias("height"))
    raw = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.array(entry).alias("images"))).alias("value"))
    return transcripts.manifest_images(raw, ["p_partkey"])


@query("s25_mount_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/mnt/in/' || page_id || '.mp4' WHEN 2 THEN '/media/inside/' || page_id ELSE '/mnt/in' END AS path FROM pages")
def s25(spark, d):
    p, n = F.col("page_id"), F.col("page_id").cast("string")
    said = F.when(p % 4 == 0, F.col("url")).when(p % 4 == 1, F.concat(F.lit("/media/in/"), n, F.lit(".mp4"))).when(p % 4 == 2, F.concat(F.lit("/media/inside/"), n)).otherwise(F.lit("/media/in"))
    return table(spark, d, "pages").select("page_id", paths.mount_path(said, "/media/in", "/mnt/in").alias("path"))


@query("j07_mask_join", f"""WITH best AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY iou DESC, b.id) AS rk, iou FROM (SELECT a.id AS aid, b.id AS bid, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS bb, inter::DOUBLE / (aa + bb - inter) AS iou FROM {_box_sql(0)} a JOIN {_box_sql(5)} b ON a.frame = b.frame) p JOIN {_box_sql(0)} a ON a.id = p.aid JOIN {_box_sql(5)} b ON b.id = p.bid)
SELECT a.frame, a.id, CASE WHEN iou >= 0.5 THEN 'mask ' || other END AS mask FROM {_box_sql(0)} a LEFT JOIN best ON best.id = a.id AND rk = 1""")
def j07(spark, d):
    masks = _boxes(spark, d, 5).withColumnRenamed("id", "other").withColumn("mask", F.concat(F.lit("mask "), F.col("other").cast("string")))
    return spatial.mask_join(_boxes(spark, d, 0), masks, "frame", "id", "other", "mask", 0.5).select("frame", "id", "mask")


@query("a13_percentiles", "SELECT event_type, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.4), 6) AS p40, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(p / 100)), 6).alias(f"p{p}") for p in (75, 40, 95)])


@query("a19_any_all", "SELECT user_id, bool_or(value > 190) AS any_high, bool_and(value > 1) AS all_up, bool_or(event_type = 'error') AS any_error FROM events GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 190).alias("any_high"), F.bool_and(F.col("value") > 1).alias("all_up"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query("a23_resource_summary", "SELECT user_id, count(*) AS samples, round(avg(value % 100), 6) AS cpu_mean, max(value % 100) AS cpu_max, round(avg(CASE WHEN user_id % 2 = 0 THEN value / 10 END), 6) AS gpu_mean FROM events GROUP BY 1")
def a23(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("user_id", (v % 100).alias("cpu"), (v / 5).alias("ram"), (v / 100).alias("ram_gb"), F.when(F.col("user_id") % 2 == 0, v / 10).alias("gpu"), F.lit(None).cast("double").alias("gpu_memory"))
    return resources.resource_summary(e, ["user_id"]).select("user_id", "samples", F.round("cpu_mean", 6).alias("cpu_mean"), "cpu_max", F.round("gpu_mean", 6).alias("gpu_mean"))


@query("w27_margin", f"WITH {EV} SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM ev) WHERE best - value <= 40")
def w27(spark, d):
    return sequences.margin_filter(_events(spark, d), ["user_id"], "value", 40.0).select("user_id", "event_id")


@query("f21_shell_quote", "SELECT doc_id, CASE WHEN regexp_full_match(coalesce(a, ''), '[\\p{L}\\p{Nd}./:_=-]*') THEN a ELSE chr(39) || replace(a, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END AS quoted FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '/' || doc_id || '.mp4' WHEN 1 THEN 'it''s ' || substr(text, 1, 40) ELSE text END AS a FROM documents)")
def f21(spark, d):
    i = F.col("doc_id") % 3
    a = F.when(i == 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4"))).when(i == 1, F.concat(F.lit("it's "), F.substring("text", 1, 40))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.shell_quote(a).alias("quoted"))


@query("m02_chapter_time", "SELECT event_id, CASE WHEN ms >= 3600000 THEN lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS chapter FROM (SELECT event_id, event_id * 7919 % 9000000 AS ms FROM events)")
def m02(spark, d):
    return table(spark, d, "events").select("event_id", timing.chapter_time((F.col("event_id") * 7919 % 9000000) / 1000).alias("chapter"))


@query("m09_iou", f"SELECT a.id, round(inter::DOUBLE / (aa + bb - inter), 9) AS iou FROM (SELECT a.id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS bb FROM {_box_sql(0)} a JOIN {_box_sql(4)} b USING (id)) a")
def m09(spark, d):
    corners = ("x1", "y1", "x2", "y2")
    b = _boxes(spark, d, 4).select("id", *[F.col(c).alias(f"r_{c}") for c in corners])
    return _boxes(spark, d, 0).join(b, "id").select("id", F.round(vectors.iou(tuple(F.col(c) for c in corners), tuple(F.col(f"r_{c}") for c in corners)), 9).alias("iou"))


@query("m12_softmax", "SELECT vec_id, i::INTEGER AS i, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM (SELECT vec_id, i, exp(embedding[i + 1]::DOUBLE / 0.7) AS e FROM embeddings, generate_series(0, 63) t(i))")
def m12(spark, d):
    p = vectors.softmax(vectors.doubles(F.col("embedding")), 0.7)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(p).alias("i", "p")).select("vec_id", "i", F.round("p", 9).alias("p"))


@query("m14_decibel", f"WITH {EV} SELECT user_id, event_id, round(20 * log10(sqrt((value * value + coalesce(p, 0) * coalesce(p, 0)) / CASE WHEN p IS NULL THEN 1 ELSE 2 END) + 1e-9), 6) AS db FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)")
def m14(spark, d):
    # the level of each two neighbouring samples
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(-1, 0)
    return _events(spark, d).select("user_id", "event_id", F.round(20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)) + 1e-9), 6).alias("db"))


@query("m17_frame_skip", "SELECT event_id, greatest(0, ceil((24 + user_id % 37) / (1 + event_id % 9)::DOUBLE)::BIGINT - 1) AS skip FROM events")
def m17(spark, d):
    return table(spark, d, "events").select("event_id", timing.frame_skip((24 + F.col("user_id") % 37).cast("double"), (1 + F.col("event_id") % 9).cast("double")).alias("skip"))
