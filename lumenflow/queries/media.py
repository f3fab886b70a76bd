"""Sources, sinks, planners, model boundary and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import planners
from lumenflow.plans import gates, models
from lumenflow.plans.registry import query
from lumenflow.session import table
from lumenflow.sources import markdown, sinks, transcripts
from lumenflow.streaming import windows as streams


@query("s02_transcript_scan", "SELECT conv_id, turn::INTEGER AS ord, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn, trim(text) AS text FROM conversations) WHERE text <> ''")
def s02(spark, d):
    seg = F.struct("turn", F.col("text"), F.col("turn").cast("string").alias("start"))
    raw = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(seg)).alias("segments"))
    raw = raw.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json("segments")).otherwise(F.to_json(F.struct("segments"))).alias("value"))
    return transcripts.segments_of(raw, "conv_id", "value").select("conv_id", "ord", "text")


@query("s04_element_scan", "SELECT doc_id, i::INTEGER AS i, trim(line) AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE length(trim(line)) >= 10")
def s04(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.filter(F.length(F.trim("line")) >= 10).select("doc_id", "i", F.trim("line").alias("body"))


@query("s05_document_text", """WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT * FROM e WHERE trim(line) <> ''),
g AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) SELECT doc_id, substr(string_agg(line, chr(10) ORDER BY i), 1, 1000) AS text FROM g WHERE b < 1000 GROUP BY 1""")
def s05(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return transcripts.document_text(rows, "doc_id", "i", "line", 1000)


@query("s06_rttm_scan", "SELECT user_id::VARCHAR AS media, round(value, 2) AS start, round(round(value, 2) + 5.25, 2) AS \"end\", event_type AS speaker FROM events")
def s06(spark, d):
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("user_id"), F.lit("1"), F.round("value", 2).cast("string"), F.lit("5.25"), F.lit("<NA>"), F.lit("<NA>"), F.col("event_type"), F.lit("<NA>"))
    lines = table(spark, d, "events").select(line.alias("value")).unionByName(spark.range(1).select(F.lit("too short").alias("value")))
    return transcripts.parse_rttm(lines).select("media", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "speaker")


@query("s08_links", "SELECT page_id, len(l)::INTEGER AS n, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages)")
def s08(spark, d):
    found = markdown.links(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, " ").alias("links"))


@query("s18_table_cells", "SELECT n_nationkey, n_name || ',\"' || r_name || ', \"\"x\"\"\"' || chr(10) || r_name || ',2' AS csv FROM nation JOIN region ON r_regionkey = n_regionkey")
def s18(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    html = F.concat(F.lit("<table><tr><th><b>"), "n_name", F.lit("</b></th><td> "), "r_name", F.lit(', "x"</td></tr><tr></tr>\n<tr><td>'), "r_name", F.lit("</td><td>2</td></tr></table>"))
    return sinks.csv_lines(n.select("n_nationkey", markdown.cells(html).alias("cells")), "n_nationkey", "cells")


@query("s19_image_dedup", "SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_quantity >= 10 GROUP BY 1")
def s19(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 10").groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))


@query("s21_source_priority", "SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'aligned' ELSE 'transcript' END AS source, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' OR NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_returnflag = 'R') GROUP BY 1, 2")
def s21(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    out = transcripts.best_source(table(spark, d, "orders"), "o_orderkey", ("aligned", li.filter("l_returnflag = 'R'")), ("transcript", li))
    return out.groupBy("o_orderkey", "source").agg(F.count("*").alias("n"))


@query("s22_sane_turns", "SELECT event_id FROM events WHERE value > 50")
def s22(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit(50.0).alias("start"), F.col("value").cast("string").try_cast("double").alias("end"), F.col("event_type").alias("speaker"))
    return transcripts.sane_turns(e).select("event_id")


@query("s23_word_rows", """WITH x AS (SELECT conv_id, turn, w, i FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations)),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS ordinal FROM x) SELECT conv_id, ordinal::INTEGER AS ordinal, w AS word FROM y WHERE trim(w) <> ''""")
def s23(spark, d):
    words = F.transform(F.split("text", " ", -1), lambda w: F.struct(w.alias("word"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end")))
    c = table(spark, d, "conversations").select("conv_id", "turn", words.alias("words"))
    return transcripts.word_rows(c, "conv_id", "turn", "words").select("conv_id", "ordinal", "word")


@query("s07_recorded_search", "SELECT r_name AS query, CASE WHEN r_regionkey % 2 = 0 THEN 'web' ELSE 'video' END AS source, i::INTEGER AS rank, r_name || i AS title FROM region, range(1, 4) t(i)")
def s07(spark, d):
    import json

    from lumenflow.sources.search import RecordedSearch

    spark.dataSource.register(RecordedSearch)
    # recorded hits of a fixed query list: the five regions
    names = table(spark, d, "region").select("r_regionkey", "r_name").collect()
    hits = {r["r_name"]: {"web" if r["r_regionkey"] % 2 == 0 else "video": [{"title": f"{r['r_name']}{i}", "href": f"https://x/{i}", "body": ""} for i in (1, 2, 3, 4)]} for r in names}
    return spark.read.format("recorded_search").option("hits", json.dumps(hits)).option("most", "3").load().select("query", "source", "rank", "title")


@query("k02_subtitles", """SELECT conv_id, string_agg(n::VARCHAR || chr(10) || format('00:{:02d}:{:02d},000', (n - 1) * 10 // 60, (n - 1) * 10 % 60) || ' --> ' || format('00:{:02d}:{:02d},500', (n * 10 - 1) // 60, (n * 10 - 1) % 60) || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt
FROM (SELECT conv_id, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY 1""")
def k02(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.trim("text")))
    c = table(spark, d, "conversations").select("conv_id", "text", n.alias("n"))
    c = c.select("conv_id", "text", ((F.col("n") - 1) * 10.0).alias("a"), (F.col("n") * 10 - 0.5).alias("z"))
    return sinks.subtitles(c, "conv_id", "a", "z", "text")


@query("k03_plain_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def k03(spark, d):
    return sinks.plain_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("k04_html_tables", "SELECT r_regionkey, '<table><tr><td>' || r_name || '</td><td>a&lt;b &amp; c</td></tr></table>' AS html FROM region")
def k04(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.array(F.array("r_name", F.lit("a<b & c"))).alias("cells"))
    return sinks.html_table(r, "r_regionkey", "cells")


@query("k05_snapshots", "SELECT format('page_{:04d}.md', 7 + row_number() OVER (ORDER BY url, page_id)) AS name, length('<!-- Source: ' || url || ' -->' || chr(10) || '<!-- Status: 200 -->' || chr(10) || chr(10) || html)::INTEGER AS n FROM pages")
def k05(spark, d):
    p = table(spark, d, "pages").withColumn("status", F.lit("200"))
    return sinks.snapshots(p, "url", "status", "html", 7, ("page_id",)).select("name", F.length("content").alias("n"))


@query("k09_mosaics", "SELECT media, tile, array_to_string(list(vec_id ORDER BY vec_id), ',') AS frames FROM (SELECT label AS media, vec_id, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 12)::INTEGER AS tile FROM embeddings) GROUP BY 1, 2")
def k09(spark, d):
    out = sinks.mosaics(table(spark, d, "embeddings").withColumnRenamed("label", "media"), "media", "vec_id", 3, 4)
    return out.select("media", "tile", F.array_join("frames", ",").alias("frames"))


@query("k10_run_summary", "SELECT n_name AS module, coalesce(s.seconds, 0.0)::DOUBLE AS seconds, coalesce(s.status, 'not_run') AS status FROM nation LEFT JOIN (SELECT r_name AS module, 1.5 AS seconds, 'ok' AS status FROM region) s ON s.module = n_name UNION ALL SELECT r_name, 1.5, 'ok' FROM region")
def k10(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    planned = n.select(F.col("n_name").alias("module")).unionByName(r.select(F.col("r_name").alias("module")))
    return sinks.run_summary(planned, r.select(F.col("r_name").alias("module"), F.lit(1.5).alias("seconds"), F.lit("ok").alias("status")))


@query("w21_even_samples", "SELECT DISTINCT o_orderkey, floor((total - 1) * i / 7)::BIGINT AS frame FROM (SELECT o_orderkey, floor(o_totalprice / 100)::BIGINT + 1 AS total, unnest(range(0, 8)) AS i FROM orders)")
def w21b(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 100) + 1).cast("long").alias("total"))
    return planners.even_samples(o, "total", 8).select("o_orderkey", "frame")


@query("w21_clip_starts", """SELECT event_id, i::INTEGER AS i, round(CASE WHEN value <= 16 THEN greatest(0.0, value / 2 - 8) ELSE (value - 16) * i / (n - 1) END, 6)::DOUBLE AS clip_start
FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT event_id, value, CASE WHEN value <= 16 THEN 1 ELSE greatest(3, ceil((value - 16) / 12.0::DOUBLE)::BIGINT + 1) END AS n FROM events))""")
def w21c(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", F.lit(0.0).alias("a"), F.col("value").alias("z"))
    out = planners.clip_starts(e, "a", "z", 16.0, 0.25)
    i = F.row_number().over(Window.partitionBy("event_id").orderBy("clip_start")) - 1
    return out.select("event_id", i.alias("i"), F.round("clip_start", 6).alias("clip_start"))


@query("p17_dependency_gate", "SELECT 'ok' AS status, count(*) AS n FROM region")
def p17(spark, d):
    gates.require({"region", "nation"}, "region")
    return table(spark, d, "region").agg(F.count("*").alias("n")).select(F.lit("ok").alias("status"), "n")


@query("x09_entities", None)
def x09(spark, d):
    return models.find_entities(table(spark, d, "documents"), "doc_id", "text")


@query("x06_stand_ins", "SELECT t.k AS kind, count(*) AS n FROM events, (VALUES ('speech_emotion'), ('audio_tagging'), ('actions')) t(k) GROUP BY 1")
def x06(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("media"), F.col("value").alias("start"), (F.col("value") + 2).alias("end"))
    out = None
    for kind in models.KINDS:
        if kind.name in ("speech_emotion", "audio_tagging", "actions"):
            rows = models.stand_in(kind, e).select(F.lit(kind.name).alias("kind"))
            out = rows if out is None else out.unionByName(rows)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("t01_hopping_windows", "SELECT epoch_us(w) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2")
def t01(spark, d):
    e = streams.read_events(spark, f"{d}/events.parquet")
    out = streams.hopping(e, "ts", "2 days", "1 day", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("v"))
    return streams.run_once(out, "complete").select(F.unix_seconds("window.start").alias("start"), "event_type", "n", F.round("v", 2).alias("v"))


@query("t02_sessions", """WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM h GROUP BY user_id, s""")
def t02(spark, d):
    e = streams.read_events(spark, f"{d}/events.parquet")
    out = streams.sessions(e, "ts", "6 hours", ["user_id"], F.count("*").alias("n"))
    return streams.run_once(out, "complete").select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


@query("t03_first_seen", "SELECT event_type, user_id FROM events GROUP BY 1, 2")
def t03(spark, d):
    e = streams.read_events(spark, f"{d}/events.parquet", delay="60 days")
    return streams.run_once(streams.first_seen(e, ["event_type", "user_id"]), "append").select("event_type", "user_id")


@query("t04_last_kept", """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events WHERE value IS NOT NULL),
m AS (SELECT user_id, i, value AS last, true AS kept FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.i, CASE WHEN abs(r.value - m.last) >= 25 THEN r.value ELSE m.last END, abs(r.value - m.last) >= 25 FROM m JOIN r ON r.user_id = m.user_id AND r.i = m.i + 1)
SELECT user_id AS k, last::DOUBLE AS v FROM m WHERE kept""")
def t04(spark, d):
    e = streams.read_events(spark, f"{d}/events.parquet")
    return streams.run_once(streams.last_kept(e, "user_id", "ts", "value", 25.0), "append")
