"""Filters, scalar functions, sources and sinks (projections, strings, time, JSON)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import jsonx, text, timing
from lumenflow.plans.registry import query
from lumenflow.session import table

_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def _in(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


@query("p01_hit_normalise", "SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1)) AS title, trim(url) AS url FROM pages WHERE trim(url) <> ''")
def p01(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.trim(F.regexp_extract("html", r"<h1[^>]*>(.*?)</h1>", 1)).alias("title"), F.trim("url").alias("url")).filter("url <> ''")


@query("p02_first_filled", "SELECT doc_id, coalesce(nullif(trim(string_split(text, chr(10))[2]), ''), nullif(trim(lang), ''), 'Result ' || doc_id) AS title FROM documents")
def p02(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", text.first_filled(F.get(F.split("text", "\n"), F.lit(1)), F.col("lang"), F.concat(F.lit("Result "), F.col("doc_id"))).alias("title"))


@query("p03_text_assembly", "SELECT conv_id, turn, concat_ws(' ', nullif(trim(role), ''), nullif(trim(text), ''), CASE WHEN role = 'system' THEN 'Publisher: ' || conv_id END) AS body FROM conversations WHERE trim(text) <> ''")
def p03(spark, d):
    c = table(spark, d, "conversations")
    nz = lambda x: F.nullif(F.trim(x), F.lit(""))
    return c.filter(F.trim("text") != "").select("conv_id", "turn", F.concat_ws(" ", nz("role"), nz("text"), F.when(F.col("role") == "system", F.concat(F.lit("Publisher: "), F.col("conv_id")))).alias("body"))


@query("p04_confidence_at_least", "SELECT event_id, event_type, value FROM events WHERE value / 490.0::DOUBLE >= 0.5")
def p04(spark, d):
    return table(spark, d, "events").filter(F.col("value") / 490.0 >= 0.5).select("event_id", "event_type", "value")


@query("p05_confidence_above", "SELECT event_id, event_type, value FROM events WHERE value > 0.35")
def p05(spark, d):
    return table(spark, d, "events").filter("value > 0.35").select("event_id", "event_type", "value")


@query("p07_length_filters", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE length(trim(text)) >= 10 AND length(lang) >= 2")
def p07(spark, d):
    return table(spark, d, "documents").filter((F.length(F.trim("text")) >= 10) & (F.length("lang") >= 2)).select("doc_id", F.length(F.trim("text")).cast("long").alias("n"))


@query("p08_stop_list", f"SELECT w, count(*) AS c FROM (SELECT unnest({_TOK.format('text')}) AS w FROM conversations) WHERE length(w) >= 2 AND lower(w) NOT IN ({_in(text.STOP_DOCS)}) GROUP BY w")
def p08(spark, d):
    words = table(spark, d, "conversations").select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return words.filter((F.length("w") >= 2) & ~F.lower("w").isin(*text.STOP_DOCS)).groupBy("w").agg(F.count("*").alias("c"))


@query("p09_class_allow_list", "SELECT event_type, count(*) AS c FROM events WHERE event_type IN (SELECT t FROM (VALUES ('click'), ('purchase'), ('nosuch')) v(t)) GROUP BY 1")
def p09(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase", "nosuch")).groupBy("event_type").agg(F.count("*").alias("c"))


@query("p10_video_host", "SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '(youtube\\.com|youtu\\.be|\\.org)$') AS is_video, url LIKE '%example%' AS has_part FROM pages")
def p10(spark, d):
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").select("page_id", F.coalesce(host, F.lit("")).rlike(r"(youtube\.com|youtu\.be|\.org)$").alias("is_video"), F.col("url").contains("example").alias("has_part"))


@query("p11_file_type", "SELECT name, CASE WHEN e IN ('mp3','wav','flac','ogg','m4a') THEN 'audio' WHEN e IN ('mp4','mkv','avi','mov','webm') THEN 'video' WHEN e IN ('glb','gltf','fbx','obj','stl') THEN 'model' WHEN e IN ('pdf','docx','pptx','xlsx','txt','md','html','htm','csv','tex','png','jpg','jpeg','tiff','bmp','webp') THEN 'document' ELSE 'other' END AS kind FROM (SELECT p_name || '.' || x AS name, lower(x) AS e FROM part, (VALUES ('MP3'), ('mkv'), ('obj'), ('Pdf'), ('zip')) v(x))")
def p11(spark, d):
    p = table(spark, d, "part").select(F.explode(F.array(*[F.concat("p_name", F.lit("." + x)) for x in ("MP3", "mkv", "obj", "Pdf", "zip")])).alias("name"))
    return p.select("name", text.file_type(F.col("name")).alias("kind"))


@query("p12_valid_intervals", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + l_discount * 100 > l_quantity + 5")
def p12(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter(F.col("l_quantity") + F.col("l_discount") * 100 > F.col("l_quantity") + 5).select("l_orderkey", "l_linenumber")


@query("p13_clip_minimum", "SELECT event_id, greatest(0.0::DOUBLE, value - 100) AS s, CASE WHEN least(value, 250.0::DOUBLE) - greatest(0.0::DOUBLE, value - 100) < 0.25 THEN greatest(0.0::DOUBLE, value - 100) + 0.25 ELSE least(value, 250.0::DOUBLE) END AS e FROM events")
def p13(spark, d):
    s, e = F.greatest(F.lit(0.0), F.col("value") - 100), F.least(F.col("value"), F.lit(250.0))
    return table(spark, d, "events").select("event_id", s.alias("s"), F.when(e - s < 0.25, s + 0.25).otherwise(e).alias("e"))


@query("p14_clip_box", "SELECT p_partkey, greatest(0, x1) AS x1, least(60, x2) AS x2 FROM (SELECT p_partkey, p_size - 10 AS x1, p_size * 2 AS x2 FROM part) WHERE least(60, x2) > greatest(0, x1)")
def p14(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0), F.col("p_size") - 10).alias("x1"), F.least(F.lit(60), F.col("p_size") * 2).alias("x2"))
    return p.filter("x2 > x1")


@query("p15_pad_clip", "SELECT event_id, greatest(0.0::DOUBLE, value - 0.15) AS s, least(400.0::DOUBLE, value + 0.15) AS e FROM events WHERE least(400.0::DOUBLE, value + 0.15) > greatest(0.0::DOUBLE, value - 0.15)")
def p15(spark, d):
    e = table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), F.col("value") - 0.15).alias("s"), F.least(F.lit(400.0), F.col("value") + 0.15).alias("e"))
    return e.filter("e > s")


@query("p16_time_slice", "SELECT event_id, value FROM events WHERE value >= 62.5 AND value < 200")
def p16(spark, d):
    from lumenflow.plans.gates import slice_bounds

    lo, hi = slice_bounds("01:02.5", "200", duration=1000.0)
    return table(spark, d, "events").filter((F.col("value") >= lo) & (F.col("value") < hi)).select("event_id", "value")


@query("p19_sane_indices", "SELECT DISTINCT try_cast(l_linenumber - 2 AS BIGINT) AS idx FROM lineitem WHERE l_linenumber - 2 >= 0")
def p19(spark, d):
    idx = (F.col("l_linenumber") - 2).cast("string").try_cast("long")
    return table(spark, d, "lineitem").select(idx.alias("idx")).filter("idx >= 0").distinct()


@query("p20_keyframes", "SELECT doc_id FROM labels WHERE (CASE quality WHEN 1 THEN true WHEN 0 THEN (CASE toxic WHEN 1 THEN NULL ELSE false END) END) IS DISTINCT FROM false")
def p20(spark, d):
    flag = F.when(F.col("quality") == 1, True).when(F.col("toxic") == 1, F.lit(None).cast("boolean")).otherwise(False)
    return table(spark, d, "labels").filter(~flag.eqNullSafe(F.lit(False))).select("doc_id")


@query("p21_form_rows", "SELECT c_custkey, trim(cells[1]) AS key, trim(cells[2]) AS value FROM (SELECT c_custkey, string_split(c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '|' || c_mktsegment END, '|') AS cells FROM customer) WHERE len(cells) = 2 AND lower(trim(cells[1])) NOT IN ('', 'nan', 'none')")
def p21(spark, d):
    cells = F.split(F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("|"), F.col("c_mktsegment")))), r"\|")
    c = table(spark, d, "customer").select("c_custkey", cells.alias("cells")).filter(F.size("cells") == 2)
    key = F.trim(F.get("cells", F.lit(0)))
    return c.filter(~F.lower(key).isin("", "nan", "none")).select("c_custkey", key.alias("key"), F.trim(F.get("cells", F.lit(1))).alias("value"))


@query("f01_token_counts", f"SELECT w, count(*) AS c FROM (SELECT unnest({_TOK.format('text')}) AS w FROM documents) GROUP BY w")
def f01(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))


@query("f02_word_count", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END::INTEGER AS n FROM documents")
def f02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


_SENT = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("f03_sentences", f"SELECT doc_id, len(s)::INTEGER AS n, s[1] AS first FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents)")
def f03(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.get(s, F.lit(0)).alias("first"))


@query("f04_speech_words", "SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(replace(lower(replace(replace(string_split(text, chr(10))[1], '’', ''''), '‘', '''')), '-', ' '), '[^a-z'' ]', '', 'g'), ' +', ' ', 'g')), '') AS said FROM documents")
def f04(spark, d):
    return table(spark, d, "documents").select("doc_id", text.speech_word(F.get(F.split("text", "\n"), F.lit(0))).alias("said"))


@query("f05_comment_metadata", "SELECT page_id, url AS source, '200' AS status FROM pages")
def f05(spark, d):
    from lumenflow.sources.markdown import page_header

    p = table(spark, d, "pages").withColumn("md", F.concat(page_header(F.lit("stale"), F.lit("404")), page_header(F.col("url"), F.lit("200")), F.col("html")))
    meta = text.comment_metadata(F.col("md"))
    return p.select("page_id", meta["Source"].alias("source"), meta["Status"].alias("status"))


@query("f06_page_title", "SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''), url) AS title FROM pages")
def f06(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_title(F.col("html"), F.col("url")).alias("title"))


@query("f07_key_value", "SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 3 THEN '' ELSE '' END AS key, CASE c_custkey % 4 WHEN 3 THEN '' ELSE c_mktsegment END AS value FROM customer")
def f07(spark, d):
    line = F.concat("c_name", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(": "), F.col("c_mktsegment"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("="), F.col("c_mktsegment"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" - "), F.col("c_mktsegment"))).otherwise(""))
    kv = text.key_value(line)
    return table(spark, d, "customer").select("c_custkey", kv["key"].alias("key"), kv["value"].alias("value"))


@query("f08_strip_intro", "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS caption FROM part")
def f08(spark, d):
    said = F.concat(F.when(F.col("p_partkey") % 3 == 0, "This image shows a ").when(F.col("p_partkey") % 3 == 1, "The image depicts the detailed photograph of ").otherwise(""), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.strip_intro(said).alias("caption"))


@query("f09_drop_think", "SELECT conv_id, turn, trim(text) AS said FROM conversations")
def f09(spark, d):
    raw = F.concat(F.lit("<think>a\nb"), F.col("role"), F.lit("</think>"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.drop_think(raw).alias("said"))


@query("f10_clean_title", "SELECT n_nationkey, n_name AS title FROM nation WHERE length(n_name) >= 3")
def f10(spark, d):
    raw = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "Title: ").when(F.col("n_nationkey") % 3 == 1, "Sure, **").otherwise('"'), F.col("n_name"), F.lit(".!\nmore"))
    n = table(spark, d, "nation").filter(F.length("n_name") >= 3)
    return n.select("n_nationkey", text.clean_title(raw).alias("title"))


@query("f13_sentence_cut", f"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN len(n) > 0 THEN array_to_string(s[1:list_max(n)], ' ') ELSE left(text, 200) END AS cut FROM (SELECT *, list_filter(range(1, least(len(s), 200) + 1), lambda k: length(array_to_string(s[1:k], ' ')) <= 200) AS n FROM (SELECT doc_id, text, {_SENT.format("text")} AS s FROM documents))")
def f13(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentence_cut(F.col("text"), 200).alias("cut"))


@query("f14_safe_name", "SELECT doc_id, substr(replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s-]', '', 'g'), ' ', '_'), 1, 60) AS name FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", text.safe_name(F.col("text")).alias("name"))


@query("f15_padded_names", "SELECT p_partkey, format('{:08d}', p_partkey) AS a, format('table_{:03d}', p_size) AS b, p_name || '#frame_' || format('{:08d}', p_partkey) AS c FROM part")
def f15(spark, d):
    return table(spark, d, "part").select("p_partkey", F.format_string("%08d", "p_partkey").alias("a"), F.format_string("table_%03d", "p_size").alias("b"), F.concat("p_name", F.format_string("#frame_%08d", "p_partkey")).alias("c"))


@query("f16_wordpieces", "SELECT w, replace(w, '##', '') AS word FROM (SELECT DISTINCT '##' || lang AS w FROM documents)")
def f16(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("##"), F.col("lang")).alias("w")).distinct().select("w", F.regexp_replace("w", "##", "").alias("word"))


@query("f17_page_count", "SELECT doc_id, (len(string_split(replace(text, chr(10), '-----'), '-----')))::INTEGER AS pages FROM documents")
def f17(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.size(F.split(F.replace("text", F.lit("\n"), F.lit("-----")), "-----"))).alias("pages"))


@query("f18_image_paths", "SELECT page_id, replace(html, 'href=\"', 'href=\"images/') AS html FROM pages")
def f18(spark, d):
    return table(spark, d, "pages").select("page_id", F.replace("html", F.lit('href="'), F.lit('href="images/')).alias("html"))


@query("f19_retryable", f"SELECT event_type, user_id, regexp_matches(lower(event_type || CASE WHEN user_id % 2 = 0 THEN ' Timed Out' ELSE '' END), '{'|'.join(text.RETRYABLE)}') AS again, count(*) AS c FROM events GROUP BY 1, 2, 3")
def f19(spark, d):
    said = F.concat("event_type", F.when(F.col("user_id") % 2 == 0, " Timed Out").otherwise(""))
    return table(spark, d, "events").select("event_type", "user_id", text.retryable(said).alias("again")).groupBy("event_type", "user_id", "again").agg(F.count("*").alias("c"))


@query("f20_prompts", "SELECT item_id, 'Summarise this:' || chr(10) || text || chr(10) || '---' AS prompt FROM benchmark")
def f20(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.replace(F.lit("Summarise this:\n{text}\n---"), F.lit("{text}"), F.col("text")).alias("prompt"))


_MS = "floor(round(value * 1000, 6))::BIGINT"


@query("m01_srt_time", f"SELECT event_id, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt, CASE WHEN ms >= 3600000 THEN format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) ELSE format('{{:02d}}:{{:02d}}.{{:03d}}', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) END AS chapter FROM (SELECT event_id, floor(round(value * 17 * 1000, 6))::BIGINT AS ms FROM events)")
def m01(spark, d):
    s = F.col("value") * 17
    return table(spark, d, "events").select("event_id", timing.srt_time(s).alias("srt"), timing.chapter_time(s).alias("chapter"))


@query("m04_human_duration", "SELECT l_orderkey, l_linenumber, CASE WHEN x < 60 THEN format('{:.1f}s', x) WHEN x < 3600 THEN (w // 60)::VARCHAR || 'm ' || (w % 60)::VARCHAR || 's' ELSE (w // 3600)::VARCHAR || 'h ' || (w // 60 % 60)::VARCHAR || 'm ' || (w % 60)::VARCHAR || 's' END AS took FROM (SELECT l_orderkey, l_linenumber, (l_quantity * l_quantity * l_linenumber)::DOUBLE AS x, floor(l_quantity * l_quantity * l_linenumber)::BIGINT AS w FROM lineitem)")
def m04(spark, d):
    sec = F.col("l_quantity") * F.col("l_quantity") * F.col("l_linenumber")  # from seconds to hours
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", timing.human_duration(sec.cast("double")).alias("took"))


@query("m05_parse_time", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN v * 1.0::DOUBLE WHEN 1 THEN v * 60 + 30.5::DOUBLE ELSE 3600 + v * 60 + 30.5::DOUBLE END AS sec FROM (SELECT event_id, (user_id % 60)::BIGINT AS v FROM events)")
def m05(spark, d):
    v = F.col("user_id") % 60
    said = F.when(F.col("event_id") % 3 == 0, v.cast("string")).when(F.col("event_id") % 3 == 1, F.format_string("%02d:30.5", v)).otherwise(F.format_string("1:%02d:30.5", v))
    return table(spark, d, "events").select("event_id", timing.parse_time(said).alias("sec"))


@query("m06_frames_seconds", "SELECT event_id, round(event_id / 30.0::DOUBLE, 6) AS sec, floor(value * 30)::BIGINT AS frame, round_even(value * 16, 0)::BIGINT AS nearest, greatest(0, ceil(30.0 / (1 + user_id % 7))::BIGINT - 1) AS skip FROM events")
def m06(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.round(F.col("event_id") / 30.0, 6).alias("sec"), F.floor(F.col("value") * 30).cast("long").alias("frame"), F.bround(F.col("value") * 16).cast("long").alias("nearest"), timing.frame_skip(F.lit(30.0), 1 + F.col("user_id") % 7).alias("skip")
    )


@query("m18_rounding", "SELECT event_id, round(value, 1) AS r1, round(value / 7, 3) AS r3 FROM events")
def m18(spark, d):
    return table(spark, d, "events").select("event_id", F.round("value", 1).alias("r1"), F.round(F.col("value") / 7, 3).alias("r3"))


@query("m20_llm_json", "SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN left(trim(split_part(said, chr(10), 1)), 100) ELSE role END AS document_type, CASE turn % 3 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT *, 'so ' || replace(replace(text, '{', '('), 'ocument_', 'ocument ') AS said FROM conversations)")
def m20(spark, d):
    c = table(spark, d, "conversations")
    said = F.concat(F.lit("so "), F.replace(F.replace("text", F.lit("{"), F.lit("(")), F.lit("ocument_"), F.lit("ocument ")))  # plain answers: neither JSON nor a named field
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('<think>{"no": 1}</think>Sure: {"document_type": "'), F.col("role"), F.lit('", "confidence": 0.25} done')))
    raw = raw.when(F.col("turn") % 3 == 1, F.concat(F.lit("well\nDocument_Type: "), F.col("role"))).otherwise(said)
    k = jsonx.document_type(raw)
    return c.select("conv_id", "turn", k["document_type"].alias("document_type"), k["confidence"].alias("confidence"))


@query("m21_numbers", "SELECT event_id, trunc(value)::BIGINT AS a, CASE WHEN event_id % 2 = 0 THEN event_id END AS b FROM events")
def m21(spark, d):
    return table(spark, d, "events").select("event_id", timing.to_int(F.col("value").cast("string")).alias("a"), timing.to_int(F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x")).alias("b"))


@query("m22_json_property", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS none FROM events")
def m22(spark, d):
    return table(spark, d, "events").select("event_id", jsonx.property_or(F.col("props"), "$.k", "-1").cast("long").alias("k"), jsonx.property_or(F.col("props"), "$.none", "absent").alias("none"))


@query("m23_language_names", "SELECT d.lang, coalesce(m.name, 'unknown') AS name, count(*) AS c FROM documents d LEFT JOIN (VALUES ('en', 'english'), ('de', 'german'), ('fr', 'french')) m(code, name) ON m.code = d.lang GROUP BY 1, 2")
def m23(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("en", "english", "de", "german", "fr", "french")])
    return table(spark, d, "documents").select("lang", F.coalesce(names[F.col("lang")], F.lit("unknown")).alias("name")).groupBy("lang", "name").agg(F.count("*").alias("c"))


@query("u05_match_score", f"""
WITH q AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS qt FROM benchmark),
d AS (SELECT page_id, {_TOK.format('html')} AS dt FROM pages),
x AS (SELECT item_id, len(qt) AS n, unnest(qt) AS w FROM q), y AS (SELECT DISTINCT page_id, unnest(dt) AS w FROM d)
SELECT item_id, page_id, round(count(*)::DOUBLE / max(n), 3) AS score FROM x JOIN y USING (w) GROUP BY 1, 2""")
def u05(spark, d):
    # an equi-join on tokens, so that only pairs that share one are made
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("qt"))
    x = q.select("item_id", F.size("qt").alias("n"), F.explode("qt").alias("w"))
    y = table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(text.tokens(F.col("html")))).alias("w"))
    return x.join(y, "w").groupBy("item_id", "page_id").agg(F.round(F.count("*") / F.max("n"), 3).alias("score"))
