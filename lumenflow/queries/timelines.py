"""Aggregates, interval and box joins, windows over events, orders and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.functions import text
from lumenflow.operators import intervals, sequences, spatial
from lumenflow.plans.registry import query
from lumenflow.session import table

_SEC = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", F.expr(_SEC).cast("long").alias("t"))


def _segments(spark, d):
    e = _events(spark, d).filter("event_type IN ('click', 'view')")
    return e.select("user_id", F.col("event_id").alias("seg"), F.col("t").alias("s"), (F.col("t") + F.floor(F.col("value") * 120)).cast("long").alias("e"))


def _turns(spark, d):
    e = _events(spark, d).filter("event_type NOT IN ('click', 'view')")
    return e.select("user_id", F.col("event_id").alias("turn"), F.col("t").alias("ts"), (F.col("t") + F.floor(F.col("value") * 200)).cast("long").alias("te"), F.col("event_type").alias("speaker"))


EV = "ev AS (SELECT *, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000)::BIGINT AS t FROM events)"
SEG = f"{EV}, seg AS (SELECT user_id, event_id AS seg, t AS s, t + floor(value * 120)::BIGINT AS e FROM ev WHERE event_type IN ('click', 'view')), turn AS (SELECT user_id, event_id AS turn, t AS ts, t + floor(value * 200)::BIGINT AS te, event_type AS speaker FROM ev WHERE event_type NOT IN ('click', 'view'))"


@query("j01_overlap_join", f"WITH {SEG} SELECT s.user_id, seg, turn, greatest(s, ts) AS o_start, least(e, te) AS o_end FROM seg s JOIN turn t ON s.user_id = t.user_id AND te > s AND ts < e")
def j01(spark, d):
    return intervals.overlap_join(_segments(spark, d), _turns(spark, d), ["user_id"], 43200).select("user_id", "seg", "turn", "o_start", "o_end")


@query("j02_best_overlap", f"WITH {SEG} SELECT s.seg, x.turn, x.speaker FROM seg s LEFT JOIN (SELECT seg, turn, speaker, row_number() OVER (PARTITION BY seg ORDER BY least(e, te) - greatest(s, ts) DESC, turn) AS rk FROM seg a JOIN turn b ON a.user_id = b.user_id AND te > s AND ts < e) x ON x.seg = s.seg AND x.rk = 1")
def j02(spark, d):
    return intervals.best_overlap(_segments(spark, d), _turns(spark, d), ["user_id"], "seg", ["turn"], 43200).select("seg", "turn", "speaker")


@query("j03_point_in_interval", f"WITH {SEG} SELECT s.seg, x.turn FROM seg s LEFT JOIN (SELECT seg, min(turn) AS turn FROM seg a JOIN turn b ON a.user_id = b.user_id AND (s + e) // 2 BETWEEN ts AND te GROUP BY seg) x USING (seg)")
def j03(spark, d):
    points = _segments(spark, d).select("user_id", "seg", F.floor((F.col("s") + F.col("e")) / 2).alias("p"))
    return intervals.point_in_interval(points, _turns(spark, d), ["user_id"], "seg", ["turn"], 43200).select("seg", "turn")


@query("j04_range_lookup", f"WITH {EV}, sc AS (SELECT user_id, event_id AS scene_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - 3600 AS z FROM ev WHERE event_type = 'view') SELECT e.event_id, coalesce(min(sc.scene_id), -1) AS scene_id FROM ev e LEFT JOIN sc ON sc.user_id = e.user_id AND e.t BETWEEN sc.a AND sc.z GROUP BY 1")
def j04(spark, d):
    e = _events(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    scenes = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("scene"), F.col("t").alias("ts"), (F.lead("t").over(w) - 3600).alias("te")).filter("te >= ts")
    out = intervals.point_in_interval(e.select("user_id", "event_id", F.col("t").alias("p")), scenes, ["user_id"], "event_id", ["scene"], 86400)
    return out.select("event_id", F.coalesce("scene", F.lit(-1)).cast("long").alias("scene_id"))


@query("j05_overlap_semi", f"WITH {SEG} SELECT seg FROM seg s WHERE EXISTS (SELECT 1 FROM turn t WHERE t.user_id = s.user_id AND te > s AND ts < e AND least(e, te) - greatest(s, ts) >= greatest(least(e - s, te - ts)::DOUBLE, 1e-6) * 0.15)")
def j05(spark, d):
    return intervals.overlap_semi(_segments(spark, d), _turns(spark, d), ["user_id"], "seg", 43200, 0.15).select("seg")


def _boxes(spark, d, shift: int):
    p = table(spark, d, "part")
    x, y = (F.col("p_partkey") * 7 + shift) % 40, (F.col("p_partkey") * 13 + shift) % 40
    return p.select((F.col("p_partkey") % 50).alias("frame"), F.col("p_partkey").alias("id"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("p_size") % 10).alias("x2"), (y + 12).alias("y2"))


def _box_sql(shift: int) -> str:
    return f"(SELECT p_partkey % 50 AS frame, p_partkey AS id, (p_partkey * 7 + {shift}) % 40 AS x1, (p_partkey * 13 + {shift}) % 40 AS y1, (p_partkey * 7 + {shift}) % 40 + 10 + p_size % 10 AS x2, (p_partkey * 13 + {shift}) % 40 + 12 AS y2 FROM part)"


_IOU = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))::DOUBLE"
_IOU = f"{_IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU})"
_BEST = f"best AS (SELECT * FROM (SELECT a.id, b.id AS other, {_IOU} AS iou, row_number() OVER (PARTITION BY a.id ORDER BY {_IOU} DESC, b.id) AS rk FROM {_box_sql(0)} a JOIN {_box_sql(3)} b ON a.frame = b.frame) WHERE rk = 1 AND iou @)"


def _matched(spark, d, threshold: float, strict: bool):
    right = _boxes(spark, d, 3).withColumnRenamed("id", "other")
    return spatial.iou_argmax(_boxes(spark, d, 0), right, "frame", "id", "other", threshold, strict)


@query("j06_iou_argmax", f"WITH {_BEST.replace('@', '>= 0.5')} SELECT a.frame, a.id, best.other, round(best.iou, 6) AS iou FROM {_box_sql(0)} a LEFT JOIN best USING (id)")
def j06(spark, d):
    return _matched(spark, d, 0.5, False).select("frame", "id", "other", F.round("iou", 6).alias("iou"))


@query("j08_iou_track_ids", f"WITH {_BEST.replace('@', '> 0.5')} SELECT id, CASE WHEN other IS NOT NULL THEN other ELSE 99999 + row_number() OVER (PARTITION BY other IS NULL ORDER BY frame, id) END::BIGINT AS track FROM {_box_sql(0)} a LEFT JOIN best USING (id)")
def j08(spark, d):
    return spatial.unmatched_ids(_matched(spark, d, 0.5, True), "frame", "id", "other").select("id", F.col("track").cast("long").alias("track"))


@query("j09_iou_faces", f"WITH {_BEST.replace('@', '> 0.01')} SELECT id, other FROM best")
def j09(spark, d):
    return _matched(spark, d, 0.01, True).filter("other IS NOT NULL").select("id", "other")


@query("j10_positional_zip", "SELECT l_orderkey, l.i, l.a, r.b FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax)::INTEGER AS i, l_quantity AS a FROM lineitem) l LEFT JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax)::INTEGER AS i, l_tax AS b FROM lineitem WHERE l_returnflag = 'R') r USING (l_orderkey, i)")
def j10(spark, d):
    li = table(spark, d, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax")).alias("i")
    left = li.select("l_orderkey", i, F.col("l_quantity").alias("a"))
    right = li.filter("l_returnflag = 'R'").select("l_orderkey", i, F.col("l_tax").alias("b"))
    return left.join(right, ["l_orderkey", "i"], "left").select("l_orderkey", "i", "a", "b")


@query("j11_dictionary_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Speech' WHEN 'view' THEN 'Music' ELSE 'Mixed/Other' END AS category FROM events")
def j11(spark, d):
    names = spark.range(1).select(F.explode(F.create_map(F.lit("click"), F.lit("Speech"), F.lit("view"), F.lit("Music"))).alias("event_type", "category"))
    e = table(spark, d, "events").join(names, "event_type", "left")
    return e.select("event_id", F.coalesce("category", F.lit("Mixed/Other")).alias("category"))


@query("j12_keyword_labels", "SELECT DISTINCT p_type, k AS keyword FROM part, (VALUES ('steel'), ('tin'), ('brush'), ('econ')) v(k) WHERE contains(lower(p_type), k)")
def j12(spark, d):
    # the list of keywords is a parameter: one filter over an array, no join
    keywords = F.array(*[F.lit(k) for k in ("steel", "tin", "brush", "econ")])
    types = table(spark, d, "part").select("p_type").distinct()
    return types.select("p_type", F.explode(F.filter(keywords, lambda k: F.contains(F.lower("p_type"), k))).alias("keyword"))


@query("j16_nearest_fill", f"WITH {EV}, q AS (SELECT user_id, t FROM ev WHERE event_type = 'error' GROUP BY 1, 2), k AS (SELECT user_id, t AS kt, max(value) AS value FROM ev WHERE event_type = 'view' GROUP BY 1, 2) SELECT user_id, t, value FROM (SELECT q.user_id, q.t, k.value, row_number() OVER (PARTITION BY q.user_id, q.t ORDER BY abs(k.kt - q.t), k.kt) AS rk FROM q LEFT JOIN k USING (user_id)) WHERE rk = 1")
def j16(spark, d):
    e = _events(spark, d)
    points = e.filter("event_type = 'error'").select("user_id", "t").distinct()
    known = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return intervals.nearest_fill(points, known, ["user_id"], "t", "value")


@query("j17_anti_seen", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)")
def j17(spark, d):
    e, seen = table(spark, d, "events"), table(spark, d, "labels")
    return e.join(seen, e.event_id == seen.doc_id, "left_anti").select("event_id")


@query("j19_skeleton_edges", "SELECT o.o_orderkey, a.l_linenumber AS p, b.l_linenumber AS q FROM orders o JOIN lineitem a ON a.l_orderkey = o.o_orderkey JOIN (VALUES (1, 2), (1, 3), (2, 4), (3, 5)) e(u, v) ON e.u = a.l_linenumber JOIN lineitem b ON b.l_orderkey = o.o_orderkey AND b.l_linenumber = e.v WHERE o.o_orderstatus = 'F'")
def j19(spark, d):
    points = table(spark, d, "lineitem").join(table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    edges = F.expr("array(struct(1 as u, 2 as v), struct(1 as u, 3 as v), struct(2 as u, 4 as v), struct(3 as u, 5 as v))")
    a = points.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("p"), F.explode(F.filter(edges, lambda x: x["u"] == F.col("l_linenumber"))).alias("x"))
    b = points.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("q"))
    return a.withColumn("q", F.col("x.v")).join(b, ["o_orderkey", "q"]).select("o_orderkey", "p", "q")


@query("a01_label_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def a01(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a02_top_terms", "SELECT event_type, k, n FROM (SELECT event_type, (user_id % 37) AS k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rk FROM events GROUP BY 1, 2) WHERE rk <= 20")
def a02(spark, d):
    g = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 37).alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(20).select("event_type", "k", "n")


@query("a03_distinct_counts", "SELECT lang, count(DISTINCT text) AS exact, count(DISTINCT CASE WHEN trim(text) <> '' THEN lower(trim(text)) END) AS folded FROM documents GROUP BY 1")
def a03(spark, d):
    folded = F.when(F.trim("text") != "", F.lower(F.trim("text")))
    return table(spark, d, "documents").groupBy("lang").agg(F.countDistinct("text").alias("exact"), F.countDistinct(folded).alias("folded"))


@query("a04_confidence_summary", "SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a04(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("a05_score_rollup", """SELECT user_id, max(s) AS mx, round(avg(s), 6) AS mean, round(list_avg(list_reverse_sort(list(s))[1:3]), 6) AS top3, round(sum(s * exp(s)) / sum(exp(s)), 6) AS weighted
FROM (SELECT user_id, value / 100 AS s FROM events) GROUP BY 1""")
def a05(spark, d):
    from lumenflow.operators.retrieval import roll_up

    e = table(spark, d, "events").select("user_id", (F.col("value") / 100).alias("s"))
    r = lambda how: F.round(roll_up(F.col("s"), how), 6)
    return e.groupBy("user_id").agg(F.max("s").alias("mx"), r("mean").alias("mean"), r("top_k_mean").alias("top3"), r("weighted_mean").alias("weighted"))


@query("a06_weighted_probability", """WITH p AS (SELECT l_suppkey % 20 AS media, l_returnflag AS label, l_tax AS p, CASE WHEN l_quantity - 5 > 0 THEN l_quantity - 5 ELSE 1.0::DOUBLE END AS w FROM lineitem)
SELECT media, label, round(sum(p * w) / sum(w), 6) AS score, row_number() OVER (PARTITION BY media ORDER BY sum(p * w) / sum(w) DESC, label)::INTEGER AS rk FROM p GROUP BY 1, 2""")
def a06(spark, d):
    w = F.when(F.col("l_quantity") - 5 > 0, F.col("l_quantity") - 5).otherwise(1.0)
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("media"), F.col("l_returnflag").alias("label"), (F.col("l_tax") * w).alias("pw"), w.alias("w"))
    g = li.groupBy("media", "label").agg((F.sum("pw") / F.sum("w")).alias("m"))
    return g.select("media", "label", F.round("m", 6).alias("score"), F.row_number().over(Window.partitionBy("media").orderBy(F.desc("m"), "label")).alias("rk"))


@query("a07_joined_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS said FROM conversations GROUP BY 1")
def a07(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("said"))


@query("a08_high_confidence_mean", "SELECT user_id, round(avg(CASE WHEN value >= 200 THEN value END), 2) AS mean FROM events GROUP BY 1 HAVING avg(CASE WHEN value >= 200 THEN value END) >= 230")
def a08(spark, d):
    mean = F.avg(F.when(F.col("value") >= 200, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(mean.alias("m")).filter("m >= 230").select("user_id", F.round("m", 2).alias("mean"))


@query("a09_interval_hull", f"WITH {SEG} SELECT s.seg, coalesce(min(ts), min(s)) AS a, coalesce(max(te), max(e)) AS z FROM seg s LEFT JOIN turn t ON t.user_id = s.user_id AND te > s AND ts < e GROUP BY 1")
def a09(spark, d):
    seg = _segments(spark, d)
    hull = intervals.overlap_join(seg, _turns(spark, d), ["user_id"], 43200).groupBy("user_id", "seg").agg(F.min("ts").alias("lo"), F.max("te").alias("hi"))
    return seg.join(hull, ["user_id", "seg"], "left").select("seg", F.coalesce("lo", "s").alias("a"), F.coalesce("hi", "e").alias("z"))


@query("a11_coverage", f"WITH {SEG} SELECT user_id, round(sum(e - s)::DOUBLE / 2678400, 3) AS coverage FROM seg GROUP BY 1")
def a11(spark, d):
    return _segments(spark, d).groupBy("user_id").agg(F.round(F.sum(F.col("e") - F.col("s")) / 2678400, 3).alias("coverage"))


@query("a12_base_span", "SELECT user_id, round(coalesce(greatest(quantile_cont(CASE WHEN value > 0 THEN value END, 0.5), avg(CASE WHEN value > 0 THEN value END)), 1.0::DOUBLE), 6) AS base, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.4), 6) AS p40 FROM events GROUP BY 1")
def a12(spark, d):
    v = F.when(F.col("value") > 0, F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(
        F.round(F.coalesce(F.greatest(F.percentile(v, F.lit(0.5)), F.avg(v)), F.lit(1.0)), 6).alias("base"), F.round(F.percentile("value", F.lit(0.75)), 6).alias("p75"), F.round(F.percentile("value", F.lit(0.4)), 6).alias("p40")
    )


@query("a15_boosted_words", "SELECT lang, w, round(c * CASE WHEN w IN ('the', 'und', 'les') THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN length(w) > 6 THEN 1.2 ELSE 1.0 END::DOUBLE, 6) AS score FROM (SELECT lang, w, count(*) AS c, row_number() OVER (PARTITION BY lang ORDER BY count(*) * CASE WHEN w IN ('the', 'und', 'les') THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN length(w) > 6 THEN 1.2 ELSE 1.0 END::DOUBLE DESC, w) AS rk FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY 1, 2) WHERE rk <= 4")
def a15(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    score = F.col("c") * F.when(F.col("w").isin("the", "und", "les"), 2.0).otherwise(1.0) * F.when(F.length("w") > 6, 1.2).otherwise(1.0)
    rk = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "w"))
    return words.withColumn("score", score).withColumn("rk", rk).filter("rk <= 4").select("lang", "w", F.round("score", 6).alias("score"))


@query("a16_alignment_counts", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS aligned, count(*) FILTER (event_type = 'error') AS unaligned FROM events GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("aligned"), F.count_if(F.col("event_type") == "error").alias("unaligned"))


@query("a17_entity_summary", "SELECT conv_id, count(*) AS segments, sum(len(w))::BIGINT AS entities, count(DISTINCT role) AS kinds FROM (SELECT conv_id, role, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM conversations) GROUP BY 1")
def a17(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", F.size(text.tokens(F.col("text"))).alias("n"))
    return c.groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum("n").alias("entities"), F.countDistinct("role").alias("kinds"))


@query("a18_sorted_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, bool_or(lang = 'fr') AS any_fr, bool_and(length(text) > 5) AS all_long FROM documents GROUP BY 1")
def a18(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"), F.bool_or(F.col("lang") == "fr").alias("any_fr"), F.bool_and(F.length("text") > 5).alias("all_long"))


@query("a20_rms_decibel", f"WITH {EV} SELECT user_id, t // 86400 AS bucket, round(20 * log10(sqrt(avg(value * value)) + 1e-9), 6) AS db FROM ev GROUP BY 1, 2")
def a20(spark, d):
    return _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("bucket")).agg(F.round(20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value"))) + 1e-9), 6).alias("db"))


@query("a21_rates", "SELECT o_custkey, round(sum(o_totalprice) / count(*) / 1000, 2) AS rate FROM orders GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") / F.count("*") / 1000, 2).alias("rate"))


_VOTE = "SELECT user_id, t, event_id AS ord, event_type AS label, value AS conf FROM ev"


@query("w03_vote3", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
p AS (SELECT a.event_id, b.event_type AS label, sum(b.value) AS s, min(b.i) AS first FROM r a JOIN r b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 1 AND a.i + 1 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(s, 6) DESC, first) AS rk FROM p)
SELECT r.event_id, CASE WHEN n < 3 THEN r.event_type ELSE k.label END AS voted FROM r JOIN k ON k.event_id = r.event_id AND rk = 1""")
def w03(spark, d):
    e = _events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")))
    return sequences.vote3(e, ["user_id"], "i", "event_type", "value", 6).select("event_id", "voted")


def _spans(spark, d):
    e = _events(spark, d)
    return e.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("label"), F.col("t").alias("s"), (F.col("t") + 1800 + F.floor(F.col("value") * 60)).cast("long").alias("e"), (F.col("value") / 500).alias("conf"))


SPAN = f"{EV}, sp AS (SELECT user_id, event_id AS ord, event_type AS label, t AS s, t + 1800 + floor(value * 60)::BIGINT AS e, value / 500 AS conf FROM ev)"


@query("w04_timeline_merge", f"""WITH RECURSIVE {SPAN}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, ord) AS i FROM sp),
m AS (SELECT user_id, i, label, s, e, conf, 1 AS isl FROM r WHERE i = 1 UNION ALL
  SELECT r.user_id, r.i, r.label, CASE WHEN r.label = m.label AND r.s - m.e < 36000 THEN m.s ELSE r.s END, r.e,
  CASE WHEN r.label = m.label AND r.s - m.e < 36000 THEN (m.conf * (r.e - m.s)::DOUBLE + r.conf * (r.e - r.s)::DOUBLE) / ((r.e - m.s)::DOUBLE + (r.e - r.s)::DOUBLE) ELSE r.conf END,
  CASE WHEN r.label = m.label AND r.s - m.e < 36000 THEN m.isl ELSE m.isl + 1 END FROM m JOIN r ON r.user_id = m.user_id AND r.i = m.i + 1)
SELECT user_id, label, s, e, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY i DESC) AS k FROM m) WHERE k = 1 AND e - s >= 7200""")
def w04(spark, d):
    return sequences.timeline_merge(_spans(spark, d), ["user_id"], "label", 36000, 7200).select("user_id", "label", "s", "e", F.round("conf", 6).alias("conf"))


@query("w05_action_merge", f"""WITH {SPAN}, a AS (SELECT *, lag(label) OVER w IS DISTINCT FROM label AS nr FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY s, conf DESC, ord)),
b AS (SELECT *, sum(nr::INT) OVER (PARTITION BY user_id ORDER BY s, conf DESC, ord) AS run FROM a),
c AS (SELECT *, s - max(e) OVER (PARTITION BY user_id, run ORDER BY s, conf DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 36000 AS glued FROM b),
f AS (SELECT *, sum((NOT coalesce(glued, false))::INT) OVER (PARTITION BY user_id, run ORDER BY s, conf DESC, ord) AS part FROM c)
SELECT user_id, label, min(s) AS s, max(e) AS e, round(max(conf), 6) AS conf FROM f GROUP BY user_id, run, part, label""")
def w05(spark, d):
    return sequences.action_merge(_spans(spark, d), ["user_id"], "label", 36000).select("user_id", "label", "s", "e", F.round("conf", 6).alias("conf"))


@query("w06_activity_segments", f"""WITH {EV}, a AS (SELECT user_id, t // 60 AS frame, max(value) AS score FROM ev GROUP BY 1, 2 HAVING max(value) >= 40),
b AS (SELECT *, coalesce(frame - lag(frame) OVER (PARTITION BY user_id ORDER BY frame) <= 720, false) AS glued FROM a),
c AS (SELECT *, sum((NOT glued)::INT) OVER (PARTITION BY user_id ORDER BY frame) AS isl FROM b)
SELECT user_id, greatest(0, min(frame) - 60) AS start, least(44640, max(frame) + 60) AS "end", arg_max(frame, (score, -frame)) AS peak FROM c GROUP BY user_id, isl HAVING max(frame) - min(frame) >= 30""")
def w06(spark, d):
    e = _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 60).alias("frame")).agg(F.max("value").alias("score"))
    return sequences.activity_segments(e, ["user_id"], "frame", "score", 40.0, 720, 30, 60, 44640)


@query("w08_hysteresis", f"""WITH {EV}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, value FROM ev),
s AS (SELECT *, coalesce(last_value(CASE WHEN value > 80 THEN 1 WHEN value < 15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 0) AS st FROM r),
g AS (SELECT *, sum((lag_st IS DISTINCT FROM st)::INT) OVER (PARTITION BY user_id ORDER BY i) AS isl FROM (SELECT *, lag(st) OVER (PARTITION BY user_id ORDER BY i) AS lag_st FROM s))
SELECT user_id, round(min(i) * 0.5, 6)::DOUBLE AS start, round((max(i) + 1) * 0.5, 6)::DOUBLE AS "end" FROM g WHERE st = 1 GROUP BY user_id, isl HAVING (max(i) + 1 - min(i)) * 0.5 >= 1.0""")
def w08(spark, d):
    e = _events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    return sequences.hysteresis(e, ["user_id"], "i", "value", 80.0, 15.0, 0.5, 1.0)


@query("w09_word_timing", """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS ws, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + 10 AS z FROM conversations),
x AS (SELECT conv_id, turn, a, z, ws, list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS tot, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM w),
y AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i)::DOUBLE AS upto FROM x)
SELECT conv_id, turn, i::INTEGER AS word_index, word, round(a + (z - a) * (upto - length(word)) / tot, 3) AS word_start, least(round(a + (z - a) * upto / tot, 3), z) AS word_end FROM y""")
def w09(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 10.0).alias("a"), (F.col("turn") * 10.0 + 10).alias("z"))
    return sequences.word_timing(c, "text", "a", "z").select("conv_id", "turn", "word_index", "word", "word_start", "word_end")


@query("w15_fps_sample", f"WITH {EV}, f AS (SELECT user_id, event_id, t / 3600.0::DOUBLE AS sec FROM ev), s AS (SELECT user_id, event_id, floor((sec + 1e-6) * 0.1) AS k, lag(floor((sec + 1e-6) * 0.1)) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS p FROM f) SELECT user_id, event_id FROM s WHERE p IS NULL OR k > p")
def w15(spark, d):
    f = _events(spark, d).withColumn("sec", F.col("t") / 3600.0)
    return sequences.fps_sample(f, ["user_id"], "event_id", "sec", 0.1)


@query("w20_context_before", """WITH s AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got FROM conversations)
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context FROM s WHERE got < 120 GROUP BY 1""")
def w20(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, d, "conversations").withColumn("got", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter("got < 120")
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("context"))


@query("w21_chunk_plan", "SELECT o_orderkey, i::INTEGER AS chunk, greatest(0, i * 50000 - 5000) AS start, least(total, (i + 1) * 50000 + 5000) AS stop, i * 50000 AS core_start, least(total, (i + 1) * 50000) AS core_end FROM (SELECT o_orderkey, total, unnest(range(0, greatest(1, (total + 49999) // 50000))) AS i FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS total FROM orders))")
def w21(spark, d):
    from lumenflow.operators.planners import fixed_chunks

    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("total"))
    return fixed_chunks(o, "total", 50000, 5000).select("o_orderkey", "chunk", "start", "stop", "core_start", "core_end")


@query("w22_hop_windows", f"WITH {EV} SELECT user_id, k, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, value, unnest(range(greatest(0, floor((t - 172800) / 86400.0)::BIGINT + 1), floor(t / 86400.0)::BIGINT + 1)) AS k FROM ev) GROUP BY 1, 2 HAVING count(*) >= 2")
def w22(spark, d):
    out = sequences.hop_windows(_events(spark, d), ["user_id"], "t", 172800, 86400, F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.filter("n >= 2")


@query("w24_prefix_offsets", f"WITH {EV} SELECT event_id, coalesce(sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ev")
def w24(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return _events(spark, d).select("event_id", F.coalesce(F.sum(F.floor("value").cast("long")).over(w), F.lit(0)).alias("off"))


@query("w25_dense_relabel", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.02 THEN -1 ELSE dense_rank() OVER (PARTITION BY l_orderkey, l_tax < 0.02 ORDER BY l_suppkey) - 1 END::INTEGER AS cluster FROM lineitem")
def w25(spark, d):
    noise = F.col("l_tax") < 0.02
    rank = F.dense_rank().over(Window.partitionBy("l_orderkey", noise).orderBy("l_suppkey")) - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(noise, -1).otherwise(rank).alias("cluster"))


@query("w26_ids_and_margin", f"WITH {EV}, x AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS best FROM ev) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM x WHERE best - value <= 150")
def w26(spark, d):
    kept = sequences.margin_filter(_events(spark, d), ["user_id"], "value", 150.0)
    return kept.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))


@query("w28_keyframe_plan", f"""WITH {EV}, sc AS (SELECT user_id, event_id AS scene, t // 60 AS a, t // 60 + floor(value)::BIGINT AS z FROM ev),
b AS (SELECT user_id, coalesce(greatest(quantile_cont((z - a + 1) / 30.0::DOUBLE, 0.5), avg((z - a + 1) / 30.0::DOUBLE)), 1.0) AS base FROM sc GROUP BY 1),
n AS (SELECT sc.*, least(greatest(1, round_even((z - a + 1) / 30.0::DOUBLE / base, 0)::BIGINT), z - a + 1) AS n FROM sc JOIN b USING (user_id))
SELECT scene, CASE WHEN n = 1 THEN (a + z) // 2 ELSE a + floor((z - a) * i / (n - 1)::DOUBLE)::BIGINT END AS frame FROM (SELECT *, unnest(range(0, n)) AS i FROM n)""")
def w28(spark, d):
    e = _events(spark, d)
    first = F.floor(F.col("t") / 60).cast("long")
    scenes = e.select("user_id", F.col("event_id").alias("scene"), first.alias("a"), (first + F.floor("value")).cast("long").alias("z"))
    return sequences.keyframe_plan(scenes, "user_id", "a", "z", 30.0, ["scene"]).select("scene", "frame")


@query("o03_candidate_order", f"WITH {EV}, x AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rk FROM ev WHERE value >= 20) SELECT user_id, event_id, rk FROM x WHERE best - value <= 200 AND rk <= 5")
def o03(spark, d):
    from lumenflow.operators.retrieval import select_candidates

    return select_candidates(_events(spark, d), ["user_id"], "value", ["event_id"], least=20.0, margin=200.0, k=5).select("user_id", "event_id", F.col("rank").alias("rk"))


@query("o02_union_order", "SELECT kind, id, rank() OVER (ORDER BY score DESC, kind DESC, id)::INTEGER AS rk FROM (SELECT 'web' AS kind, page_id AS id, (page_id * 7) % 10 AS score FROM pages UNION ALL SELECT 'video', item_id, (item_id * 3) % 10 FROM benchmark)")
def o02(spark, d):
    web = table(spark, d, "pages").select(F.lit("web").alias("kind"), F.col("page_id").alias("id"), ((F.col("page_id") * 7) % 10).alias("score"))
    both = web.unionByName(table(spark, d, "benchmark").select(F.lit("video").alias("kind"), F.col("item_id").alias("id"), ((F.col("item_id") * 3) % 10).alias("score")))
    # one query's hits: a bounded list, so a global order is meant
    return both.withColumn("rk", F.rank().over(Window.orderBy(F.desc("score"), F.desc("kind"), "id"))).select("kind", "id", "rk")


@query("u02_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def u02(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("u04_class_sets", "SELECT c_custkey, len(list_intersect(list(DISTINCT o_orderstatus), ['F', 'P']))::INTEGER AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def u04(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("s"))
    return o.join(table(spark, d, "customer"), "c_custkey", "left_semi").select("c_custkey", F.size(F.array_intersect("s", F.array(F.lit("F"), F.lit("P")))).alias("n"))
