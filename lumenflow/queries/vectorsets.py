"""Folds, vectors, clustering, graphs and composite plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.functions import text, vectors
from lumenflow.operators import clustering, crawl, folds, keywords, retrieval, sequences, vectorjoin
from lumenflow.plans.registry import query
from lumenflow.session import table

_DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_COS = f"({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')}))"
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_EV = "ev AS (SELECT *, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000)::BIGINT AS t FROM events)"
_CUT = "m.size + length(l.line) + 1 > 6000"
_PARAGRAPHS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE length(text) > 6000),
m AS (SELECT doc_id, i, n, line AS now, length(line) + 1 AS size, NULL::VARCHAR AS said, 0 AS chunk FROM l WHERE i = 1 UNION ALL
 SELECT l.doc_id, l.i, l.n, CASE WHEN NOT {_CUT} THEN m.now || chr(10) || l.line WHEN m.now = '' THEN l.line ELSE right(m.now, 200) || chr(10) || l.line END, CASE WHEN {_CUT} THEN length(right(m.now, 200)) ELSE m.size END + length(l.line) + 1,
 CASE WHEN {_CUT} THEN m.now END, m.chunk + ({_CUT})::INT FROM m JOIN l ON l.doc_id = m.doc_id AND l.i = m.i + 1),
chunks AS (SELECT doc_id, 0 AS chunk, text AS body FROM documents WHERE length(text) <= 6000 UNION ALL SELECT doc_id, chunk - 1, said FROM m WHERE said IS NOT NULL UNION ALL SELECT doc_id, chunk, now FROM m WHERE i = n)"""


def _cut_sql(text: str, most: int) -> str:
    """Whole sentences of at most ``most`` characters, as text.sentence_cut()."""
    s = _SENT.replace("text", text)
    fits = f"list_filter(range(1, least(len({s}), {most}) + 1), lambda k: length(array_to_string(({s})[1:k], ' ')) <= {most})"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN len({fits}) > 0 THEN array_to_string(({s})[1:list_max({fits})], ' ') ELSE left({text}, {most}) END"


def _diverse_sql(rows: str, key: str, eps: float, before: str = "") -> str:
    """The rows of folds.Diverse over ``rows`` (key, vec_id, embedding)."""
    return f"""WITH RECURSIVE {before} r AS (SELECT {key}, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY {key} ORDER BY vec_id) AS i FROM ({rows})),
dv AS (SELECT {key}, i, vec_id, [e] AS vs, true AS kept FROM r WHERE i = 1 UNION ALL
 SELECT {key}, i, vec_id, CASE WHEN far THEN list_append(vs, e) ELSE vs END, far
 FROM (SELECT r.*, dv.vs, 1 - list_max(list_transform(dv.vs, lambda v: list_cosine_similarity(v, r.e))) >= {eps} AS far FROM dv JOIN r ON r.{key} = dv.{key} AND r.i = dv.i + 1))
SELECT {key}, vec_id AS kept FROM dv WHERE kept"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("embedding", vectors.doubles(F.col("embedding")))


@query("w01_adjacent_dissimilarity", f"""WITH a AS (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings),
d AS (SELECT label, vec_id, 1 - {_DOT.format('embedding', 'nx')} AS d FROM a WHERE nx IS NOT NULL)
SELECT vec_id, round(d, 6) AS d, round(CASE WHEN count(*) OVER (PARTITION BY label) >= 3 THEN (coalesce(lag(d) OVER w, 0) + d + coalesce(lead(d) OVER w, 0)) / 3 ELSE d END, 6) AS smooth FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def w01(spark, d):
    return sequences.adjacent_dissimilarity(_vectors(spark, d), ["label"], "vec_id", "embedding").select("vec_id", F.round("d", 6).alias("d"), F.round("smooth", 6).alias("smooth"))


_P = "(SELECT label AS media, vec_id, i - 1 AS k, exp(embedding[i]::DOUBLE / 0.7) AS e FROM embeddings, generate_series(1, 8) t(i))"


@query("w02_smooth_probabilities", f"""WITH p AS (SELECT media, vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM {_P}),
s AS (SELECT *, (p + coalesce(lag(p, 1) OVER w, first_value(p) OVER w) + coalesce(lag(p, 2) OVER w, first_value(p) OVER w) + coalesce(lead(p, 1) OVER w, last_value(p) OVER f) + coalesce(lead(p, 2) OVER w, last_value(p) OVER f)) / 5 AS m FROM p
  WINDOW w AS (PARTITION BY media, k ORDER BY vec_id), f AS (PARTITION BY media, k ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, pow(least(greatest(m, 1e-8), 1.0), 1.35) AS g FROM s)
SELECT vec_id, k::INTEGER AS k, round(g / sum(g) OVER (PARTITION BY vec_id), 6) AS smooth FROM g""")
def w02(spark, d):
    p = vectors.softmax(F.slice("embedding", 1, 8), 0.7)
    rows = _vectors(spark, d).select(F.col("label").alias("media"), "vec_id", F.posexplode(p).alias("k", "p"))
    return sequences.smooth_probabilities(rows, ["media"], "vec_id", "k", "p").select("vec_id", "k", F.round("smooth", 6).alias("smooth"))


@query("w07_words_to_segments", """WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS ws, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + 9.7::DOUBLE AS z FROM conversations),
x AS (SELECT conv_id, turn, a, z, list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS tot, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM w),
y AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY i)::DOUBLE AS upto FROM x),
r AS (SELECT conv_id, word, round(a + (z - a) * (upto - length(word)) / tot, 3) AS s, least(round(a + (z - a) * upto / tot, 3), z) AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM y),
m AS (SELECT conv_id, k, word, s, e, 1 AS n, 0 AS segment FROM r WHERE k = 1 UNION ALL
 SELECT conv_id, k, word, s, e, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN segment + 1 ELSE segment END
 FROM (SELECT r.*, m.n, m.segment, r.s - m.e > 0.5::DOUBLE OR right(m.word, 1) IN ('.', '!', '?') AND (r.s - m.e > 0.2::DOUBLE OR m.n >= 15) AS cut FROM m JOIN r ON r.conv_id = m.conv_id AND r.k = m.k + 1))
SELECT conv_id, segment::INTEGER AS segment, min(s) AS start, arg_max(e, k) AS "end", count(*)::INTEGER AS n_words, string_agg(word, ' ' ORDER BY k) AS body FROM m GROUP BY 1, 2""")
def w07(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 10.0).alias("a"), (F.col("turn") * 10.0 + 9.7).alias("z"))
    words = sequences.word_timing(c, "text", "a", "z")
    return folds.fold(words, ["conv_id"], ["turn", "word_index"], ["word", "word_start", "word_end"], folds.WordsToSegments, "segment int, start double, end double, n_words int, body string")


@query("w10_chunk_paragraphs", f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, chunk::INTEGER AS chunk, body FROM chunks")
def w10(spark, d):
    return folds.chunk_texts(table(spark, d, "documents"), ["doc_id"], "text", folds.chunk_paragraphs)


@query("w11_chunk_tokens", f"""WITH RECURSIVE d AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, '\\S+'))) AS n FROM (SELECT doc_id, {_SENT} AS s FROM documents) WHERE len(s) > 0),
m AS (SELECT doc_id, 1 AS i, 1 AS a, n[1] AS total, NULL::BIGINT AS x, NULL::BIGINT AS y, 0 AS chunk FROM d UNION ALL
 SELECT doc_id, i, CASE WHEN NOT cut THEN a WHEN keep THEN i - 1 ELSE i END, n_i + CASE WHEN NOT cut THEN total WHEN keep THEN n_p ELSE 0 END, CASE WHEN cut THEN a END, CASE WHEN cut THEN i - 1 END, chunk + cut::INT
 FROM (SELECT m.doc_id, m.i + 1 AS i, m.a, m.total, m.chunk, d.n[m.i + 1] AS n_i, d.n[m.i] AS n_p, m.total + d.n[m.i + 1] > 128 AS cut, m.i > m.a AND d.n[m.i] <= 32 AS keep FROM m JOIN d USING (doc_id) WHERE m.i < len(d.n))),
o AS (SELECT doc_id, chunk - 1 AS chunk, x, y FROM m WHERE x IS NOT NULL UNION ALL SELECT doc_id, chunk, a, i FROM m JOIN d USING (doc_id) WHERE m.i = len(d.n))
SELECT doc_id, chunk::INTEGER AS chunk, 'Title: document. Text: ' || array_to_string(s[x:y], ' ') AS body FROM o JOIN d USING (doc_id)""")
def w11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat_ws("\x01", text.sentences(F.col("text"))).alias("s"))

    def chunker(joined: str) -> list[str]:
        s = [x for x in joined.split("\x01") if x]
        return folds.chunk_sentences(s, [len(x.split()) for x in s], "document")

    return folds.chunk_texts(docs, ["doc_id"], "s", chunker)


@query("w12_chunk_sentences", f"SELECT doc_id, i::INTEGER AS chunk, array_to_string(s[2*i+1:2*i+3], ' ') AS body FROM (SELECT doc_id, s, unnest(range(0, greatest(1, len(s) // 2))) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents) WHERE len(s) > 0)")
def w12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    rows = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.size("s") / 2).cast("int")) - 1)))
    return rows.select("doc_id", F.col("i").alias("chunk"), F.array_join(F.slice("s", 2 * F.col("i") + 1, F.lit(3)), " ").alias("body"))


@query("w13_pack_context", """WITH RECURSIVE r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
m AS (SELECT conv_id, i, length(text) AS size, 0 AS chunk FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.i, CASE WHEN m.size + length(r.text) > 200 THEN length(r.text) ELSE m.size + length(r.text) END, CASE WHEN m.size + length(r.text) > 200 THEN m.chunk + 1 ELSE m.chunk END FROM m JOIN r ON r.conv_id = m.conv_id AND r.i = m.i + 1)
SELECT m.conv_id, chunk::INTEGER AS chunk, count(*)::INTEGER AS n, string_agg(text, ' ' ORDER BY m.i) AS body FROM m JOIN r ON r.conv_id = m.conv_id AND r.i = m.i GROUP BY 1, 2""")
def w13(spark, d):
    return folds.fold(table(spark, d, "conversations"), ["conv_id"], ["turn", "text"], ["text"], lambda: folds.Pack(200), "chunk int, n int, body string")


@query("w14_monotone_repair", """WITH RECURSIVE r AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m AS (SELECT user_id, i, event_id AS id, coalesce(t, 0.0)::DOUBLE AS time, greatest(0, event_id)::BIGINT AS idx FROM r WHERE i = 1 UNION ALL
 SELECT r.user_id, r.i, r.event_id, greatest(m.time, coalesce(r.t, m.time + 1.0::DOUBLE / 30)), greatest(m.idx + 1, r.event_id) FROM m JOIN r ON r.user_id = m.user_id AND r.i = m.i + 1) SELECT user_id, id, time, idx FROM m""")
def w14(spark, d):
    e = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return folds.fold(e.withColumn("i", F.col("event_id")), ["user_id"], ["event_id"], ["event_id", "t", "i"], lambda: folds.Monotone(30.0), "id long, time double, idx long")


@query("w16_near_dup_scan", f"""WITH RECURSIVE r AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
m AS (SELECT label, i, vec_id, embedding AS last, true AS kept FROM r WHERE i = 1 UNION ALL
 SELECT b.label, b.i, b.vec_id, CASE WHEN {_COS.replace('a.embedding', 'a.last')} >= 0.1 THEN a.last ELSE b.embedding END, {_COS.replace('a.embedding', 'a.last')} < 0.1 FROM m a JOIN r b ON b.label = a.label AND b.i = a.i + 1)
SELECT label, vec_id AS kept FROM m WHERE kept""")
def w16(spark, d):
    return folds.fold(_vectors(spark, d), ["label"], ["vec_id"], ["vec_id", "embedding"], lambda: folds.LastKept(0.1), "kept long")


@query("w17_greedy_diverse", _diverse_sql("SELECT label, vec_id, embedding FROM embeddings", "label", 0.8))
def w17(spark, d):
    return folds.fold(_vectors(spark, d), ["label"], ["vec_id"], ["vec_id", "embedding"], lambda: folds.Diverse(0.8), "kept long")


@query("w19_merge_short", """WITH RECURSIVE r AS (SELECT user_id, round(value, 2) AS b, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2)) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
m AS (SELECT user_id, i, n, b AS kept, NULL::DOUBLE AS last, b AS said FROM r WHERE i = 1 UNION ALL
 SELECT r.user_id, r.i, r.n, CASE WHEN m.last - m.kept >= 25 THEN m.last ELSE m.kept END, r.b, CASE WHEN m.last - m.kept >= 25 THEN m.last END FROM m JOIN r ON r.user_id = m.user_id AND r.i = m.i + 1)
SELECT user_id, said AS boundary FROM m WHERE said IS NOT NULL UNION ALL SELECT user_id, last FROM m WHERE i = n AND last IS NOT NULL""")
def w19(spark, d):
    e = table(spark, d, "events").withColumn("b", F.round("value", 2))
    return folds.fold(e, ["user_id"], ["b"], ["b"], lambda: folds.MergeShort(25.0), "boundary double")


@query("w23_boundary_repeats", """WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events WHERE event_type <> ''),
m AS (SELECT user_id, i, event_id, event_type AS said, value AS a, value + 30 AS z, true AS kept FROM r WHERE i = 1 UNION ALL
 SELECT user_id, i, event_id, CASE WHEN rep THEN said ELSE event_type END, CASE WHEN rep THEN a ELSE value END, CASE WHEN rep THEN z ELSE value + 30 END, NOT rep
 FROM (SELECT r.*, m.said, m.a, m.z, r.event_type = m.said AND (r.value <= m.z + 0.3::DOUBLE OR abs(m.a - r.value) <= 0.3::DOUBLE) AS rep FROM m JOIN r ON r.user_id = m.user_id AND r.i = m.i + 1))
SELECT user_id, event_id AS kept FROM m WHERE kept""")
def w23(spark, d):
    e = table(spark, d, "events").withColumn("e", F.col("value") + 30)
    return folds.fold(e, ["user_id"], ["value", "event_id"], ["event_id", "event_type", "value", "e"], folds.DropRepeated, "kept long")


@query("w18_peaks", f"""WITH a AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x FROM embeddings), b AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n, quantile_cont(x, 0.75) OVER (PARTITION BY label) AS h FROM a WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id FROM b WHERE x > p AND x > n AND x >= h""")
def w18(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    a = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    high = a.groupBy("label").agg(F.percentile("x", F.lit(0.75)).alias("h"))
    return a.withColumn("p", F.lag("x").over(w)).withColumn("n", F.lead("x").over(w)).join(high, "label").filter("x > p AND x > n AND x >= h").select("vec_id")


@query("w18_prominent_peaks", None)
def w18b(spark, d):
    from lumenflow.operators import peaks

    a = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    chosen = peaks.chapter_peaks(a, "label", "vec_id", "x", 3, 0.05).select("label", "vec_id", F.lit("chapter").alias("kind"))
    return chosen.unionByName(peaks.energy_peaks(a, "label", "vec_id", "x", 2).select("label", "vec_id", F.lit("energy").alias("kind")))


@query("j13_knn", f"SELECT q, vec_id, rk FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id)::INTEGER AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rk <= 10")
def j13(spark, d):
    # a stated query set against all rows
    v = _vectors(spark, d).select("vec_id", F.col("embedding").alias("v"))
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    return retrieval.nearest(q, v, "q_id", "vec_id", 10).select(F.col("q_id").alias("q"), "vec_id", F.col("rank").alias("rk"))


@query("j14_kth_neighbour", f"SELECT a, round(dist, 6) AS dist FROM (SELECT a.vec_id AS a, 1 - {_COS} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_COS}, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rk = 3")
def j14(spark, d):
    return vectorjoin.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 3).filter("rank = 3").select("a", F.round("distance", 6).alias("dist"))


_CENT = "c AS (SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2) GROUP BY 1)"


@query("a10_centroids", f"WITH {_CENT} SELECT label, round(embedding[1] / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-8), 6) AS x0, round(embedding[64] / (sqrt({_DOT.format('embedding', 'embedding')}) + 1e-8), 6) AS x63 FROM c")
def a10(spark, d):
    c = clustering.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.get("c", F.lit(0)), 6).alias("x0"), F.round(F.get("c", F.lit(63)), 6).alias("x63"))


@query("j15_nearest_centroid", f"WITH {_CENT} SELECT vec_id, CASE WHEN 1 - cs > 0.7 THEN -1 ELSE label END::INTEGER AS label FROM (SELECT a.vec_id, b.label, {_COS} AS cs, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.label) AS rk FROM embeddings a, c b) WHERE rk = 1")
def j15(spark, d):
    e = table(spark, d, "embeddings")
    return clustering.assign(e, clustering.centroids(e, "label", "embedding"), "vec_id", "embedding", "label", 0.7)


_EDGE = f"e0 AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE 1 - {_COS} <= %s)"


@query("c04_dbscan_min1", f"WITH RECURSIVE {_EDGE % '0.6'}, cc AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e0.b, cc.root FROM cc JOIN e0 ON e0.a = cc.id WHERE cc.root < e0.b), r AS (SELECT id, min(root) AS root FROM cc GROUP BY 1) SELECT id, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS cluster FROM r")
def c04(spark, d):
    return clustering.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6, 1)


@query("c04_dbscan_min3", f"""WITH RECURSIVE {_EDGE % '0.63'}, deg AS (SELECT vec_id AS id, count(e0.b) + 1 AS n FROM embeddings LEFT JOIN e0 ON e0.a = vec_id GROUP BY 1), core AS (SELECT id FROM deg WHERE n >= 3),
ce AS (SELECT a, b FROM e0 WHERE a IN (FROM core) AND b IN (FROM core)), cc AS (SELECT id, id AS root FROM core UNION SELECT ce.b, cc.root FROM cc JOIN ce ON ce.a = cc.id WHERE cc.root < ce.b), r AS (SELECT id, min(root) AS root FROM cc GROUP BY 1),
nm AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM r)),
x AS (SELECT id, root FROM r UNION ALL SELECT e0.a, min(r.root) FROM e0 JOIN r ON r.id = e0.b WHERE e0.a NOT IN (FROM core) GROUP BY 1)
SELECT vec_id AS id, coalesce(cluster, -1)::INTEGER AS cluster FROM embeddings LEFT JOIN x ON x.id = vec_id LEFT JOIN nm USING (root)""")
def c04b(spark, d):
    return clustering.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", 0.63, 3)


@query("c03_eps_estimate", f"SELECT round(least(greatest(quantile_cont(dist, 0.4), least(quantile_cont(dist, 0.75), 0.9), 0.02), 0.9), 6) AS eps FROM (SELECT 1 - {_COS} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - {_COS}, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rk = 5")
def c03(spark, d):
    eps = clustering.estimate_eps(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 0.9)
    return spark.range(1).select(F.round(F.lit(eps), 6).alias("eps"))


@query("c01_frame_clusters", f"""WITH RECURSIVE rw AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
sc AS (SELECT label, i, vec_id, embedding AS last, true AS kept FROM rw WHERE i = 1 UNION ALL
 SELECT b.label, b.i, b.vec_id, CASE WHEN {_COS.replace('a.embedding', 'a.last')} >= 0.1 THEN a.last ELSE b.embedding END, {_COS.replace('a.embedding', 'a.last')} < 0.1 FROM sc a JOIN rw b ON b.label = a.label AND b.i = a.i + 1),
ca AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM sc WHERE kept)),
e0 AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM ca a JOIN ca b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE 1 - {_COS} <= 0.9),
deg AS (SELECT vec_id AS id, count(e0.b) + 1 AS n FROM ca LEFT JOIN e0 ON e0.a = vec_id GROUP BY 1), core AS (SELECT id FROM deg WHERE n >= 3),
ce AS (SELECT a, b FROM e0 WHERE a IN (FROM core) AND b IN (FROM core)), cc AS (SELECT id, id AS root FROM core UNION SELECT ce.b, cc.root FROM cc JOIN ce ON ce.a = cc.id WHERE cc.root < ce.b), r AS (SELECT id, min(root) AS root FROM cc GROUP BY 1),
x AS (SELECT id, root FROM r UNION ALL SELECT e0.a, min(r.root) FROM e0 JOIN r ON r.id = e0.b WHERE e0.a NOT IN (FROM core) GROUP BY 1),
c AS (SELECT label, root, list(m ORDER BY i) AS embedding FROM (SELECT label, root, i, avg(embedding[i]::DOUBLE) AS m FROM ca JOIN x ON x.id = vec_id, generate_series(1, 64) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
best AS (SELECT a.label, a.vec_id, b.root, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.root) AS rk FROM embeddings a JOIN c b ON a.label = b.label)
SELECT e.label AS media, e.vec_id, (coalesce(dense_rank() OVER (PARTITION BY e.label, root IS NULL ORDER BY root), 1) - 1)::INTEGER AS cluster FROM embeddings e LEFT JOIN (SELECT vec_id, root FROM best WHERE rk = 1) USING (vec_id)""")
def c01(spark, d):
    found = clustering.frame_clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.1, 0.9, 3)
    return found.select(F.col("label").alias("media"), "vec_id", F.col("cluster").cast("int").alias("cluster"))


@query("c02_adaptive_clusters", None)
def c02(spark, d):
    return clustering.adaptive_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 0.6, 1)


@query("a14_tfidf_keywords", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents), u AS (SELECT * FROM t WHERE length(term) >= 2 AND term NOT IN (%s)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM u GROUP BY 1, 2), v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 24),
w AS (SELECT doc_id, tf.term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT term, round(sum(w / n), 6) AS score FROM w JOIN n USING (doc_id) WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1 ORDER BY sum(w / n) DESC, term LIMIT 12""" % ", ".join(f"'{x}'" for x in text.STOP_DOCS))
def a14(spark, d):
    return keywords.tfidf_keywords(table(spark, d, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))


_LINKS = "l AS (SELECT DISTINCT l_suppkey AS src, 100000 + l_partkey AS dst FROM lineitem UNION SELECT 100000 + l_partkey, l_suppkey FROM lineitem)"


@query("g01_bfs", f"WITH {_LINKS}, d1 AS (SELECT DISTINCT dst AS node FROM l WHERE src = 1), d2 AS (SELECT DISTINCT dst AS node FROM l WHERE src IN (FROM d1)) SELECT 1 AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 WHERE node <> 1 UNION ALL SELECT node, 2 FROM d2 WHERE node <> 1 AND node NOT IN (FROM d1)")
def g01(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") + 100000).alias("p"))
    links = li.select(F.col("l_suppkey").alias("src"), F.col("p").alias("dst")).unionByName(li.select(F.col("p").alias("src"), F.col("l_suppkey").alias("dst"))).distinct()
    return crawl.bfs(links, spark.range(1, 2).select(F.col("id").alias("node")), 2)


def _embedded(rows: str, prefix: str = "") -> str:
    """SQL for (id, v): the stand-in embedding of the rows (id, body)."""
    return f"""(SELECT id, list(coalesce(floor(x / n * 1024 + 0.5) / 1024, 0.0::DOUBLE) ORDER BY g.k) AS v FROM (SELECT id FROM {rows}) CROSS JOIN generate_series(0, 31) g(k)
 LEFT JOIN (SELECT id, k, sum(s)::DOUBLE AS x FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 AS k, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END AS s FROM (SELECT id, unnest({_TOKENS.format(f"'{prefix}' || coalesce(body, '')")}) AS w FROM {rows})) GROUP BY 1, 2 HAVING sum(s) <> 0) USING (id, k)
 LEFT JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM (SELECT id, sum(s)::DOUBLE AS x FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 32 AS k, CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END AS s FROM (SELECT id, unnest({_TOKENS.format(f"'{prefix}' || coalesce(body, '')")}) AS w FROM {rows})) GROUP BY id, k) GROUP BY 1) USING (id) GROUP BY 1)"""


@query("x10_embeddings", f"SELECT id, i::INTEGER AS k, round(v[i + 1], 6) AS x FROM (WITH r AS (SELECT conv_id * 100 + turn AS id, text AS body FROM conversations) SELECT id, v FROM {_embedded('r')}), generate_series(0, 31) t(i)")
def x10(spark, d):
    from lumenflow.plans import models

    out = models.embed(table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), "id", "text")
    return out.select("id", F.posexplode("vector").alias("k", "x")).withColumn("x", F.round("x", 6))


@query("g02_retrieve_rerank", f"""WITH ch AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS id, doc_id, array_to_string(s[2*i+1:2*i+3], ' ') AS body FROM (SELECT doc_id, s, unnest(range(0, greatest(1, len(s) // 2))) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents) WHERE len(s) > 0)),
q AS (SELECT item_id AS id, trim(text) AS body FROM benchmark WHERE trim(text) <> ''), cv AS (SELECT * FROM {_embedded('ch', 'search_document: ')}), qv AS (SELECT * FROM {_embedded('q', 'search_query: ')}),
near AS (SELECT * FROM (SELECT qv.id AS item_id, cv.id, row_number() OVER (PARTITION BY qv.id ORDER BY list_inner_product(qv.v, cv.v) DESC, cv.id) AS rk FROM qv CROSS JOIN cv) WHERE rk <= 50),
pairs AS (SELECT item_id, doc_id, list_distinct({_TOKENS.format('q.body')}) AS qt, {_TOKENS.format('ch.body')} AS bt FROM near JOIN ch USING (id) JOIN q ON q.id = item_id),
best AS (SELECT item_id, doc_id, len(list_intersect(qt, bt)) / greatest(len(qt), 1)::DOUBLE - ln(1 + len(bt)) / 100 AS r FROM pairs),
rolled AS (SELECT item_id, doc_id, round(sum(r * exp(r)) / sum(exp(r)), 9) AS score FROM best GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, max(score) OVER (PARTITION BY item_id) AS top FROM rolled WHERE score >= 0.05) WHERE top - score <= 0.5 AND rank <= 5""")
def g02(spark, d):
    from lumenflow.plans.composites import retrieve_rerank

    return retrieve_rerank(table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text"))


@query("g03_chapters", None)
def g03(spark, d):
    from lumenflow.plans.composites import chapters

    return chapters(_vectors(spark, d), "label", "vec_id", "embedding", 5.0)


@query("g04_timeline", None)
def g04(spark, d):
    from lumenflow.plans.composites import timeline

    day, kinds = 86400, ("click", "error", "purchase", "signup", "view")
    e = table(spark, d, "events").select("user_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("long").alias("t"), "event_type", "value")
    tags = sequences.hop_windows(e, ["user_id", "event_type"], "t", 2 * day, day, (F.max("value") / 500).alias("conf")).withColumnRenamed("event_type", "label")
    # a window's class scores: the largest value of each type, 0 where the window has none
    best = sequences.hop_windows(e, ["user_id"], "t", 2 * day, day, *[F.coalesce(F.max(F.when(F.col("event_type") == x, F.col("value"))) / 100, F.lit(0.0)).alias(x) for x in kinds])
    p = vectors.softmax(F.array(*kinds), 0.7)
    moods = best.select("user_id", "k", F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in kinds]).alias("label"), p.alias("p"))))
    speech = e.filter("event_type = 'view'").select("user_id", F.col("t").alias("ts"), (F.col("t") + F.floor(F.col("value") * 200)).alias("te"))
    curve = e.groupBy("user_id", "t").agg(F.sum("value").alias("x")).withColumnRenamed("t", "at")
    return timeline(tags, moods, speech, curve, "user_id", 2 * day, day, ("click",), 0.35, 0.12, 0.15, 1.5 * day, 0.5 * day, 5)


@query("g05_transcript_enrich", f"""WITH {_EV}, s AS (SELECT user_id, event_id AS seg, t AS s, t + floor(value * 120)::BIGINT AS e FROM ev WHERE event_type IN ('click', 'view')),
u AS (SELECT user_id, event_id AS turn, t AS ts, t + floor(value * 200)::BIGINT AS te, event_type AS speaker FROM ev WHERE event_type NOT IN ('click', 'view')),
p AS (SELECT s.seg, turn, speaker, greatest(s, ts) AS o_start, least(e, te) AS o_end FROM s JOIN u ON s.user_id = u.user_id AND te > s AND ts < e),
l AS (SELECT seg, count(*)::INTEGER AS n, '[' || string_agg('{{"o_start":' || o_start || ',"o_end":' || o_end || ',"speaker":"' || speaker || '"}}', ',' ORDER BY o_start, o_end, speaker) || ']' AS listed, arg_min(speaker, (o_start - o_end, turn)) AS speaker FROM p GROUP BY 1)
SELECT seg, s, e, l.speaker, coalesce(n, 0)::INTEGER AS n_speakers, listed AS speakers FROM s LEFT JOIN l USING (seg)""")
def g05(spark, d):
    from lumenflow.plans.composites import enrich
    from lumenflow.queries.timelines import _segments, _turns

    return enrich(_segments(spark, d), _turns(spark, d))


@query("g06_map_reduce_summary", f"""WITH RECURSIVE {_PARAGRAPHS}, p AS (SELECT doc_id, count(*)::INTEGER AS n_sections, string_agg('[Section ' || (chunk + 1) || ']' || chr(10) || {_cut_sql('body', 160)}, chr(10) || chr(10) ORDER BY chunk) AS whole FROM chunks GROUP BY 1)
SELECT doc_id, n_sections, {_cut_sql('whole', 400)} AS summary FROM p""")
def g06(spark, d):
    from lumenflow.plans.composites import map_reduce_summary

    return map_reduce_summary(table(spark, d, "documents").select("doc_id", "text"))
