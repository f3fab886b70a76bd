"""Queries over the driver's tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import avi, bpe, langid, linededup, mixing, onebit, ring, secretscan, simhash, suffix
from lumenflow.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and acceptance of every document; learned from those whose id's crc32 modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, with hashes of its ids and of the bytes they decode to."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    out = bpe.decode(ids)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    found = secretscan.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = [r.kind for r in secretscan.BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(said(of(*base)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later occurrences of repeated three-line windows."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, lines[i:i+2] AS win FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d WHERE len(lines) >= 3)
      WHERE trim(array_to_string(lines[i:i+2], ''), chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
f AS (SELECT *, min((doc_id, i)) OVER (PARTITION BY win) AS fst FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS line FROM f, (VALUES (0), (1), (2)) t(k)
         WHERE doc_id <> fst[1] OR i >= fst[2] + 3),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text, count(*) AS n
      FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.i WHERE g.line IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::INTEGER AS n_lines, (coalesce(len(d.lines), 0) - coalesce(k.n, 0))::INTEGER AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM d LEFT JOIN k USING (doc_id)
"""


def op5_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a motion-JPEG file, read back: hashes of payload and file, and its shots."""
    media = avi.text_to_avi(table(spark, sf_dir, "documents"))
    out = avi.read_clips(media)
    clips = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"], c["end_ms"])), ",")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("clips").cast("string"), F.lit(" shots, ms "), clips).alias("feature"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight shards."""
    out = ring.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    # bounded loads without slack: counts at most one apart; where a row goes depends on all rows
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sized(docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.quality_weights(table(docs.sparkSession, sf_dir, "labels"))
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return sized.join(labels, "doc_id", "left")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(_sized(table(spark, sf_dir, "documents"), sf_dir))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def _level_sql(sizes: str) -> str:
    """``sizes``: a query of (source, source_size); gives tgt(source, source_size, target)."""
    return rf"""
s0 AS ({sizes}),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, (3 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / w AS r, ((SELECT sum(source_size) FROM s1)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM s1) - coalesce(sum(w) OVER b, 0)) AS lev
       FROM s1 WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM s2 WHERE lev * w <= cap ORDER BY r, lev LIMIT 1) * w, cap)) AS target FROM s2)"""


def _mix_sql(docs: str) -> str:
    """``docs``: a relation of (doc_id, source, text); gives the rows of mixing.mix as CTE ``mixed``."""
    return rf"""
m0 AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(q.quality, 1.0) AS weight
       FROM {docs} d LEFT JOIN (SELECT doc_id, (1 + coalesce(max(quality), 0))::DOUBLE AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id),
m1 AS (SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM m0),
{_level_sql("SELECT source, sum(size)::BIGINT AS source_size FROM m1 GROUP BY source")},
m2 AS (SELECT m1.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
       coalesce(sum(size) OVER (PARTITION BY m1.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
       FROM m1 JOIN tgt t ON t.source IS NOT DISTINCT FROM m1.source),
mixed AS (SELECT doc_id, source, size, source_size, target,
       least(3, whole + CASE WHEN target - whole * source_size > 0 AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS epochs FROM m2)"""


OP8_SQL = f"WITH {_mix_sql('documents')} SELECT doc_id, source, size, source_size, target, (epochs * size)::BIGINT AS taken FROM mixed"

def op9_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20. A repeated id asks once for each of its different vectors."""
    index = onebit.build_index(table(spark, sf_dir, "embeddings"))
    return onebit.search(index, F.col("id") % 20 == 0, k=20)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of smaller ids, and a hash of the rest."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_byte_bpe, op3_secrets, op4_line_dedup, op5_avi_clips, op6_simhash, op7_sharding, op8_mixing, op9_one_bit_search, op10_suffix_dedup)
}
ORACLES = {"op4_line_dedup": OP4_SQL, "op8_mixing": OP8_SQL}
