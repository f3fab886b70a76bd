"""A training-data pipeline over ``documents``: language ID, line dedup, near-duplicates, mixing, byte-level BPE.

Each stage gets the documents its predecessor kept, as written to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import bpe, langid, linededup, mixing, simhash
from lumenflow.session import durable, release, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = ["k0", "k1"]


def with_row(docs: DataFrame) -> DataFrame:
    """COLUMNS, and ROW: 128 bits that tell rows apart where ids are null or repeat."""
    values = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return docs.select(*COLUMNS, *[F.xxhash64(F.lit(k), *values).alias(k) for k in ROW])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score above the calibrated threshold stay; those without a letter go."""
    docs = docs.select(COLUMNS)
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).filter("accepted").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; documents that lose all their lines go."""
    out = linededup.dedup_lines(docs.select(COLUMNS)).filter("n_removed = 0 OR n_removed < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (sets of five-word shingles of a similarity of 0.8 and more, as wide SimHash
    fingerprints tell) one row stays: of the smallest id (rows without an id come last), and of rows that share it the
    smallest by text, lang, source. So each group keeps a row, whatever its ids are."""
    docs = with_row(docs)
    own = durable(simhash.wide_fingerprints(docs, keep=tuple(ROW)))
    first = durable(own.join(simhash.groups(own, simhash.wide_links), "fp").filter(F.col("id").eqNullSafe(F.col("component_id"))).select("root", *ROW))
    kept = durable(first.groupBy("root").agg(F.count("*").alias("c"), *[F.min(k).alias(k) for k in ROW]))
    single = docs.join(kept.filter("c = 1").select(*ROW), ROW, "left_semi").select(COLUMNS)
    tied = first.join(kept.filter("c > 1").select("root"), "root", "left_semi").distinct()
    smallest = docs.join(tied, ROW).groupBy("root").agg(F.min(F.struct(*COLUMNS[1:], "doc_id")).alias("r")).select("r.*")
    return single.unionByName(smallest.select(COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = with_row(docs)
    labels = mixing.quality_weights(table(spark, sf_dir, "labels"))
    rows = durable(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.struct(*ROW).alias("row")))
    # rows differ after near-duplicate removal, ids need not: the first row of an id is drawn by the id, others by id and row
    first = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("first"))
    whole = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[f"row.{k}" for k in ROW])
    rows = rows.join(first, "doc_id", "left").withColumn("name", F.when(F.col("row") == F.col("first"), F.col("doc_id").cast("string")).otherwise(whole))
    rows = durable(rows.join(labels, "doc_id", "left").select("name", "source", "size", "quality", "row.*"))
    taken = mixing.mix(rows.withColumnRenamed("name", "doc_id")).filter("epochs > 0").select(F.col("doc_id").alias("name"), "epochs")
    taken = rows.join(taken, "name").select(*ROW, "epochs")
    return docs.join(taken, ROW).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens) of every document, in the order of no particular key."""
    ids = bpe.encode(docs.select(COLUMNS), keep=["doc_id", "source"])
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each but the last is written to shared storage and read by the next. Once a
    stage is written, its predecessor's rows and its own intermediate tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            out = stage(spark, docs, sf_dir)
        kept = durable(out)
        for old in [*made, docs]:
            release(old)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: models, SimHash components and BPE are beyond SQL; tests/llm compares run() with a plain version
ORACLE_SQL = None
