"""Keyword ranking by TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions import text
from lumenflow.session import durable


def tfidf_keywords(docs: DataFrame, ident: str, body: str, stop: tuple = text.STOP_DOCS, limit: int = 12) -> DataFrame:
    """(term, score): vocabulary of the 2 * limit most frequent terms (2 letters or more, no stop words), smooth idf, rows of
    unit length, summed over documents; terms of digits only are dropped, then the first ``limit`` stay. Ties by term.

    Terms are counted first, so only the vocabulary's terms are counted by document.
    """
    terms = docs.select(ident, F.explode(text.tokens(F.col(body))).alias("term")).filter((F.length("term") >= 2) & ~F.col("term").isin(*stop))
    vocabulary = durable(terms.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(2 * limit).select("term"))
    tf = durable(terms.join(F.broadcast(vocabulary), "term").groupBy(ident, "term").agg(F.count("*").alias("tf")))  # 2 * limit rows
    n = docs.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # 2 * limit rows and one row
    w = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(ident)))
    scores = w.withColumn("w", F.col("w") / norm).groupBy("term").agg(F.sum("w").alias("score"))
    return scores.filter(~F.col("term").rlike("^[0-9]+$")).orderBy(F.desc("score"), "term").limit(limit)
