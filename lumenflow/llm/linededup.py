"""Line deduplication by overlapping windows of three lines.

Every run of three consecutive lines is hashed (128 bits); a window that
occurs more than once is kept where it occurs first, by document id and
position, and the lines that its later occurrences cover go. Windows of one
document that overlap the kept occurrence are part of it, not later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.operators.joins import split_join
from lumenflow.session import durable

SPAN = 3


def _two_hashes(*cols) -> list[Column]:
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """All columns of ``docs``, with the text rewritten, and ``n_lines``, ``n_removed`` (int) added or replaced.

    Null texts stay null (0 lines); texts under ``span`` lines stay whole; windows of blank lines only don't count.
    Rows alike in id and text share one verdict; null ids come after all others; equal ids are ordered by a hash of
    the text. A text that loses all its lines becomes empty. Other columns may have any names.

    Windows are made once and written as two hashes and a place; the texts are shuffled once. Repeated windows are
    found by an aggregate with map-side combine. A window that many documents share, and a row that repeats often,
    are hot keys of joins in which both sides have a shuffle of their own, so adaptive execution splits them.
    """
    k1, k2 = _two_hashes(id_col, text_col)
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("n_lines", "n_removed")]).alias("row"), k1.alias("k1"), k2.alias("k2"))
    body = F.col(f"row.`{text_col}`")
    lines, n = F.col("lines"), F.col("n")
    split = rows.select("k1", "k2", F.col(f"row.`{id_col}`").alias("id"), F.split(body, "\n", -1).alias("lines")).withColumn("n", F.size("lines"))

    def window(i: Column) -> Column:
        own = [F.get(lines, i + j) for j in range(span)]
        h1, h2 = _two_hashes(*own)
        return F.when(F.trim(F.translate(F.concat(*own), "\t\r\x0b\x0c", "    ")) != "", F.struct(h1.alias("h1"), h2.alias("h2")))

    places = split.filter(n >= span).select("k1", "k2", "id", F.posexplode(F.transform(F.sequence(F.lit(0), n - span), window)).alias("pos", "h"))
    places = durable(places.filter("h IS NOT NULL").select("h.*", "k1", "k2", "pos", "id"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "pos")).alias("first")
    repeated = places.groupBy("h1", "h2").agg(first, F.count("*").alias("c")).filter("c > 1")
    repeated = repeated.select("h1", "h2", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("k1", "k2", "pos")])
    later = split_join(places, repeated, ["h1", "h2"]).filter(f"k1 <> first_k1 OR k2 <> first_k2 OR pos >= first_pos + {span}")
    starts = later.groupBy("k1", "k2").agg(F.collect_set("pos").alias("starts"))
    back = split_join(rows, starts, ["k1", "k2"], "left").withColumn("lines", F.split(body, "\n", -1))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (span - 1)))))
    back = back.withColumn("n_lines", F.greatest(F.size("lines"), F.lit(0))).withColumn("kept", F.when(F.col("starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), covered)))
    text = F.when(F.col("starts").isNull(), body).otherwise(F.array_join(F.transform("kept", lambda i: F.get(lines, i)), "\n"))
    out = [text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    removed = F.when(F.col("starts").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept"))
    return back.select(*out, "n_lines", removed.alias("n_removed"))
