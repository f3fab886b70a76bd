"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a budget of words. A budget of e.g. 2.3 times the source's
words takes two complete epochs, then documents in the order of their
Efraimidis-Spirakis keys (exponential variables divided by the document's
quality weight) until their prefix sum reaches the rest.

The prefix sum over a source never runs in one task: keys fall into bins of
equal width of their logarithm, ``BINS`` to a doubling, so that bins are as fine
for large weights as for small ones; the bins' sums (some 20,000 rows a source)
locate the bin that holds the cut, and only that bin's rows are ordered. Rows
alike there are counted before, and ordered as a few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.session import durable

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BINS = 1024
PARTS = 4096  # a row that repeats very often is counted in so many parts
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of matches of WORD; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def es_key(ident: Column, weight: Column, seed: int) -> Column:
    """An exponential variable of rate ``weight``, drawn from a hash of ``ident``."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return -F.log((digits.cast("double") + 0.5) / float(1 << 52)) / weight


def targets(totals: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with ``target``: words to take from the source.

    Weights repeat over the sources in code-point order, null last. All sizes are shared out by weight; no target
    passes ``most`` times its source, and what is above is shared again by weight among the others: targets are
    min(most * size, level * weight) with the level that exhausts the total.
    """
    w = F.lit(weights[-1])
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    for i in range(len(weights) - 1):
        w = F.when(F.col("place") == i, weights[i]).otherwise(w)
    t = totals.withColumn("place", place).withColumn("w", w.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    below = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("source_size").over(everyone).cast("double")).withColumn("all_w", F.sum("w").over(everyone))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(below), F.lit(0.0))))
    # the level is right from the first source, by cap / weight, that stays below its cap; sources before it are at theirs
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("v")))).over(everyone)
    t = t.withColumn("v", level["v"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("v") * F.col("w"), F.col("cap"))).alias("target"))


def mix(rows: DataFrame, seed: int = 17, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, bins: int = BINS) -> DataFrame:
    """Rows (doc_id, source, size, quality) -> (doc_id, source, size, source_size, target, epochs, taken).

    ``quality``: a positive weight; null, zero, negative or NaN counts as 1. ``epochs``: how often the document is
    taken, 0 to ``most``; ``taken`` = epochs * size. Documents of size 0 follow their source's complete epochs. The
    cut falls at the document boundary nearest to the budget. Rows alike in id and size are interchangeable. The
    input is read once and kept, without text, in shared storage.
    """
    q = F.col("quality").cast("double")
    weight = F.when((q > 0) & ~F.isnan(q) & (q < float("inf")), q).otherwise(1.0)
    own = rows.select("doc_id", "source", F.col("size").cast("long"), es_key(F.col("doc_id"), weight, seed).alias("key"))
    own = durable(own.withColumn("bin", F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * bins).cast("int")))
    by_bin = own.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    to = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
    to = to.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    to = durable(to.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = by_bin.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    null_safe = lambda a, b: a["source"].eqNullSafe(b["source"])
    cut = sums.alias("a").join(to.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    cut = cut.filter("bin_start <= rest").groupBy("a.source").agg(F.max(F.struct("a.bin", "bin_start")).alias("cut"))
    plan = to.join(cut, null_safe(to, cut), "left").select(to["*"], F.col("cut.bin").alias("cut_bin"), F.col("cut.bin_start"))
    plan = durable(plan)
    # one row a source: joined by its key, so that a table of many sources is shuffled, and a small one is broadcast by its measured size
    full = own.join(plan, null_safe(own, plan)).select(own["*"], "source_size", "target", "whole", "rest", "cut_bin", "bin_start")
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    alike = full.filter(at_cut).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).groupBy(*full.columns, "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bin_start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    inside = alike.withColumn("start", start).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    inside = inside.withColumn("more", ((F.col("start") + F.col("i") * F.col("size") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)).cast("int")).select(*full.columns, "more")
    outside = full.filter(~at_cut).withColumn("more", (F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)) & (F.col("rest") > 0)).cast("int"))
    out = inside.unionByName(outside).withColumn("epochs", F.least(F.col("whole") + F.col("more"), F.lit(most)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 for documents labelled good, 1 for others; repeated labels count by the best."""
    return labels.groupBy("doc_id").agg((1 + F.coalesce(F.max("quality"), F.lit(0))).cast("double").alias("quality"))
