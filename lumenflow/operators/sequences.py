"""Operators over ordered rows, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.functions.vectors import dot
from lumenflow.operators.intervals import islands


def adjacent_dissimilarity(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """``d`` = 1 - dot with the next vector (last row dropped); ``smooth``: kernel 1/3 with zeros beyond the ends, if there are 3 or more."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("d", 1 - dot(F.col(vector), F.lead(vector).over(w))).filter("d IS NOT NULL")
    near = (F.coalesce(F.lag("d").over(w), F.lit(0.0)) + F.col("d") + F.coalesce(F.lead("d").over(w), F.lit(0.0))) / 3
    return out.withColumn("smooth", F.when(F.count("*").over(Window.partitionBy(*keys)) >= 3, near).otherwise(F.col("d")))


def smooth_probabilities(df: DataFrame, keys: list[str], order: str, label: str, p: str, window: int = 5, gamma: float = 1.35) -> DataFrame:
    """Long rows (keys, order, label, p) -> centred moving average with the edge rows repeated, shaped by ``gamma`` and
    brought to sum 1 again. An even window counts one more."""
    half = (window + (window % 2 == 0)) // 2
    w = Window.partitionBy(*keys, label).orderBy(order)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.col(p)
    for k in range(1, half + 1):
        total = total + F.coalesce(F.lag(p, k).over(w), F.first(p).over(all_)) + F.coalesce(F.lead(p, k).over(w), F.last(p).over(all_))
    out = df.withColumn("__s", F.pow(F.least(F.greatest(total / (2 * half + 1), F.lit(1e-8)), F.lit(1.0)), F.lit(gamma)))
    return out.withColumn("smooth", F.col("__s") / F.sum("__s").over(Window.partitionBy(*keys, order))).drop("__s")


def vote3(df: DataFrame, keys: list[str], ordinal: str, label: str, confidence: str, digits: int | None = None) -> DataFrame:
    """``voted``: the label with the largest summed confidence among a row and its neighbours (first met on ties, labels
    without any confidence last), sums rounded to ``digits`` decimals, if given; under 3 rows, the own."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    near = F.array(*[F.struct(F.lit(i).alias("i"), at(label).alias("l"), at(confidence).cast("double").alias("c"), here.alias("here")) for i, (at, here) in enumerate([
        (lambda c: F.lag(c).over(w), F.lag(F.lit(True)).over(w)), (F.col, F.lit(True)), (lambda c: F.lead(c).over(w), F.lead(F.lit(True)).over(w))])])
    out = df.withColumn("__near", near)
    rows = F.filter("__near", lambda r: r["here"])

    def score(r: Column) -> Column:
        own = F.filter(rows, lambda x: x["l"].eqNullSafe(r["l"]) & x["c"].isNotNull())
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["c"])
        return F.struct((F.size(own) > 0).alias("any"), F.when(F.size(own) > 0, total if digits is None else F.round(total, digits)).alias("s"), (-r["i"]).alias("first"), r["l"].alias("l"))

    best = F.array_max(F.transform(rows, score))["l"]
    few = F.count("*").over(Window.partitionBy(*keys)) < 3
    return out.withColumn("voted", F.when(few, F.col(label)).otherwise(best)).drop("__near")


def timeline_merge(df: DataFrame, keys: list[str], label: str, max_gap: float = 1.5, least: float = 0.5) -> DataFrame:
    """Rows (keys, s, e, label, conf) -> merged spans: a row joins the one before it (by start) if it has its label and
    starts less than ``max_gap`` after its end; the span's end is that of its last row. Confidence folds by length:
    the span so far, its new end included, against the row. Spans shorter than ``least`` go.

    Only rows of one island are folded together, inside the JVM.
    """
    w = Window.partitionBy(*keys).orderBy("s", "ord")
    new = ~((F.lag(label).over(w) == F.col(label)) & (F.col("s") - F.lag("e").over(w) < max_gap))
    marked = islands(df, keys, [F.col("s"), F.col("ord")], new)
    rows = F.sort_array(F.collect_list(F.struct("s", "ord", "e", "conf")))
    merged = marked.groupBy(*keys, "island").agg(F.first(label).alias(label), rows.alias("__r"))
    head = F.get("__r", F.lit(0))

    def fold(a: Column, x: Column) -> Column:
        span, own = (x["e"] - a["s"]).cast("double"), (x["e"] - x["s"]).cast("double")
        return F.struct(a["s"].alias("s"), x["e"].alias("e"), F.when(span + own == 0, a["conf"]).otherwise((a["conf"] * span + x["conf"] * own) / (span + own)).alias("conf"))

    out = merged.select(*keys, "island", label, F.aggregate(F.slice("__r", F.lit(2), F.greatest(F.size("__r") - 1, F.lit(0))), F.struct(head["s"].alias("s"), head["e"].alias("e"), head["conf"].alias("conf")), fold).alias("__m"))
    return out.select(*keys, "island", label, "__m.s", "__m.e", "__m.conf").filter(F.col("e") - F.col("s") >= least)


def action_merge(df: DataFrame, keys: list[str], label: str, max_gap: float = 0.5) -> DataFrame:
    """Rows by (s, -conf): a row joins the run before it if it has its label and starts at most ``max_gap`` after the
    run's latest end; end and confidence are maxima."""
    order = [F.col("s"), F.desc("conf"), F.col("ord")]
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(df, keys, order, ~(F.lag(label).over(w) == F.col(label)), "__run")
    inside = Window.partitionBy(*keys, "__run").orderBy(*order)
    ended = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    parts = islands(runs, [*keys, "__run"], order, ~(F.col("s") - ended <= max_gap), "__part")
    return parts.groupBy(*keys, "__run", "__part").agg(F.first(label).alias(label), F.min("s").alias("s"), F.max("e").alias("e"), F.max("conf").alias("conf")).drop("__run", "__part")


def activity_segments(df: DataFrame, keys: list[str], frame: str, score: str, threshold: float, merge: int, least: int, pad: int, total: int) -> DataFrame:
    """Runs of frames with score >= threshold, gaps up to ``merge`` frames; runs of ``least`` frames and more stay, then
    are padded and clipped to [0, total] (they may overlap then). ``peak``: the first frame of the largest score."""
    active = df.filter(F.col(score) >= threshold)
    w = Window.partitionBy(*keys).orderBy(frame)
    runs = islands(active, keys, [F.col(frame)], ~(F.col(frame) - F.lag(frame).over(w) <= merge))
    out = runs.groupBy(*keys, "island").agg(F.min(frame).alias("a"), F.max(frame).alias("z"), F.max_by(frame, F.struct(score, -F.col(frame))).alias("peak"))
    out = out.filter(F.col("z") - F.col("a") >= least)
    return out.select(*keys, F.greatest(F.lit(0), F.col("a") - pad).alias("start"), F.least(F.lit(total), F.col("z") + pad).alias("end"), "peak")


def hysteresis(df: DataFrame, keys: list[str], order: str, x: str, on: float, off: float, hop: float, least: float) -> DataFrame:
    """Segments that begin where x > on and end where x < off; an open one ends with the data. Times are order * hop."""
    w = Window.partitionBy(*keys).orderBy(order)
    state = F.last(F.when(F.col(x) > on, 1).when(F.col(x) < off, 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__st", F.coalesce(state, F.lit(0)))
    runs = islands(rows, keys, [F.col(order)], ~(F.lag("__st").over(w) == F.col("__st")))
    out = runs.filter("__st = 1").groupBy(*keys, "island").agg(F.min(order).alias("a"), F.max(order).alias("z"))
    long = out.filter((F.col("z") + 1 - F.col("a")) * hop >= least)  # not by the difference of two rounded times
    return long.select(*keys, (F.col("a") * hop).alias("start"), ((F.col("z") + 1) * hop).alias("end"))


def word_timing(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """One row a word: a segment's time is dealt to its words by their lengths; ends are rounded and clipped, the running
    time is not."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    lens = F.transform("__w", lambda x: F.length(x))
    total = F.aggregate(lens, F.lit(0), lambda a, b: a + b)
    rows = df.withColumn("__w", words).filter(F.size("__w") > 0).withColumn("__t", total)
    rows = rows.select(*df.columns, "__w", "__t", F.posexplode("__w").alias("word_index", "word"))
    upto = lambda n: F.aggregate(F.transform(F.slice("__w", F.lit(1), n), lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    at = lambda n: F.col(start) + (F.col(end) - F.col(start)) * upto(n) / F.col("__t")
    out = rows.withColumn("word_start", F.round(at(F.col("word_index")), 3)).withColumn("word_end", F.least(F.round(at(F.col("word_index") + 1), 3), F.col(end)))
    return out.drop("__w", "__t")


def fps_sample(df: DataFrame, keys: list[str], frame: str, t: str, fps: float | None) -> DataFrame:
    """The first frame at or after each k / fps (less 1e-6), each frame once; all frames if fps is null or not positive."""
    if not fps or fps <= 0:
        return df.select(*keys, frame)
    # the grid points a frame is first for are those in (time before, own time]
    w = Window.partitionBy(*keys).orderBy(t, frame)
    before = F.lag(t).over(w)
    slot = lambda x: F.floor((x + 1e-6) * fps)
    return df.withColumn("__s", slot(F.col(t))).withColumn("__p", F.coalesce(slot(before), F.lit(-1))).filter("__s > __p").select(*keys, frame)


def hop_windows(df: DataFrame, keys: list[str], t: str, size: int, hop: int, *aggs: Column) -> DataFrame:
    """Aggregates over [k * hop, k * hop + size)."""
    last = F.floor(F.col(t) / hop)
    first = F.greatest(F.lit(0), F.floor((F.col(t) - size) / hop) + 1)
    rows = df.withColumn("k", F.explode(F.sequence(first, last)))
    return rows.groupBy(*keys, "k").agg(*aggs)


def margin_filter(df: DataFrame, keys: list[str], score: str, margin: float) -> DataFrame:
    """Rows within ``margin`` of the best of their key."""
    best = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn("__best", best).filter(F.col("__best") - F.col(score) <= margin).drop("__best")


def keyframe_plan(scenes: DataFrame, media: str, first: str, last: str, fps: float, order: list[str] | None = None) -> DataFrame:
    """Frames to keep of each scene [first, last]: max(1, round(length / base)) (halves to even), the middle if one, else spread evenly
    with both ends; base is the larger of the median and the mean of the media's positive lengths (1 if none).

    Halves hang on the last bit of the mean, so lengths are summed one after another in the order of ``order`` (else first and last)."""
    length = (F.col(last) - F.col(first) + 1) / F.lit(fps)
    rows = scenes.withColumn("__d", length)
    positive = F.when(F.col("__d") > 0, F.col("__d"))
    w = Window.partitionBy(media).orderBy(*(order or [first, last])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.coalesce(F.greatest(F.percentile(positive, F.lit(0.5)).over(w), F.avg(positive).over(w)), F.lit(1.0))
    n = F.least(F.greatest(F.lit(1), F.bround(F.col("__d") / F.col("base")).cast("long")), F.col(last) - F.col(first) + 1)
    rows = rows.filter(F.col(media).isNotNull()).withColumn("base", base).withColumn("n", n).filter("n >= 1")
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col(first) + F.floor((F.col(last) - F.col(first)) * i / F.greatest(F.col("n") - 1, F.lit(1))).cast("long"))
    frames = F.when(F.col("n") == 1, F.array(F.floor((F.col(first) + F.col(last)) / 2).cast("long"))).otherwise(spread)
    return rows.withColumn("frame", F.explode(frames)).drop("__d")
