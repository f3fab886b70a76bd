"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every row has a position on a ring of ``2**cell_bits`` cells; every shard has
``vnodes`` virtual nodes on it. A row belongs to the first virtual node
clockwise; where that shard is full, the row continues clockwise to the next
shard that is not. Loads are bounded by ``ceil((1 + slack) * rows / shards)``;
without slack the bounds are dealt so that counts differ by one at most.

Which rows a full shard keeps is decided by cell, then by position inside the
cell, so the walk needs only the number of rows in each cell: at most
``2**cell_bits`` counts reach the driver, whatever the input's size. Rows are
ranked inside their cell (a window over a 16,384th of the rows) and look up
the cell's few (rank range -> shard) pieces in a table of bounded size. Rows
alike in all columns, which no hash can spread, are counted before, and enter
the window as a few counts.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenflow.session import durable

CELL_BITS = 14
VNODES = 64
PARTS = 4096  # a row that repeats very often is counted in so many parts


def preferences(shards: int, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> list[tuple[int, list[int]]]:
    """(last cell of the arc, its shards in clockwise order of first meeting) for each arc, by cell."""
    nodes = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - cell_bits), s)
        for s in range(shards)
        for v in range(vnodes)
    )
    arcs = []
    for i, (cell, _) in enumerate(nodes):
        if i and nodes[i - 1][0] == cell:
            continue  # the arc of a shared cell starts at its first node
        arcs.append((cell, list(dict.fromkeys(s for _, s in nodes[i:] + nodes[:i]))))
    return arcs


def allot(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> list[dict]:
    """Pieces {cell, lo, hi, shard, slot0}: ranks lo..hi-1 of the cell go to the shard, from slot slot0 on.

    In step k every cell's rest is offered to its k-th shard clockwise; shards take cells in ring order while they have room.
    """
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    if slack > 0:
        room = [max(r, -int(-(1 + slack) * n // shards)) for r in room]
    arcs = preferences(shards, vnodes, cell_bits)
    order: dict[int, list[int]] = {}
    i = 0
    for cell in sorted(counts):
        while i < len(arcs) and arcs[i][0] < cell:
            i += 1
        order[cell] = arcs[i % len(arcs)][1]
    left, used, pieces = dict(counts), [0] * shards, []
    for k in range(shards):
        for cell in sorted(left):
            s = order[cell][k]
            if take := min(left[cell], room[s] - used[s]):
                lo = counts[cell] - left[cell]
                pieces.append({"cell": cell, "lo": lo, "hi": lo + take, "shard": s, "slot0": used[s]})
                used[s] += take
                left[cell] -= take
        left = {c: v for c, v in left.items() if v}
    return pieces


def place(rows: DataFrame, position: Column, ties: list[str], shards: int, slack: float = 0.0, vnodes: int = VNODES, cell_bits: int = CELL_BITS) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    ``position``: a long hash that spreads the rows; ``ties``: columns that order rows of equal position (rows
    alike in all columns are interchangeable). ``rows`` is written to shared storage once, so pass narrow rows. Columns
    named shard or slot are replaced. Empty input gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    wide = rows.select(F.struct(*kept).alias("row"), position.alias("pos"))
    wide = durable(wide.withColumn("cell", F.shiftrightunsigned("pos", 64 - cell_bits).cast("int")))
    counts = {r["cell"]: r["count"] for r in wide.groupBy("cell").count().collect()}  # 2**cell_bits rows at most
    pieces = allot(counts, shards, slack, vnodes, cell_bits)
    listed = wide.sparkSession.range(1).select(F.from_json(F.lit(json.dumps(pieces)), "array<struct<cell:int,lo:long,hi:long,shard:int,slot0:long>>").alias("p"))
    listed = listed.select(F.inline("p"))  # 2**cell_bits + shards**2 rows at most, so it may be broadcast
    alike = wide.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).groupBy("cell", "pos", "row", "part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell").orderBy("pos", *[F.col(f"row.`{c}`") for c in ties], "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    a, z = F.greatest("first", "lo"), F.least(F.col("first") + F.col("n"), F.col("hi"))
    joined = ranked.join(F.broadcast(listed), "cell").filter(a < z).withColumn("rank", F.explode(F.sequence(a, z - 1)))
    return joined.select("row.*", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0) -> DataFrame:
    """Documents -> (doc_id, size, text_crc32, shard, slot); size: UTF-8 bytes plus 1.

    Null ids and null texts are placed like any others; rows with one id are spread by their texts; equal rows are
    interchangeable; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("h"),
    )
    return place(rows, F.col("h"), ["doc_id", "text_crc32", "size"], shards, slack).drop("h")
