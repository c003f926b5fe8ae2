"""Consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, spread

#: Virtual nodes of a shard. The ring, and all that the driver holds, has shards x this many arcs whatever the rows.
VIRTUAL = 64
RING = 1 << 32
#: Places are looked up by their upper bits: 2^12 cells.
CELL = 20


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RING))


def ring_points(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """The ring's (place, shard) points in clockwise order; a virtual node is named by its shard and its own number, so one more shard only adds points."""
    shard, replica = F.expr(f"cast(id div {virtual} as int)"), F.col("id") % virtual
    node = F.concat_ws("#", F.lit("shard"), shard.cast("string"), replica.cast("string"))
    points = spark.range(shards * virtual).select(_place(node).alias("place"), shard.alias("shard"))
    return sorted((r.place, r.shard) for r in points.collect())


def spill_clockwise(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, end rank, shard, first slot).

    ``counts`` are keys by arc, ``owners`` the shard at each arc's end. Every
    arc offers its keys to its shard; what a full shard can't take is offered at
    the next point clockwise, round after round. Within a round points are
    served in ring order. Capacities must sum to the keys at least.
    """
    free, size, n = list(capacity), [0] * len(capacity), len(counts)
    waiting: list[list[tuple[int, int, int]]] = [[(a, 0, c)] if c else [] for a, c in enumerate(counts)]
    placed = []
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for a, runs in enumerate(waiting):
            shard = owners[a]
            for home, lo, hi in runs:
                take = min(hi - lo, free[shard])
                if take:
                    placed.append((home, lo, lo + take, shard, size[shard]))
                    free[shard] -= take
                    size[shard] += take
                if lo + take < hi:
                    onward[(a + 1) % n].append((home, lo + take, hi))
        waiting = onward
    return placed


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """Deal rows over ``shards``; with ``slack`` 0 counts differ by one at most (law ``rows``).

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. A key's
    place on the ring is its hash; the point at or after it owns it. Each shard
    takes floor(n / shards) rows, the first n mod shards of them one more; with
    ``slack`` up to ceil(n (1 + slack) / shards). Rows beyond that continue
    clockwise. Ranks within an arc order by parts of the arc (which grow in
    number with the rows), place, key, size and checksum, so reruns agree; rows
    alike in all of these are interchangeable. A null key's place is that of its
    size and checksum; a null text has size 8 and checksum 0. Extra columns are
    ignored, an empty table gives no rows. Only counts by arc (shards x virtual)
    reach the driver, and what is broadcast is the arcs' runs, a few times as many.
    """
    spark = docs.sparkSession
    points = ring_points(spark, shards, virtual)
    owners = [s for _, s in points]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    # arc i holds the places after point i - 1 up to point i; arc 0 also those after the last point
    spans, last = [], -1
    for i, (place, _) in enumerate(points):
        spans.append((i, last, place))
        last = place
    spans.append((0, last, RING))
    cells = [(c, i, lo, hi) for i, lo, hi in spans for c in range(max(lo, 0) >> CELL, (hi >> CELL) + 1)]
    arcs = F.broadcast(spark.createDataFrame(cells, "cell long, arc int, after long, upto long"))
    place = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(size, crc), F.lit(RING))).otherwise(_place(F.col(key)))
    keyed = docs.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), place.alias("place"))
    keyed = keyed.withColumn("cell", F.shiftright("place", CELL)).join(arcs, "cell").where("place > after AND place <= upto").drop("cell", "after", "upto")
    counts = [0] * len(points)
    for r in keyed.groupBy("arc").count().collect():
        counts[r.arc] = r["count"]
    total = sum(counts)
    even = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = [max(c, math.ceil(total * (1 + slack) / shards)) for c in even] if slack else even
    runs = spark.createDataFrame(spill_clockwise(counts, owners, capacity), "arc int, lo long, hi long, shard int, at long")
    # parts of an arc by hashes of whole rows, so that neither a long arc nor a key of many rows is one task
    parts = keyed.withColumn("part", spread(F.struct("doc_id", "size", "text_crc32"), max(1, bucket_count(total) // len(points))))
    before = parts.groupBy("arc", "part").agg(F.count("*").alias("n"))
    before = before.select("arc", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("arc", "part").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = parts.withColumn("k", F.row_number().over(inner) - 1).join(before, ["arc", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    r = F.broadcast(runs)
    return ranked.join(r, (ranked.arc == r.arc) & (ranked["rank"] >= r.lo) & (ranked["rank"] < r.hi)).select(
        "doc_id", "size", "text_crc32", F.lit("rows" if not slack else "slack").alias("law"), "shard", (F.col("at") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
