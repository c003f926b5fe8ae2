"""Tile layouts from stage positions, serpentines, 1-D clusters, stitched mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered


def stage_layout(tiles: DataFrame, pixel_um: float, tile_h: int, tile_w: int) -> DataFrame:
    """``m, off_y, off_x``: both stage axes negated, from the least x and the greatest y; positions within 0.1 um of each other fall back to a square grid.

    ``tiles``: ``m, stage_x, stage_y``. Extremes are one aggregate, positions
    are numbered by counts of stretches of ``m``.
    """
    ends = tiles.agg(F.count("*").alias("n"), *[f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("stage_x", "stage_y")])
    numbers = numbered(tiles.withColumn("stretch_", F.floor(F.col("m") / 4096)), [], ["stretch_"], ["m"], name="i").crossJoin(F.broadcast(ends))
    x, y, i = F.col("stage_x"), F.col("stage_y"), F.col("i") - 1
    side = F.ceil(F.sqrt("n"))
    flat = F.greatest(F.col("max_stage_x") - F.col("min_stage_x"), F.col("max_stage_y") - F.col("min_stage_y")) <= 0.1
    off_x, off_y = F.bround((F.col("max_stage_x") - x) / pixel_um, 0), F.bround((y - F.col("min_stage_y")) / pixel_um, 0)
    return numbers.select(
        "m",
        F.when(flat, F.floor(i / side) * tile_h).otherwise(off_y).cast("int").alias("off_y"),
        F.when(flat, (i % side) * tile_w).otherwise(off_x).cast("int").alias("off_x"),
    )


def cluster_positions(values: DataFrame, cap: float) -> DataFrame:
    """``value, cluster, centre``: sorted positions split at gaps above a tolerance from the data.

    If two neighbouring sorted gaps differ by more than 3 times, the middle of
    the widest such pair is the tolerance, otherwise half the least gap; never
    above ``cap``. Each position then goes to the nearest cluster mean.
    """
    v = values.select("value").where("value IS NOT NULL").distinct()
    line = Window.orderBy("value")
    gaps = v.select((F.lead("value").over(line) - F.col("value")).alias("g")).where("g > 1e-9")
    g = Window.orderBy("g")
    pairs = gaps.select("g", F.lead("g").over(g).alias("up")).withColumn("ratio", F.col("up") / F.col("g"))
    best = pairs.where("ratio > 3").agg(F.max_by((F.col("g") + F.col("up")) / 2, "ratio").alias("mid"))
    least = gaps.agg((F.min("g") / 2).alias("half"))
    tol = best.crossJoin(least).select(F.least(F.coalesce("mid", "half"), F.lit(cap)).alias("tol"))
    split = v.crossJoin(F.broadcast(tol)).withColumn("new", F.when(F.col("value") - F.lag("value").over(line) > F.col("tol"), 1).otherwise(0))
    ids = split.withColumn("cluster", F.sum("new").over(line))
    centres = ids.groupBy("cluster").agg(F.avg("value").alias("centre"))
    near = v.crossJoin(F.broadcast(centres)).groupBy("value").agg(F.min_by(F.struct("cluster", "centre"), F.struct(F.abs(F.col("value") - F.col("centre")), "cluster")).alias("c"))
    return near.select("value", F.col("c.cluster").alias("cluster"), F.col("c.centre").alias("centre"))


def serpentine(i: Column, columns: int, tile_h: int, tile_w: int) -> tuple[Column, Column]:
    """(off_y, off_x) of the i-th tile: rows left to right and back in turn."""
    row, at = F.floor(i / columns).cast("int"), (i % columns).cast("int")
    return row * tile_h, F.when(row % 2 == 0, at).otherwise(columns - 1 - at) * tile_w


def stitch(pixels: DataFrame, layout: DataFrame, height: int | None = None, width: int | None = None, fill: bool = False) -> DataFrame:
    """Mosaic per (source_file, t, z, c): tiles moved to their offsets; on overlap the later tile wins. Uncovered pixels only with ``fill``, as 0."""
    moved = pixels.join(layout, "m").withColumns({"y": F.col("y") + F.col("off_y"), "x": F.col("x") + F.col("off_x")})
    if height is not None:
        moved = moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    keys = ["source_file", "t", "z", "c"]
    out = moved.groupBy(*keys, "y", "x").agg(F.max_by("v", "m").alias("v"))
    if fill:
        spine = pixels.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        out = spine.join(out, [*keys, "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return out
