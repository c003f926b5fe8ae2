"""Projections and pooling: depth projection, mean pooling, pyramids, frame means."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FRAME, SERIES

_NO_Z = [k for k in FRAME if k != "z"]


def z_project(pixels: DataFrame, mode: str = "max") -> DataFrame:
    """Project the depths: ``max``, ``min``, ``mean`` (truncated) or ``middle`` (depth n div 2)."""
    if mode == "middle":
        n = pixels.groupBy(*_NO_Z).agg((F.max("z") + 1).alias("nz_"))
        out = pixels.join(n, _NO_Z).where(F.col("z") == F.expr("nz_ div 2"))
        return out.withColumn("z", F.lit(0)).select(*pixels.columns)
    value = {"max": F.max("v"), "min": F.min("v"), "mean": F.floor(F.avg("v")).cast("int")}
    if mode not in value:
        raise ValueError(f"unknown projection {mode!r}")
    return pixels.groupBy(*_NO_Z, "y", "x").agg(value[mode].alias("v")).withColumn("z", F.lit(0)).select(*pixels.columns)


def mean_pool(pixels: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Mean over k x k cells, truncated; rows and columns that fill no cell are left out."""
    kept = pixels.where((F.col("y") < height // k * k) & (F.col("x") < width // k * k))
    return kept.groupBy(*FRAME, F.expr(f"cast(y div {k} as int)").alias("y"), F.expr(f"cast(x div {k} as int)").alias("x")).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def pyramid_depth(height: int, width: int, base: int = 256, low: int = 2, high: int = 6) -> int:
    """Levels for a plane: the binary logarithm of its longer side over ``base``, within limits."""
    longest = max(height, width)
    return min(max(math.floor(math.log2(longest / base)) if longest >= base else low, low), high)


def pyramid(pixels: DataFrame, height: int, width: int, levels: int, least: int = 32) -> DataFrame:
    """Levels 1 .. n by mean pooling of level 0, in one pass; a level with a side below ``least`` ends it. Adds ``level``."""
    fit = [n for n in range(1, levels + 1) if min(height >> n, width >> n) >= least]
    if not fit:
        raise ValueError("the plane is too small for a pyramid")
    cells = F.explode(F.array(*[F.lit(n) for n in fit])).alias("level")
    rows = pixels.select(*FRAME, "y", "x", "v", cells)
    side = F.expr("cast(pow(2, level) as int)")
    rows = rows.where((F.col("y") < F.floor(F.lit(height) / side) * side) & (F.col("x") < F.floor(F.lit(width) / side) * side))
    return rows.groupBy(
        *FRAME, "level", F.floor(F.col("y") / side).cast("int").alias("y"), F.floor(F.col("x") / side).cast("int").alias("x")
    ).agg(F.floor(F.avg("v")).cast("int").alias("v"))


def frame_means(pixels: DataFrame) -> DataFrame:
    """``mean`` of each frame and ``grand_mean``, the mean of a series' frame means."""
    means = pixels.groupBy(*FRAME).agg(F.avg("v").alias("mean"))
    # summed as decimals, so that the result doesn't depend on the order of frames
    grand = means.groupBy(*SERIES).agg((F.sum(F.col("mean").cast("decimal(28,15)")).cast("double") / F.count("mean")).alias("grand_mean"))
    return means.join(grand, SERIES).select(*FRAME, "mean", "grand_mean")
