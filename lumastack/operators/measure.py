"""Object measurements: regions, per-channel intensities, perimeter, moments, hulls, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FRAME

OBJECT = [*FRAME, "label_id"]


def regions(labelled: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Area, centroid, half-open bounding box and intensity statistics of each object; ``labelled`` has ``y, x, v, label_id``."""
    return labelled.groupBy(*by).agg(
        F.count("*").alias("area_px"),
        F.avg("y").alias("centroid_y_px"),
        F.avg("x").alias("centroid_x_px"),
        F.min("y").alias("bbox_min_row"),
        F.min("x").alias("bbox_min_col"),
        (F.max("y") + 1).alias("bbox_max_row"),
        (F.max("x") + 1).alias("bbox_max_col"),
        F.avg("v").alias("mean_intensity"),
        F.min("v").alias("min_intensity"),
        F.max("v").alias("max_intensity"),
    )


def channel_intensities(labels: DataFrame, pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every channel under each object, as columns ``mean_intensity_<c>``, ``std_intensity_<c>``."""
    keys = [k for k in FRAME if k != "c"]
    long = labels.select(*keys, "y", "x", "label_id", F.col("c").alias("segmentation_channel")).join(pixels, [*keys, "y", "x"])
    name = lambda c: c.replace(" ", "_")
    stats = [a for c in channels for a in (F.avg(F.when(F.col("c") == c, F.col("v"))).alias(f"mean_intensity_{name(c)}"), F.stddev_pop(F.when(F.col("c") == c, F.col("v"))).alias(f"std_intensity_{name(c)}"))]
    return long.groupBy(*keys, "segmentation_channel", "label_id").agg(*stats)


def moments(labels: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Eccentricity of the ellipse with the same second central moments (each pixel a unit square)."""
    m = labels.groupBy(*by).agg((F.var_pop("y") + 1 / 12).alias("a"), (F.var_pop("x") + 1 / 12).alias("b"), F.covar_pop("y", "x").alias("k"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("k") * F.col("k"))
    return m.select(*by, F.sqrt(F.greatest(F.lit(0.0), F.round(1 - (half - root) / (half + root), 9))).alias("eccentricity"))


NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def perimeter(labels: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Length of the line through the centres of border pixels, 4-neighbour border.

    A border pixel has a 4-neighbour outside its object. Its code counts 2 for
    each 4-neighbour and 10 for each diagonal neighbour on the border, plus 1;
    codes 5, 7, 15, 17, 25, 27 weigh 1, codes 21, 33 root 2, codes 13, 23 half
    of (1 + root 2).
    """
    by = list(by)
    at = [*by, "y", "x"]
    cells = labels.select(*at)
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS if 0 in (dy, dx)])).alias("d")
    inner = cells.select(*at, near).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    inner = inner.groupBy(*at).agg(F.count("*").alias("n")).where("n = 4").select(*at)
    border = cells.join(inner, at, "left_anti")
    step_ = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(10 if dy and dx else 2).alias("w")) for dy, dx in NEIGHBOURS])).alias("d")
    told = border.select(*at, step_).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("d.w").alias("w"))
    told = told.union(border.select(*at, F.lit(1).alias("w")))
    codes = told.groupBy(*at).agg(F.sum("w").alias("code"), F.max(F.when(F.col("w") == 1, 1)).alias("own")).where("own = 1")
    root = math.sqrt(2)
    weight = F.when(F.col("code").isin(5, 7, 15, 17, 25, 27), 1.0).when(F.col("code").isin(21, 33), root).when(F.col("code").isin(13, 23), (1 + root) / 2).otherwise(0.0)
    return codes.groupBy(*by).agg(F.sum(weight).alias("perimeter"))


def solidity(labels: DataFrame, by: Sequence[str] = OBJECT) -> DataFrame:
    """Area over the number of pixels whose centres lie in the hull of the object's pixel outlines.

    Only each row's extent goes to the hull, so a group has an object's height
    of rows.
    """
    by = list(by)
    extents = labels.groupBy(*by, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = set()
        for y, lo, hi in zip(pdf.y.tolist(), pdf.lo.tolist(), pdf.hi.tolist()):
            pts |= {(y - 0.5, lo), (y + 0.5, lo), (y, lo - 0.5), (y, hi + 0.5), (y - 0.5, hi), (y + 0.5, hi)}
        pts = sorted(pts)

        def half(points):
            out = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = half(pts)[:-1] + half(pts[::-1])[:-1]
        y0, y1, x0, x1 = int(pdf.y.min()), int(pdf.y.max()), int(pdf.lo.min()), int(pdf.hi.max())
        yy, xx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        within = np.ones(yy.shape, dtype=bool)
        for (ay, ax), (cy, cx) in zip(ring, ring[1:] + ring[:1]):
            within &= (cy - ay) * (xx - ax) - (cx - ax) * (yy - ay) >= -1e-9
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "solidity": [pdf.n.sum() / within.sum()]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in extents.schema if f.name in by) + ", solidity double"
    return extents.groupBy(*by).applyInPandas(hull, schema)


def volume(area: Column, voxels: Column, pixel_um: float, z_step_um: float, n_z: int) -> Column:
    """Voxels x pixel area x depth step; without a voxel count the area stands for every depth."""
    return F.coalesce(voxels, area * n_z) * (pixel_um * pixel_um * z_step_um)


def summary(rows: DataFrame, pixel_um: float = 1.0) -> DataFrame:
    """One row: objects, frames with objects, mean and population deviation of the area in px and square um; zeros if empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a = pixel_um * pixel_um
    return rows.agg(
        F.count("*").alias("n_objects"),
        F.count_distinct("frame").alias("n_frames"),
        zero(F.avg("area_px")).alias("mean_area_px"),
        zero(F.stddev_pop("area_px")).alias("std_area_px"),
        zero(F.avg(F.col("area_px") * a)).alias("mean_area_um2"),
        zero(F.stddev_pop(F.col("area_px") * a)).alias("std_area_um2"),
    )


def per_frame(rows: DataFrame, spine: DataFrame) -> DataFrame:
    """Count and mean area of every frame of the spine, empty frames included."""
    agg = rows.groupBy("frame").agg(F.count("*").alias("n"), F.avg("area_px").alias("mean_area"))
    return spine.join(agg, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_area", F.lit(0.0)).alias("mean_area"))


def background_stats(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean and population deviation of each frame's pixels outside objects."""
    rest = pixels.join(labels.select(*FRAME, "y", "x").hint("merge"), [*FRAME, "y", "x"], "left_anti")
    return rest.groupBy(*FRAME).agg(F.avg("v").alias("background_mean"), F.stddev_pop("v").alias("background_std"))


def deltas(rows: DataFrame, value: Sequence[str] = ("area_px",), key: str = "label_id", order: Sequence[str] = ("frame",)) -> DataFrame:
    """Add ``delta_<column>`` to the object's row before; null on its first."""
    line = Window.partitionBy("source_file", "m", "segmentation_channel", key).orderBy(*order)
    return rows.withColumns({f"delta_{c}": F.col(c) - F.lag(c).over(line) for c in value})


def latency_summary(log: DataFrame, by: Sequence[str] = ("event",), value: str = "duration_us") -> DataFrame:
    """Per event n, mean, nearest-rank p50 (x[n div 2]) and p99 (x[min(n - 1, trunc(0.99 n))]) in ms, and mean rate.

    Exact from counts by value (``ranks``): an event with most of the log is
    spread over tasks.
    """
    from .ranks import median_rank, nearest_ranks, p99_rank

    rows = log.where(F.col(value).isNotNull())
    picked = nearest_ranks(rows, by, value, p50=median_rank, p99=p99_rank)
    out = picked.join(rows.groupBy(*by).agg(F.avg(F.col(value) / 1000).alias("mean_ms")), list(by))
    out = out.select(*by, "n", "mean_ms", (F.col("p50") / 1000).alias("p50_ms"), (F.col("p99") / 1000).alias("p99_ms"))
    return out.withColumn("fps", F.when(F.col("mean_ms") > 0, 1000 / F.col("mean_ms")).otherwise(0.0))
