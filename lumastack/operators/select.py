"""Filters and sub-stacks: ranges, strides, index lists, crops, channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FRAME


def plane(pixels: DataFrame, **keys) -> DataFrame:
    """The pixels of one plane, e.g. ``c="ch0", m=0, t=3, z=0``."""
    for name, value in keys.items():
        pixels = pixels.where(F.col(name) == value)
    return pixels


def time_range(pixels: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames start, start + stride, ... below end, renumbered from 0."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    kept = pixels.where((F.col("t") >= start) & ((F.col("t") - start) % stride == 0))
    if end is not None:
        kept = kept.where(F.col("t") < end)
    return kept.withColumn("t", ((F.col("t") - start) / stride).cast("int"))


def depth_range(pixels: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Depths from start (not below 0) to before end."""
    kept = pixels.where(F.col("z") >= max(start, 0))
    return kept if end is None else kept.where(F.col("z") < end)


def series(pixels: DataFrame, c: str, m: int = 0, t_start: int = 0, t_end: int | None = None, t_stride: int = 1, z_mode: str = "max", z_index: int = 0, z_start: int = 0, z_end: int | None = None) -> DataFrame:
    """One channel of one position over time, its depths projected; ``none`` pins one depth."""
    from .project import z_project

    kept = time_range(pixels.where((F.col("c") == c) & (F.col("m") == m)), t_start, t_end, t_stride)
    if z_mode == "none":
        return z_project(kept.where(F.col("z") == z_index), "max")
    return z_project(depth_range(kept, z_start, z_end), z_mode)


def subset(pixels: DataFrame, axis: str, indices: Sequence[int]) -> DataFrame:
    """Keep some indices of an axis, renumbered in order. Repeats and indices that don't occur are ignored; an empty list keeps the axis."""
    wanted = sorted(set(indices))
    if not wanted:
        return pixels
    spark = pixels.sparkSession
    present = pixels.select(axis).distinct().join(F.broadcast(spark.createDataFrame([(i,) for i in wanted], f"{axis} int")), axis)
    from pyspark.sql.window import Window

    # at most len(indices) rows are ranked
    order = present.select(axis, (F.row_number().over(Window.orderBy(axis)) - 1).alias("new_"))
    return pixels.join(F.broadcast(order), axis).withColumn(axis, F.col("new_")).drop("new_").select(*pixels.columns)


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """The rectangle from (x, y), moved to the origin."""
    kept = pixels.where((F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h))
    return kept.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def channels(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    if not names:
        raise ValueError("no channel is enabled")
    return pixels.where(F.col("c").isin(*names))


def even_indices(n: int, k: int) -> list[int]:
    """At most k whole numbers spread evenly over 0 .. n - 1, both ends included."""
    if n <= k:
        return list(range(n))
    return sorted({i * (n - 1) // (k - 1) for i in range(k)}) if k > 1 else [0]


def even_frames(pixels: DataFrame, k: int) -> DataFrame:
    """The pixels of at most k frames spread evenly over the frame numbers."""
    n = (pixels.agg(F.max("t")).first()[0] or 0) + 1
    return pixels.where(F.col("t").isin(*even_indices(n, k)))


#: Groups of measurement columns, and those shown by default. Fixed values.
COLUMN_GROUPS = {
    "Identity": ["segmentation_channel", "frame", "label_id", "m_position"],
    "Size": ["area_px", "area_um2", "volume_um3"],
    "Change (Δ)": ["delta_area_px", "delta_area_um2", "delta_volume_um3"],
    "Position": ["centroid_y_px", "centroid_x_px", "centroid_y_um", "centroid_x_um", "centroid_y_stage_um", "centroid_x_stage_um"],
    "Shape": ["perimeter", "circularity", "eccentricity", "solidity"],
    "Bounding box": ["bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col"],
    "Tracking": ["track_id", "track_length", "track_validation"],
}
DEFAULT_COLUMNS = [
    "segmentation_channel", "frame", "label_id", "area_px", "area_um2", "delta_area_um2", "centroid_y_um", "centroid_x_um",
    "circularity", "eccentricity", "solidity", "track_id", "track_length", "track_validation",
]


def select_columns(rows: DataFrame, selected: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """Selected columns in the table's order; columns outside the catalogue stay."""
    known = set(known if known is not None else [c for g in COLUMN_GROUPS.values() for c in g])
    return rows.select(*[c for c in rows.columns if c in set(selected) or c not in known])


__all__ = ["COLUMN_GROUPS", "DEFAULT_COLUMNS", "FRAME", "channels", "crop", "depth_range", "even_frames", "even_indices", "plane", "select_columns", "series", "subset", "time_range"]
