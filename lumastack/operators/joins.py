"""Join-shaped operators: chains of files, assignments, ledgers, diffs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import written
from .ranks import numbered


def chain_map(sizes: DataFrame, order: str = "asc") -> DataFrame:
    """``out_idx, file_idx, local_idx`` of files with ``file_idx, n``: one file after the other (asc, desc) or interleaved."""
    rows = sizes.where("n > 0").select("file_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("local_idx"))
    levels = {"asc": (["file_idx"], ["local_idx"]), "desc": (["back_"], ["local_idx"]), "interleaved": (["local_idx"], ["file_idx"])}
    if order not in levels:
        raise ValueError(f"unknown order {order!r}")
    placed = numbered(rows.withColumn("back_", -F.col("file_idx")), [], *levels[order], name="nth_")
    return placed.select((F.col("nth_") - 1).cast("int").alias("out_idx"), "file_idx", "local_idx")


def apply_chain(parts: DataFrame, chain: DataFrame, axis: str = "t") -> DataFrame:
    """Read files as one axis: ``parts`` has ``file_idx`` and the axis; the axis becomes ``out_idx``."""
    m = chain.withColumnRenamed("local_idx", axis)
    return parts.join(m, ["file_idx", axis]).withColumn(axis, F.col("out_idx")).drop("out_idx", "file_idx")


def chain_faults(chain: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries whose file or local index is out of range."""
    return chain.join(sizes, "file_idx", "left").where("n IS NULL OR local_idx < 0 OR local_idx >= n").select("out_idx", "file_idx", "local_idx")


def axis_mismatches(shapes: DataFrame, axes: Sequence[str], chain_axis: str) -> DataFrame:
    """Axes besides the chain's on which the files differ: ``axis, n_values``."""
    long = shapes.unpivot([], [a for a in axes if a != chain_axis], "axis", "size")
    return long.groupBy("axis").agg(F.count_distinct("size").alias("n_values")).where("n_values > 1")


#: (pattern, axis): lower-case file names' patterns of chain axes, tried in this order. Fixed values.
NAME_PATTERNS = [
    (r"count\d+", "T"),
    (r"time\d+", "T"),
    (r"t\d+(?![a-z])", "T"),
    (r"zstack\d+", "Z"),
    (r"z\d+(?![a-z])", "Z"),
    (r"pos\d+", "M"),
    (r"m\d+(?![a-z])", "M"),
    (r"p\d+(?![a-z])", "M"),
    (r"channel\w+", "C"),
    (r"ch\d+", "C"),
    (r"c\d+(?![a-z])", "C"),
]


def suggest_axis(names: DataFrame, column: str, patterns: Sequence[tuple[str, str]] = NAME_PATTERNS) -> DataFrame:
    """``axis``: that of the first pattern that the last parts of two paths at least match, in lower case."""
    name = F.lower(F.regexp_extract(F.col(column), r"[^/]*$", 0))
    hits = names.agg(*[F.count_if(name.rlike(p)).alias(f"h{i}") for i, (p, _) in enumerate(patterns)])
    axis = F.lit(None).cast("string")
    for i, (_, a) in reversed(list(enumerate(patterns))):
        axis = F.when(F.col(f"h{i}") >= 2, a).otherwise(axis)
    return hits.select(axis.alias("axis"))


def combined_metadata(chain: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row along the chain: count, mean step between neighbouring positions, ordered lists. ``catalog`` has ``file_idx, local_idx, pos, name``."""
    rows = chain.join(catalog, ["file_idx", "local_idx"])
    step = F.abs(F.col("pos") - F.lag("pos").over(Window.orderBy("out_idx")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("out_idx", "pos", "name"))), lambda s: F.struct(s["pos"].alias("pos"), s["name"].alias("name")))
    return rows.withColumn("step", step).agg(F.count("*").alias("n"), F.avg("step").alias("mean_step"), listed.alias("entries"))


def nearest(regions: DataFrame, detections: DataFrame, by: Sequence[str], tie: str, value: str, cell: float = 2.0) -> DataFrame:
    """``value`` of the detection (``y, x``) nearest to each region's centroid (``lid, cy, cx``) of the same group; ties, at 6 decimals of the squared distance, to the least ``tie``.

    Detections are known by the cells they lie in, and by these cells' fours,
    sixteens and so on. A region takes the smallest size of cell of which one
    near it holds a detection; the nearest one then lies at most three cells
    away. Going down to the smallest cells it follows those only that can hold
    it: whose near side isn't beyond the far side of another. So it reads the
    detections of a few cells, however crowded its group is, by joins on keys.
    Regions of groups without detections have no row.
    """
    keys = list(by)
    own = detections.select(*keys, F.col("y").alias("y_"), F.col("x").alias("x_"), F.col(tie).alias("tie_"), F.col(value).alias("value_"), F.floor(F.col("y") / cell).alias("gy"), F.floor(F.col("x") / cell).alias("gx"))
    asked = regions.select(*keys, "lid", F.col("cy").cast("double").alias("cy"), F.col("cx").cast("double").alias("cx"))
    ends = [d.agg(F.min(y), F.max(y), F.min(x), F.max(x)).first() for d, y, x in ((own, "y_", "x_"), (asked, "cy", "cx"))]
    if any(v is None for e in ends for v in e):
        span = 0.0
    else:
        span = max(max(e[i + 1] for e in ends) - min(e[i] for e in ends) for i in (0, 2))
    levels = max(1, math.ceil(math.log2(max(span / cell, 1)))) + 1
    up = lambda k, level: F.floor(F.col(k) / F.pow(F.lit(2.0), level))
    every = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    cells = written(own.select(*keys, "gy", "gx").distinct().withColumn("level", every).select(*keys, "level", up("gy", F.col("level")).alias("gy"), up("gx", F.col("level")).alias("gx")).distinct(), "nearest-cells")
    around = lambda n: F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-n, n + 1) for b in range(-n, n + 1)]))
    at = lambda k: F.floor(F.col(k) / cell / F.pow(F.lit(2.0), F.col("level")))

    def near(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("d_", around(n)).withColumns({"gy": at("cy") + F.col("d_.dy"), "gx": at("cx") + F.col("d_.dx")}).drop("d_")

    def fit(rows: DataFrame) -> DataFrame:
        side = F.pow(F.lit(2.0), F.col("level")) * cell
        reach = {}
        for g, c, k in (("gy", "cy", "y"), ("gx", "cx", "x")):
            low, high = F.col(g) * side - F.col(c), (F.col(g) + 1) * side - F.col(c)
            reach |= {f"n{k}_": F.greatest(low, -high, F.lit(0.0)), f"f{k}_": F.greatest(F.abs(low), F.abs(high))}
        square = lambda a, b: F.col(a) * F.col(a) + F.col(b) * F.col(b)
        best = F.min("far_").over(Window.partitionBy(*keys, "lid"))
        out = rows.withColumns(reach).withColumns({"near_": square("ny_", "nx_"), "far_": square("fy_", "fx_")}).withColumn("best_", best)
        return out.where(F.col("near_") <= F.col("best_") + 1e-5).select(*keys, "lid", "cy", "cx", "level", "gy", "gx")

    first = near(asked.withColumn("level", every), 1).join(cells, [*keys, "level", "gy", "gx"], "left_semi").groupBy(*keys, "lid", "cy", "cx").agg(F.min("level").alias("level"))
    going = fit(near(first, 3).join(cells, [*keys, "level", "gy", "gx"], "left_semi"))
    for level in range(levels - 1, -1, -1):
        finer = F.array(*[F.struct((F.col("gy") * 2 + a).alias("gy"), (F.col("gx") * 2 + b).alias("gx")) for a in (0, 1) for b in (0, 1)])
        down = F.col("level") > level
        step = going.withColumn("g_", F.explode(F.when(down, finer).otherwise(F.array(F.struct("gy", "gx")))))
        step = step.withColumns({"gy": F.col("g_.gy"), "gx": F.col("g_.gx"), "level": F.when(down, level).otherwise(F.col("level"))}).drop("g_")
        going = fit(step.join(cells, [*keys, "level", "gy", "gx"], "left_semi"))
    found = going.join(own, [*keys, "gy", "gx"])
    far = F.round((F.col("cy") - F.col("y_")) * (F.col("cy") - F.col("y_")) + (F.col("cx") - F.col("x_")) * (F.col("cx") - F.col("x_")), 6)
    return found.groupBy(*keys, "lid").agg(F.min_by("value_", F.struct(far, F.col("tie_"))).alias(value))


def config_diff(before: DataFrame, after: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Keys added, removed or changed: ``key, before, after, change``."""
    a, b = before.select(F.col(key).alias("key"), F.col(value).alias("before"), F.lit(1).alias("in_a")), after.select(F.col(key).alias("key"), F.col(value).alias("after"), F.lit(1).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed")
    return a.join(b, "key", "full").where(F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select("key", "before", "after", change.alias("change"))


def without_rejected(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drop rows of rejected tracks, mark accepted ones; rows without a track stay. ``decisions`` has ``track_id, status``."""
    kept = rows.join(decisions.where("status = 'rejected'").select("track_id"), "track_id", "left_anti")
    return kept.join(decisions.where("status = 'accepted'").select("track_id", F.col("status").alias("track_validation")), "track_id", "left")


def pending(work: DataFrame, ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the ledger doesn't have yet."""
    return work.join(ledger.select(*key), list(key), "left_anti")


def link_candidates(objects: DataFrame, distance: float) -> DataFrame:
    """Pairs of objects of consecutive present frames whose centroids are at most ``distance`` apart and whose boxes overlap.

    ``objects``: ``source_file, m, c, frame, label_id, cy, cx, y0, x0, y1, x1``.
    Frames are ranked among those present. Each object meets the next frame's
    objects in its own and the neighbouring cells of a grid as wide as the
    distance, so the join is on keys.
    """
    group = ["source_file", "m", "c"]
    ranks = objects.select(*group, "frame").distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy(*group).orderBy("frame")))
    o = objects.join(ranks, [*group, "frame"]).withColumns({"gy": F.floor(F.col("cy") / distance), "gx": F.floor(F.col("cx") / distance)})
    cells = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    a = o.withColumn("d", F.explode(cells)).select(
        *group, (F.col("rank") + 1).alias("rank"), (F.col("gy") + F.col("d.dy")).alias("gy"), (F.col("gx") + F.col("d.dx")).alias("gx"),
        *[F.col(k).alias(f"a_{k}") for k in ("frame", "label_id", "cy", "cx", "y0", "x0", "y1", "x1")],
    )
    pairs = a.join(o, [*group, "rank", "gy", "gx"])
    far = F.sqrt(F.pow(F.col("a_cy") - F.col("cy"), 2) + F.pow(F.col("a_cx") - F.col("cx"), 2))
    overlap = (F.col("a_y0") < F.col("y1")) & (F.col("y0") < F.col("a_y1")) & (F.col("a_x0") < F.col("x1")) & (F.col("x0") < F.col("a_x1"))
    return pairs.withColumn("distance", far).where((F.col("distance") <= distance) & overlap).select(
        *group, F.col("a_frame").alias("frame_a"), F.col("a_label_id").alias("label_a"), F.col("frame").alias("frame_b"), F.col("label_id").alias("label_b"), "distance"
    )
