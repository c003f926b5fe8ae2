"""Drawn shapes and strips: membership, label order, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def strips(specs: DataFrame, height: int, width: int) -> DataFrame:
    """Full strips of each spec in order: ``label_id, y0, x0, y1, x1``; a strip that the edge would cut is left out.

    ``specs``: ``ord, direction (vertical or horizontal), height_px, width_px,
    x_offset_px, start_offset_px, gap_px``. Vertical strips follow each other
    along y, horizontal ones along x.
    """
    v = F.col("direction") == "vertical"
    length, end = F.when(v, F.col("height_px")).otherwise(F.col("width_px")), F.when(v, height).otherwise(width)
    fits = specs.withColumns({"len": length, "end": end}).where("start_offset_px + len <= end")
    starts = fits.withColumn("s", F.explode(F.expr("sequence(start_offset_px, end - len, len)")))
    rows = starts.select(
        "ord", "s",
        F.when(v, F.col("s")).otherwise(F.col("x_offset_px")).alias("y0"), F.when(v, F.col("x_offset_px")).otherwise(F.col("s")).alias("x0"),
        F.when(v, F.col("s") + F.col("height_px")).otherwise(F.col("x_offset_px") + F.col("height_px")).alias("y1"),
        F.when(v, F.col("x_offset_px") + F.col("width_px")).otherwise(F.col("s") + F.col("width_px")).alias("x1"),
    )
    return rows.withColumn("label_id", F.row_number().over(Window.orderBy("ord", "s"))).select("label_id", "y0", "x0", "y1", "x1")


def shape_order(shapes: DataFrame, offset: int = 0) -> DataFrame:
    """Label ids of shapes: those of all depths first, then by depth, then as drawn; from ``offset`` + 1."""
    everywhere = F.when(F.col("z_key") == "all", 0).otherwise(1)
    line = Window.partitionBy("m", "t").orderBy(everywhere, F.try_to_number("z_key", F.lit("999999")), "ord")
    return shapes.withColumn("label_id", F.row_number().over(line) + offset)


def _edges(vertices: Column) -> Column:
    n = F.size(vertices)
    return F.transform(vertices, lambda p, i: F.struct(p.alias("a"), F.element_at(vertices, (i + 1) % n + 1).alias("b")))


def contains(kind: Column, vertices: Column, y: Column, x: Column) -> Column:
    """Whether (y, x) lies in a shape: rect (two corners, rounded, both ends in), ellipse (centre, radii), polygon (even-odd)."""
    y0, x0, y1, x1 = (F.element_at(vertices, i)[k] for i, k in ((1, "y"), (1, "x"), (2, "y"), (2, "x")))
    rect = (y >= F.bround(F.least(y0, y1), 0)) & (y <= F.bround(F.greatest(y0, y1), 0)) & (x >= F.bround(F.least(x0, x1), 0)) & (x <= F.bround(F.greatest(x0, x1), 0))
    ellipse = F.pow((y - y0) / F.greatest(y1, F.lit(1e-9)), 2) + F.pow((x - x0) / F.greatest(x1, F.lit(1e-9)), 2) <= 1
    crossings = F.aggregate(
        _edges(vertices), F.lit(0),
        lambda n, e: n + F.when(((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]), 1).otherwise(0),
    )
    return F.when(kind == "rect", rect).when(kind == "ellipse", ellipse).otherwise(crossings % 2 == 1)


def shape_labels(pixels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pixels inside shapes with their label; where shapes overlap the last drawn wins.

    Shapes are few and meet their frame's pixels within their bounding boxes by
    a join on (m, t). ``shapes``: ``m, t, ord, type, vertices, label_id``.
    """
    ys, xs = F.transform("vertices", lambda p: p["y"]), F.transform("vertices", lambda p: p["x"])
    e = F.col("type") == "ellipse"
    c, r = F.element_at("vertices", 1), F.element_at("vertices", 2)
    boxed = shapes.withColumns({
        "by0": F.when(e, c["y"] - r["y"]).otherwise(F.array_min(ys)), "by1": F.when(e, c["y"] + r["y"]).otherwise(F.array_max(ys)),
        "bx0": F.when(e, c["x"] - r["x"]).otherwise(F.array_min(xs)), "bx1": F.when(e, c["x"] + r["x"]).otherwise(F.array_max(xs)),
    })
    near = pixels.join(boxed, ["m", "t"]).where("y >= by0 - 1 AND y <= by1 + 1 AND x >= bx0 - 1 AND x <= bx1 + 1")
    keys = [k for k in ("source_file", "m", "t", "z", "c", "y", "x") if k in pixels.columns]
    hit = near.where(contains(F.col("type"), F.col("vertices"), F.col("y"), F.col("x")))
    return hit.groupBy(*keys).agg(F.max_by("label_id", "ord").alias("label_id"))


def voxel_counts(labels: DataFrame) -> DataFrame:
    """Pixels of each label over all depths of a frame, of every file, position and channel."""
    keys = [k for k in ("source_file", "m", "t", "c") if k in labels.columns]
    return labels.groupBy(*keys, "label_id").agg(F.count("*").alias("n"))


def polygonise(shapes: DataFrame, n: int = 32) -> DataFrame:
    """Shapes as polygons: a rectangle's four corners, an ellipse's n points, polygons as they are."""
    a, b = F.element_at("vertices", 1), F.element_at("vertices", 2)
    point = lambda y, x: F.struct(y.alias("y"), x.alias("x"))
    rect = F.array(point(a["y"], a["x"]), point(a["y"], b["x"]), point(b["y"], b["x"]), point(b["y"], a["x"]))
    angle = lambda i: i * (2 * 3.141592653589793 / n)
    ellipse = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(a["y"] + b["y"] * F.sin(angle(i)), a["x"] + b["x"] * F.cos(angle(i))))
    return shapes.withColumn("vertices", F.when(F.col("type") == "rect", rect).when(F.col("type") == "ellipse", ellipse).otherwise(F.col("vertices")))


def resample_polygon(shapes: DataFrame, n: int) -> DataFrame:
    """``shape_id, i, y, x``: n points at equal arc length around each closed polygon, from its first vertex."""
    edges = shapes.select("shape_id", F.posexplode(_edges(F.col("vertices"))).alias("k", "e"))
    length = F.sqrt(F.pow(F.col("e.b.y") - F.col("e.a.y"), 2) + F.pow(F.col("e.b.x") - F.col("e.a.x"), 2))
    line = Window.partitionBy("shape_id").orderBy("k")
    edges = edges.withColumn("len", length).withColumns({"upto": F.sum("len").over(line), "all": F.sum("len").over(Window.partitionBy("shape_id"))})
    edges = edges.withColumn("from", F.col("upto") - F.col("len"))
    targets = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("s", F.col("all") * F.col("i") / n)
    hit = targets.where((F.col("s") >= F.col("from")) & (F.col("s") < F.col("upto")))
    f = F.when(F.col("len") > 0, (F.col("s") - F.col("from")) / F.col("len")).otherwise(0.0)
    return hit.select("shape_id", "i", (F.col("e.a.y") + f * (F.col("e.b.y") - F.col("e.a.y"))).alias("y"), (F.col("e.a.x") + f * (F.col("e.b.x") - F.col("e.a.x"))).alias("x"))
