"""Point operators: thresholds, normalisation, look-up tables, colour, units."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FRAME
from ..registry import step

#: Bit depths and their largest values.
BIT_DEPTHS = {8: 255, 10: 1023, 12: 4095, 14: 16383, 16: 65535}
#: Named display colours. Fixed values.
COLOURS = {
    "gray": (255, 255, 255), "green": (0, 255, 0), "red": (255, 0, 0), "blue": (0, 100, 255), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "yellow": (255, 255, 0), "orange": (255, 165, 0), "white": (255, 255, 255),
}
#: Label colours, repeated. Fixed values.
PALETTE = [(240, 60, 60), (60, 210, 60), (60, 100, 240), (240, 200, 50), (200, 60, 200), (50, 200, 200), (240, 130, 50), (150, 60, 240), (60, 240, 150), (240, 60, 150), (110, 200, 60), (60, 150, 240)]


def inside(v: Column, method: str, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """below: v <= low; above: v >= high; between: closed; outside: open."""
    if method not in ("below", "above", "between", "outside"):
        raise ValueError(f"unknown threshold method {method!r}")
    if isinstance(low, (int, float)) and isinstance(high, (int, float)) and method in ("between", "outside") and high < low:
        raise ValueError("the high threshold is below the low one")
    return {
        "below": lambda: v <= low,
        "above": lambda: v >= high,
        "between": lambda: (v >= low) & (v <= high),
        "outside": lambda: (v < low) | (v > high),
    }[method]()


def threshold(pixels: DataFrame, method: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The pixels of the mask."""
    return pixels.where(inside(F.col("v"), method, low, high))


def percentile_threshold(pixels: DataFrame, method: str, low: float | None = None, high: float | None = None, floor: int | None = None, ceiling: int | None = None) -> DataFrame:
    """Threshold at histogram percentiles of each frame. Adds ``low_value, high_value``; ``floor`` and ``ceiling`` guard them."""
    from .hist import cumulative, histogram

    c = cumulative(histogram(pixels))
    pick = lambda p: F.lit(0) if p == 0 else F.coalesce(F.min(F.when(F.col("cdf") >= p / 100, F.col("v"))), F.max("v"))
    null = F.lit(None).cast("int")
    lo, hi = pick(low) if low is not None else null, pick(high) if high is not None else null
    if floor is not None and low is not None:
        lo = F.least(lo, F.lit(floor))
    if ceiling is not None and high is not None:
        hi = F.greatest(hi, F.lit(ceiling))
    values = c.groupBy(*FRAME).agg(lo.alias("low_value"), hi.alias("high_value"))
    return pixels.join(values, FRAME).where(inside(F.col("v"), method, F.col("low_value"), F.col("high_value")))


def relative_threshold(pixels: DataFrame, method: str, fraction: float, reference: DataFrame | None = None) -> DataFrame:
    """Threshold at a fraction of each frame's median, within ``reference`` pixels if given; rounded half to even. Adds ``value``."""
    inside_ = pixels if reference is None else pixels.join(reference.select(*FRAME, "y", "x"), [*FRAME, "y", "x"], "left_semi")
    value = inside_.groupBy(*FRAME).agg(F.bround(F.percentile("v", F.lit(0.5)) * fraction, 0).cast("int").alias("value"))
    return pixels.join(value, FRAME).where(inside(F.col("v"), method, F.col("value"), F.col("value")))


def bit_depth_status(pixels: DataFrame, depth: int, strict: bool = False) -> DataFrame:
    """Per frame ``max_value, status``: overflow beyond the depth, low_range below 5 % of it, else ok. Strict: overflow raises."""
    if depth not in BIT_DEPTHS:
        raise ValueError(f"unsupported bit depth {depth}")
    if dict(pixels.dtypes)["v"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("intensities must be integers")
    limit = BIT_DEPTHS[depth]
    said = F.when(F.col("max_value") > limit, "overflow").when(F.col("max_value") < 0.05 * limit, "low_range").otherwise("ok")
    out = pixels.groupBy(*FRAME).agg(F.max("v").alias("max_value")).withColumn("status", said)
    if strict and out.where("status = 'overflow'").limit(1).count():
        raise ValueError(f"intensities exceed {depth} bits")
    return out


def infer_bit_depth(pixels: DataFrame) -> DataFrame:
    """Per frame the smallest depth that holds its maximum."""
    top = F.col("max_value")
    depth = F.lit(None).cast("int")
    for bits in sorted(BIT_DEPTHS, reverse=True):
        depth = F.when(top <= BIT_DEPTHS[bits], bits).otherwise(depth)
    return pixels.groupBy(*FRAME).agg(F.max("v").alias("max_value")).withColumn("bit_depth", depth)


def _with_bounds(pixels: DataFrame, low: float, high: float, by: Sequence[str] = FRAME) -> DataFrame:
    lo, hi = F.percentile("v", F.lit(low / 100)).alias("lo_"), F.percentile("v", F.lit(high / 100)).alias("hi_")
    return pixels.join(pixels.groupBy(*by).agg(lo, hi), list(by))


@step("normalise_percentile")
def percentile_normalise(pixels: DataFrame, low: float = 1, high: float = 99, top: int = 65535) -> DataFrame:
    """Clip each frame to its percentiles and stretch to 0..top, truncated."""
    scaled = (F.col("v") - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + 1e-10)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    return _with_bounds(pixels, low, high).withColumn("v", F.floor(clipped * top).cast("int")).select(*pixels.columns)


def unit_normalise(pixels: DataFrame, low: float = 1, high: float = 99.8) -> DataFrame:
    """Stretch each frame's percentiles to 0..1, clipped; a flat frame divides by 1."""
    span = F.col("hi_") - F.col("lo_")
    scaled = (F.col("v") - F.col("lo_")) / F.when(span < 1e-10, 1.0).otherwise(span)
    return _with_bounds(pixels, low, high).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).select(*pixels.columns)


@step("gamma")
def gamma(pixels: DataFrame, g: float, top: int = 65535) -> DataFrame:
    return pixels.withColumn("v", F.floor(F.pow(F.col("v") / top, F.lit(g)) * top).cast("int"))


def lut(v: Column, lo: Column | float, hi: Column | float, g: float = 1.0) -> Column:
    """Map lo..hi to 0..255; hi not above lo counts as lo + 1; gamma is an exponent 1 / g unless g is about 1."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    top = F.when(hi <= lo, lo + 1).otherwise(hi)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (top - lo)))
    return F.floor((F.pow(unit, F.lit(1 / max(g, 0.05))) if abs(g - 1) > 1e-3 else unit) * 255).cast("int")


def apply_lut(pixels: DataFrame, lo: float, hi: float, g: float = 1.0) -> DataFrame:
    return pixels.withColumn("v", lut(F.col("v"), lo, hi, g))


def auto_stretch(pixels: DataFrame, low: float = 0.5, high: float = 99.5) -> DataFrame:
    return _with_bounds(pixels, low, high).withColumn("v", lut(F.col("v"), F.col("lo_"), F.col("hi_"))).select(*pixels.columns)


def export_rescale(pixels: DataFrame, top: int = 255, low: float = 0.5, high: float = 99.5, exact: bool = True) -> DataFrame:
    """Rescale each channel of each file to 0..top between its percentiles; approximate ones for very large channels."""
    by = [k for k in ("source_file", "c") if k in pixels.columns]
    pick = (lambda p: F.percentile("v", F.lit(p / 100))) if exact else (lambda p: F.percentile_approx("v", p / 100, 100_000).cast("double"))
    bounds = pixels.groupBy(*by).agg(pick(low).alias("lo_"), pick(high).alias("hi_"))
    hi = F.when(F.col("hi_") <= F.col("lo_"), F.col("lo_") + 1).otherwise(F.col("hi_"))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo_")) / (hi - F.col("lo_"))))
    return pixels.join(bounds, by).withColumn("v", F.floor(unit * top).cast("int")).select(*pixels.columns)


def composite(gray: DataFrame, colours: dict[str, str | tuple[int, int, int]], brightness: dict[str, float] | None = None) -> DataFrame:
    """Sum of gray x colour / 255 over the channels, clipped and truncated: ``r, g, b`` per pixel. ``gray`` is 0..255; brightness b scales by 1 + b / 100."""
    spark = gray.sparkSession
    rows = [(c, *(float(x) for x in (COLOURS[k] if isinstance(k, str) else k)), 1 + (brightness or {}).get(c, 0) / 100) for c, k in colours.items()]
    table = F.broadcast(spark.createDataFrame(rows, "c string, cr double, cg double, cb double, gain double"))
    lit = gray.join(table, "c").withColumn("v", F.least(F.lit(255.0), F.col("v") * F.col("gain")))
    keys = [k for k in FRAME if k != "c"]
    part = lambda x: F.floor(F.least(F.lit(255.0), F.sum(F.col("v") * F.col(x) / 255))).cast("int")
    return lit.groupBy(*keys, "y", "x").agg(part("cr").alias("r"), part("cg").alias("g"), part("cb").alias("b"))


def adjust(rgb: DataFrame, contrast: float = 0, brightness: float = 0, hue: float = 0, saturation: float = 0, fade: float = 0) -> DataFrame:
    """Contrast about 128, brightness, hue in degrees, saturation and fade, in this order; percent otherwise."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    r, g, b = (clip((F.col(k) - 128) * (1 + contrast / 100) + 128) for k in "rgb")
    r, g, b = (clip(k * (1 + brightness / 100)) for k in (r, g, b))
    out = rgb.withColumns({"r_": r, "g_": g, "b_": b})
    if hue or saturation:
        r, g, b = (F.col(k) / 255 for k in ("r_", "g_", "b_"))
        top, low = F.greatest(r, g, b), F.least(r, g, b)
        span = top - low
        raw = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
        out = out.withColumns({"h_": F.pmod(raw * 60 + hue, F.lit(360.0)), "s_": F.least(F.lit(1.0), F.when(top == 0, 0.0).otherwise(span / top) * (1 + saturation / 100)), "v_": top})
        sector, h = F.floor(F.col("h_") / 60), F.col("h_") / 60
        f = h - sector
        v, s = F.col("v_"), F.col("s_")
        p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
        pick = lambda *x: F.element_at(F.array(*x), (sector % 6).cast("int") + 1) * 255
        out = out.withColumns({"r_": pick(v, q, p, p, t, v), "g_": pick(t, v, v, q, p, p), "b_": pick(p, p, t, v, v, q)})
    faded = lambda k: F.floor(clip(F.round(F.col(k) * (1 - fade / 100) + 255 * fade / 100, 6))).cast("int")
    return out.withColumns({"r": faded("r_"), "g": faded("g_"), "b": faded("b_")}).select(*rgb.columns)


def overlay(gray: DataFrame, labels: DataFrame, alpha: float = 0.4, colour: tuple[int, int, int] | None = None) -> DataFrame:
    """Blend label colours over gray: palette by label, or one colour. Adds ``r, g, b``."""
    keys = [*FRAME, "y", "x"]
    marked = gray.join(labels.select(*keys, "label_id"), keys, "left")
    at = (F.pmod(F.col("label_id") - 1, F.lit(len(PALETTE))) + 1).cast("int")

    def part(i: int) -> Column:
        tint = F.lit(float(colour[i])) if colour else F.element_at(F.array(*[F.lit(float(p[i])) for p in PALETTE]), at)
        blend = F.col("v") * (1 - alpha) + tint * alpha
        return F.floor(F.least(F.lit(255.0), F.round(F.when(F.col("label_id").isNull(), F.col("v")).otherwise(blend), 6))).cast("int")

    return marked.select(*keys, part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def circularity(area: Column, perimeter: Column, clip: bool = False) -> Column:
    """4 pi A / P^2; 0 without a perimeter."""
    raw = F.when(perimeter == 0, 0.0).otherwise(4 * math.pi * area / (perimeter * perimeter))
    return F.least(F.lit(1.0), raw) if clip else raw


def to_units(rows: DataFrame, pixel_um: float, width: int | None = None, height: int | None = None, stage: tuple[float, float] | None = None) -> DataFrame:
    """Add areas and centroids in micrometres (rounded half to even), and stage coordinates if a stage position is given."""
    out = rows.withColumns({
        "area_um2": F.bround(F.col("area_px") * pixel_um**2, 4),
        "centroid_y_um": F.bround(F.col("centroid_y_px") * pixel_um, 4),
        "centroid_x_um": F.bround(F.col("centroid_x_px") * pixel_um, 4),
    })
    if stage is not None:
        out = out.withColumns({
            "centroid_x_stage_um": F.bround(stage[0] + (F.col("centroid_x_px") - width / 2) * pixel_um, 4),
            "centroid_y_stage_um": F.bround(stage[1] + (F.col("centroid_y_px") - height / 2) * pixel_um, 4),
        })
    return out


def duration(seconds: Column, hundredths: bool = False) -> Column:
    """m:ss or h:mm:ss, with hundredths if asked."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))
    return F.concat(text, F.format_string(".%02d", F.floor((seconds - whole) * 100 + 1e-6).cast("long"))) if hundredths else text


def axis_metadata(times: DataFrame) -> DataFrame:
    """Per frame ``elapsed, step, total`` of ``source_file, t, ts`` (seconds)."""
    line = Window.partitionBy("source_file").orderBy("t")
    whole = Window.partitionBy("source_file")
    return times.withColumns({"elapsed": F.col("ts") - F.min("ts").over(whole), "step": F.col("ts") - F.lag("ts").over(line), "total": F.max("ts").over(whole) - F.min("ts").over(whole)})


def spot_scale(diameter_um: Column, pixel_um: Column | None) -> tuple[Column, Column, Column]:
    """(diameter in px, inner sigma, outer sigma): full width at half maximum to sigma, outer 1.6 times; without a pixel size 1."""
    size = F.coalesce(F.when(pixel_um > 0, pixel_um), F.lit(1.0)) if pixel_um is not None else F.lit(1.0)
    px = diameter_um / size
    inner = px / (2 * math.sqrt(2 * math.log(2)))
    return px, inner, inner * 1.6


def area_limits_px(min_um2: Column, max_um2: Column, pixel_um: float) -> tuple[Column, Column]:
    """Area limits in pixels: at least 1, truncated; a maximum of 0 is none."""
    px = lambda a: F.floor(F.round(a / (pixel_um * pixel_um), 9)).cast("long")
    return F.greatest(F.lit(1).cast("long"), px(min_um2)), F.when(max_um2 <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), px(max_um2)))
