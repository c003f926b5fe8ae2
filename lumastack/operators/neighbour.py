"""Neighbourhood operators: separable filters over row strips, 2-D filters over halo tiles, temporal windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FRAME, SERIES
from ..registry import step

# --- layouts


def to_strips(pixels: DataFrame, along: str = "x", value: str = "v") -> DataFrame:
    """One row per line of a plane: ``vals array<double>`` along ``x`` (by y) or ``y`` (by x)."""
    other = "y" if along == "x" else "x"
    listed = F.sort_array(F.collect_list(F.struct(F.col(along), F.col(value).cast("double").alias("v"))))
    return pixels.groupBy(*FRAME, other).agg(F.transform(listed, lambda p: p["v"]).alias("vals"))


def to_pixels(strips: DataFrame, along: str = "x") -> DataFrame:
    other = "y" if along == "x" else "x"
    return strips.select(*FRAME, other, F.posexplode("vals").alias(along, "v")).select(*FRAME, "y", "x", "v")


def correlate(vals: Column, kernel: Sequence[float], border: str = "mirror") -> Column:
    """Weighted sum around each entry of an array. Borders: ``mirror`` (edge not repeated) or ``reflect`` (edge repeated)."""
    weights = np.asarray(kernel, dtype=float)
    r = len(weights) // 2
    mode = {"mirror": "reflect", "reflect": "symmetric"}[border]

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            padded = np.pad(np.asarray(row, dtype=float), r, mode=mode if len(row) > 1 or mode == "symmetric" else "edge")
            out.append(np.correlate(padded, weights, mode="valid"))
        return pd.Series(out)

    return run(vals)


def separable(pixels: DataFrame, kernel_x: Sequence[float], kernel_y: Sequence[float], border: str = "mirror", value: str = "v") -> DataFrame:
    """Filter along x, then along y: two shuffles of whole lines. ``v`` becomes a double."""
    rows = to_strips(pixels, "x", value).withColumn("vals", correlate(F.col("vals"), kernel_x, border))
    columns = to_strips(to_pixels(rows, "x"), "y").withColumn("vals", correlate(F.col("vals"), kernel_y, border))
    return to_pixels(columns, "y")


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    """Weights of radius trunc(4 sigma + 0.5), summing to 1; order 2: those of the second derivative."""
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    return g if order == 0 else g * (x**2 / sigma**4 - 1 / sigma**2)


def tile_filter(pixels: DataFrame, fn: Callable[[np.ndarray], np.ndarray], halo: int, height: int, width: int, tile: int = 256, border: str = "edge") -> DataFrame:
    """Apply ``fn`` (array with a halo -> array of the core) to tiles of each plane.

    A pixel goes to every tile whose halo has it; a task holds one tile. Beyond
    the plane the tile is padded by numpy's ``border`` mode. Missing pixels are
    0 to their neighbours and get no row of their own, whatever the tiles.
    """
    reach = math.ceil(halo / tile)
    offsets = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
    own = lambda k: F.floor(F.col(k) / tile).cast("int")
    dealt = pixels.withColumn("ty", F.explode(F.transform(offsets, lambda d: own("y") + d))).withColumn("tx", F.explode(F.transform(offsets, lambda d: own("x") + d)))
    rows, cols = math.ceil(height / tile), math.ceil(width / tile)
    for t, k, n in (("ty", "y", rows), ("tx", "x", cols)):
        dealt = dealt.where((F.col(t) >= 0) & (F.col(t) < n) & (F.col(k) >= F.col(t) * tile - halo) & (F.col(k) < (F.col(t) + 1) * tile + halo))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        y0, y1, x0, x1 = ty * tile, min((ty + 1) * tile, height), tx * tile, min((tx + 1) * tile, width)
        a0, a1, b0, b1 = max(y0 - halo, 0), min(y1 + halo, height), max(x0 - halo, 0), min(x1 + halo, width)
        at = pdf.y.to_numpy() - a0, pdf.x.to_numpy() - b0
        plane, held = np.zeros((a1 - a0, b1 - b0)), np.zeros((a1 - a0, b1 - b0), dtype=bool)
        plane[at], held[at] = pdf.v.to_numpy(), True
        pad = ((a0 - (y0 - halo), (y1 + halo) - a1), (b0 - (x0 - halo), (x1 + halo) - b1))
        yy, xx = np.nonzero(held[y0 - a0 : y1 - a0, x0 - b0 : x1 - b0])
        v = fn(np.pad(plane, pad, mode=border))[yy, xx] if len(yy) else np.zeros(0)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in FRAME}, "y": yy + y0, "x": xx + x0, "v": v})

    schema = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in [*FRAME, "y", "x"]) + ", v double"
    return dealt.groupBy(*FRAME, "ty", "tx").applyInPandas(run, schema)


def _views(a: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (k, k))


# --- separable filters


@step("gaussian")
def gaussian(pixels: DataFrame, sigma: float, border: str = "mirror") -> DataFrame:
    k = gaussian_kernel(sigma)
    return separable(pixels, k, k, border)


def _with(pixels: DataFrame, **others: DataFrame) -> DataFrame:
    out = pixels
    for name, o in others.items():
        out = out.join(o.withColumnRenamed("v", name).hint("merge"), [*FRAME, "y", "x"])
    return out


def _with_frame(pixels: DataFrame, **stats: Column) -> DataFrame:
    """Pixels with statistics of their frame, summed up before any shuffle and joined back: no task holds a plane."""
    return pixels.join(pixels.groupBy(*FRAME).agg(*[v.alias(k) for k, v in stats.items()]), FRAME)


def dog_response(pixels: DataFrame, inner: float, outer: float, border: str = "reflect") -> DataFrame:
    """Signed difference of Gaussians."""
    return _with(gaussian(pixels, inner, border), o_=gaussian(pixels, outer, border)).withColumn("v", F.col("v") - F.col("o_")).drop("o_")


@step("dog")
def dog_step(pixels: DataFrame, inner: float, outer: float, top: int = 65535) -> DataFrame:
    """Difference of Gaussians, negative parts 0, stretched so that the frame's maximum is ``top``."""
    d = dog_response(pixels, inner, outer, "mirror").withColumn("v", F.greatest("v", F.lit(0.0)))
    both, peak = _with_frame(d, peak_=F.max("v")), F.col("peak_")
    return both.withColumn("v", F.when(peak > 0, F.floor(F.round(F.col("v") / peak * top, 4))).otherwise(0).cast("int")).select(*d.columns)


def log_response(pixels: DataFrame, sigma: float) -> DataFrame:
    """Scale-normalised negative Laplacian of Gaussian: two separable passes, added."""
    g, d = gaussian_kernel(sigma), gaussian_kernel(sigma, 2)
    both = _with(separable(pixels, d, g, "reflect"), o_=separable(pixels, g, d, "reflect"))
    return both.withColumn("v", -(sigma**2) * (F.col("v") + F.col("o_"))).drop("o_")


def normalise_response(response: DataFrame) -> DataFrame:
    """Divide by the frame's largest magnitude (at least 1e-8)."""
    both = _with_frame(response, peak_=F.max(F.abs("v")))
    return both.withColumn("v", F.col("v") / F.greatest("peak_", F.lit(1e-8))).select(*response.columns)


@step("unsharp")
def unsharp(pixels: DataFrame, sigma: float, amount: float, top: int = 65535) -> DataFrame:
    sharp = F.col("v") + amount * (F.col("v") - F.col("b_"))
    return _with(pixels, b_=gaussian(pixels, sigma)).withColumn("v", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.round(sharp, 6)))).cast("int")).drop("b_")


@step("local_contrast")
def local_contrast(pixels: DataFrame, sigma: float, top: int = 65535) -> DataFrame:
    """(v + 1) / max(blur, 1), from 0.5 .. 2 to 0 .. top."""
    ratio = (F.col("v") + 1) / F.greatest(F.col("b_"), F.lit(1.0))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ratio - 0.5) / 1.5))
    return _with(pixels, b_=gaussian(pixels, sigma)).withColumn("v", F.floor(F.round(unit * top, 6)).cast("int")).drop("b_")


@step("flatness")
def flatness(pixels: DataFrame, sigma: float, mode: str = "divide", over_time: bool = False, top: int = 65535) -> DataFrame:
    """Divide by (or subtract) the blurred background, of each frame or averaged over time; kept at the background's mean level."""
    back = gaussian(pixels, sigma).withColumn("v", F.greatest("v", F.lit(1.0)))
    if over_time:
        back = back.withColumn("v", F.avg("v").over(Window.partitionBy(*SERIES, "y", "x")))
    back = _with_frame(back, mean_=F.avg("v")).withColumnRenamed("v", "b_").select(*FRAME, "y", "x", "b_", "mean_")
    both = pixels.join(back.hint("merge"), [*FRAME, "y", "x"])
    flat = F.col("v") / F.col("b_") * F.col("mean_") if mode == "divide" else F.col("v") - F.col("b_") + F.col("mean_")
    return both.withColumn("v", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.round(flat, 6)))).cast("int")).drop("b_", "mean_")


@step("rolling_ball")
def rolling_ball(pixels: DataFrame, radius: int) -> DataFrame:
    """Subtract the opening by a square of side 2 r + 1: minima along x, y, then maxima along y, x, so that the middle two share a shuffle."""
    along = lambda k, o: Window.partitionBy(*FRAME, o).orderBy(k).rangeBetween(-radius, radius)
    b = pixels.withColumn("b_", F.min("v").over(along("x", "y")))
    b = b.withColumn("b_", F.min("b_").over(along("y", "x"))).withColumn("b_", F.max("b_").over(along("y", "x")))
    b = b.withColumn("b_", F.max("b_").over(along("x", "y")))
    return b.withColumn("v", F.greatest(F.col("v") - F.col("b_"), F.lit(0))).drop("b_")


@step("background_gaussian")
def background_gaussian(pixels: DataFrame, sigma: float) -> DataFrame:
    return _with(pixels, b_=gaussian(pixels, sigma)).withColumn("v", F.greatest(F.floor(F.round(F.col("v") - F.col("b_"), 6)), F.lit(0)).cast("int")).drop("b_")


def local_stats(pixels: DataFrame, win: int) -> DataFrame:
    """Mean and variance of the win x win box around each pixel, edges reflected: two box filters on v and v squared."""
    box = np.full(win, 1 / win)
    mean = separable(pixels, box, box, "reflect").withColumnRenamed("v", "mean")
    square = separable(pixels.withColumn("v", F.col("v").cast("double") * F.col("v")), box, box, "reflect")
    both = mean.join(square.hint("merge"), [*FRAME, "y", "x"])
    return both.withColumn("variance", F.greatest(F.lit(0.0), F.col("v") - F.col("mean") * F.col("mean"))).drop("v")


def quiet_pixels(pixels: DataFrame, win: int, most: float) -> DataFrame:
    """Pixels whose box has a deviation below ``most``."""
    calm = local_stats(pixels, win).where(F.sqrt(F.round("variance", 6)) < most).select(*FRAME, "y", "x")
    return pixels.join(calm.hint("merge"), [*FRAME, "y", "x"], "left_semi")


# --- tile filters


@step("median")
def median(pixels: DataFrame, k: int, height: int, width: int, tile: int = 256) -> DataFrame:
    if k % 2 == 0:
        raise ValueError("the median's side must be odd")
    return tile_filter(pixels, lambda a: np.median(_views(a, k), axis=(2, 3)), k // 2, height, width, tile)


@step("bilateral")
def bilateral(pixels: DataFrame, d: int, sigma_colour: float, sigma_space: float, height: int, width: int, tile: int = 256) -> DataFrame:
    r = d // 2

    def run(a: np.ndarray) -> np.ndarray:
        centre = a[r : a.shape[0] - r, r : a.shape[1] - r]
        total, weight = np.zeros_like(centre), np.zeros_like(centre)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                if dy * dy + dx * dx <= r * r:
                    near = a[r + dy : r + dy + centre.shape[0], r + dx : r + dx + centre.shape[1]]
                    w = np.exp(-((near - centre) ** 2) / (2 * sigma_colour**2) - (dy * dy + dx * dx) / (2 * sigma_space**2))
                    total, weight = total + w * near, weight + w
        return total / weight

    return tile_filter(pixels, run, r, height, width, tile, "reflect")


@step("nlmeans")
def nlmeans(pixels: DataFrame, patch: int, search: int, h: float, height: int, width: int, tile: int = 256, top: int | None = None) -> DataFrame:
    """Non-local means: each pixel the mean over a search window, weighted by how alike the patches are.

    With ``top`` (65535 for 16 bits) on 8-bit values: v / top x 255 truncated,
    the means rounded, and back, truncated.
    """
    if top is not None:
        kind = pixels.schema["v"].dataType
        eight = pixels.withColumn("v", F.floor(F.col("v") / top * 255).cast("int"))
        smooth = nlmeans(eight, patch, search, h, height, width, tile)
        return smooth.withColumn("v", F.floor(F.round(F.rint(F.round("v", 9)) / 255 * top, 6)).cast(kind))
    p, s = patch // 2, search // 2

    def run(a: np.ndarray) -> np.ndarray:
        halo = p + s
        n, m = a.shape[0] - 2 * halo, a.shape[1] - 2 * halo
        total, weight = np.zeros((n, m)), np.zeros((n, m))
        base = a[s : s + n + 2 * p, s : s + m + 2 * p]
        for dy in range(-s, s + 1):
            for dx in range(-s, s + 1):
                near = a[s + dy : s + dy + n + 2 * p, s + dx : s + dx + m + 2 * p]
                far = _views((near - base) ** 2, 2 * p + 1).mean(axis=(2, 3))
                w = np.exp(-far / (h * h))
                total, weight = total + w * near[p : p + n, p : p + m], weight + w
        return total / weight

    return tile_filter(pixels, run, p + s, height, width, tile, "reflect")


def disk_offsets(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def _extreme(a: np.ndarray, offsets: list[tuple[int, int]], r: int, f) -> np.ndarray:
    n, m = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    out = None
    for dy, dx in offsets:
        near = a[r + dy : r + dy + n, r + dx : r + dx + m]
        out = near.copy() if out is None else f(out, near, out=out)
    return out


@step("top_hat")
def top_hat(pixels: DataFrame, r: int, height: int, width: int, white: bool = True, tile: int = 256) -> DataFrame:
    """What the opening (white) or closing (black) by a disk changes; the halo is twice the radius."""
    offsets = disk_offsets(r)
    first, second = (np.minimum, np.maximum) if white else (np.maximum, np.minimum)

    def run(a: np.ndarray) -> np.ndarray:
        core = a[2 * r : a.shape[0] - 2 * r, 2 * r : a.shape[1] - 2 * r]
        moved = _extreme(_extreme(a, offsets, r, first), offsets, r, second)
        return core - moved if white else moved - core

    return tile_filter(pixels, run, 2 * r, height, width, tile, "symmetric")


@step("morph_gradient")
def morph_gradient(pixels: DataFrame, r: int, height: int, width: int, blend: float = 1.0, top: int = 65535, tile: int = 256) -> DataFrame:
    """Dilation minus erosion by a disk, stretched to ``top``, blended with the image."""
    offsets = disk_offsets(r)
    g = tile_filter(pixels, lambda a: _extreme(a, offsets, r, np.maximum) - _extreme(a, offsets, r, np.minimum), r, height, width, tile)
    both, peak = _with_frame(_with(pixels, g_=g), peak_=F.max("g_")), F.col("peak_")
    both = both.withColumn("n_", F.when(peak > 0, F.col("g_") / peak * top).otherwise(0.0))
    return both.withColumn("v", F.floor(F.round(F.col("v") * (1 - blend) + F.col("n_") * blend, 6)).cast("int")).select(*pixels.columns)


def local_entropy(pixels: DataFrame, r: int, height: int, width: int, tile: int = 128) -> DataFrame:
    """Entropy in bits of the 8-bit values in the disk around each pixel; the disk is clipped at the plane's border.

    A tile keeps one histogram for each of its rows and slides them all along x
    at once: a step takes off the disk's left edge and adds its right edge.
    """
    half = [math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)]
    # c log2 c by count
    weigh = np.array([c * math.log2(c) if c else 0.0 for c in range(len(disk_offsets(r)) + 1)])

    def run(a: np.ndarray) -> np.ndarray:
        # -1 stands for what lies beyond the plane and is counted apart, in the last bin
        level = a.astype(np.int64)
        n, m = a.shape[0] - 2 * r, a.shape[1] - 2 * r
        rows = np.arange(n)
        held = np.zeros((n, 257), dtype=np.int32)
        for dy, w in zip(range(-r, r + 1), half):
            for dx in range(-w, w + 1):
                held[rows, level[r + dy : r + dy + n, r + dx]] += 1
        out = np.empty((n, m))
        for x in range(m):
            if x:
                for dy, w in zip(range(-r, r + 1), half):
                    line = level[r + dy : r + dy + n]
                    held[rows, line[:, r + x - 1 - w]] -= 1
                    held[rows, line[:, r + x + w]] += 1
            total = held[:, :256].sum(axis=1)
            out[:, x] = np.log2(total) - weigh[held[:, :256]].sum(axis=1) / total
        return np.maximum(out, 0.0)

    shifted = pixels.withColumn("v", F.col("v") + 1)
    return tile_filter(shifted, lambda a: run(a - 1), r, height, width, tile, "constant")


@step("clahe")
def clahe(pixels: DataFrame, clip: float, grid: int, height: int, width: int, bins: int = 256, top: int = 4095) -> DataFrame:
    """Adaptive equalisation: each grid cell's histogram is clipped, the excess spread evenly, and a pixel takes the bilinear mix of its four nearest cells' curves."""
    ch, cw = math.ceil(height / grid), math.ceil(width / grid)
    px = pixels.withColumn("b", F.least(F.floor(F.col("v") * bins / (top + 1)), F.lit(bins - 1)).cast("int"))
    cell = [F.floor(F.col("y") / ch).cast("int").alias("gy"), F.floor(F.col("x") / cw).cast("int").alias("gx")]
    counts = px.groupBy(*FRAME, *cell, "b").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*FRAME, "gy", "gx")
    limit = F.greatest(F.lit(1.0), clip * F.col("area") / bins)
    counts = counts.withColumn("area", F.sum("n").over(whole)).withColumn("limit", limit)
    spine = counts.groupBy(*FRAME, "gy", "gx").agg(F.first("area").alias("area"), F.first("limit").alias("limit"), F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0.0))).alias("excess"))
    spine = spine.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(counts.select(*FRAME, "gy", "gx", "b", "n"), [*FRAME, "gy", "gx", "b"], "left")
    mass = F.least(F.coalesce("n", F.lit(0)).cast("double"), F.col("limit")) + F.col("excess") / bins
    curve = full.withColumn("cdf", F.sum(mass).over(whole.orderBy("b")) / F.col("area")).select(*FRAME, "gy", "gx", "b", "cdf")
    fy, fx = (F.col("y") + 0.5) / ch - 0.5, (F.col("x") + 0.5) / cw - 0.5
    rows, cols = math.ceil(height / ch), math.ceil(width / cw)
    clamp = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    mixes = F.array(*[
        F.struct(clamp(F.floor(fy) + a, rows).alias("gy"), clamp(F.floor(fx) + b, cols).alias("gx"), ((fy - F.floor(fy) if a else 1 - (fy - F.floor(fy))) * (fx - F.floor(fx) if b else 1 - (fx - F.floor(fx)))).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ])
    mixed = px.withColumn("k", F.explode(mixes)).select(*FRAME, "y", "x", "b", "k.gy", "k.gx", "k.w")
    out = mixed.join(curve, [*FRAME, "gy", "gx", "b"]).groupBy(*FRAME, "y", "x").agg(F.sum(F.col("w") * F.col("cdf")).alias("u"))
    return out.select(*FRAME, "y", "x", F.floor(F.round(F.least(F.lit(1.0), F.col("u")) * top, 6)).cast("int").alias("v"))


@step("wavelet_denoise")
def haar_denoise(pixels: DataFrame, levels: int = 2, mode: str = "soft", sigma: float | None = None) -> DataFrame:
    """Shrink Haar coefficients. The noise is the median magnitude of the finest diagonal / 0.6745 unless given; the threshold is noise x sqrt(2 ln n).

    Sides must be multiples of 2^levels. Each level is one grouped pass over
    2 x 2 cells, the inverse one explode.
    """
    at = pixels.select(*FRAME, "y", "x", F.col("v").cast("double").alias("v"))
    details, keys = [], [*FRAME, "y", "x"]
    for _ in range(levels):
        quad = lambda dy, dx: F.max(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col("v")))
        g = at.groupBy(*FRAME, F.expr("y div 2").alias("Y"), F.expr("x div 2").alias("X")).agg(quad(0, 0).alias("q0"), quad(0, 1).alias("q1"), quad(1, 0).alias("q2"), quad(1, 1).alias("q3"))
        a, b, c, d = (F.col(f"q{i}") for i in range(4))
        g = g.select(*FRAME, F.col("Y").cast("int").alias("y"), F.col("X").cast("int").alias("x"), ((a + b + c + d) / 2).alias("v"), ((a - b + c - d) / 2).alias("h"), ((a + b - c - d) / 2).alias("w"), ((a - b - c + d) / 2).alias("g"))
        details.append(g.drop("v"))
        at = g.select(*keys, "v")
    n = pixels.groupBy(*FRAME).agg(F.count("*").alias("n"))
    noise = details[0].groupBy(*FRAME).agg((F.percentile(F.abs("g"), F.lit(0.5)) / 0.6745).alias("s")) if sigma is None else n.withColumn("s", F.lit(float(sigma))).drop("n")
    cut = noise.join(n, FRAME).select(*FRAME, (F.col("s") * F.sqrt(2 * F.log(F.col("n")))).alias("cut"))
    for level in reversed(details):
        shrink = lambda k: F.signum(k) * F.greatest(F.abs(k) - F.col("cut"), F.lit(0.0)) if mode == "soft" else F.when(F.abs(k) >= F.col("cut"), F.col(k)).otherwise(0.0)
        both = at.join(level, keys).join(cut, FRAME).select(*keys, "v", shrink("h").alias("h"), shrink("w").alias("w"), shrink("g").alias("g"))
        v, h, w, g = (F.col(k) for k in ("v", "h", "w", "g"))
        cells = [(0, 0, v + h + w + g), (0, 1, v - h + w - g), (1, 0, v + h - w - g), (1, 1, v - h - w + g)]
        both = both.withColumn("q", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), (e / 2).alias("v")) for dy, dx, e in cells])))
        at = both.select(*FRAME, (F.col("y") * 2 + F.col("q.dy")).alias("y"), (F.col("x") * 2 + F.col("q.dx")).alias("x"), F.col("q.v").alias("v"))
    return at


# --- ranks and maxima


def rank_normalise(pixels: DataFrame) -> DataFrame:
    """0 .. 1 by rank of the value in each frame; ties by row and column.

    The rows ahead of a pixel are those of smaller values, those of its value
    in rows above (both from counts), and those to its left in its own row.
    """
    from .ranks import ranked_values

    ahead = ranked_values(pixels, FRAME, "v", ["y"]).select(*FRAME, "v", "y", "before", "total")
    line = Window.partitionBy(*FRAME, "v", "y").orderBy("x")
    placed = pixels.withColumn("i_", F.row_number().over(line) - 1).join(ahead.hint("merge"), [*FRAME, "v", "y"])
    rank = F.when(F.col("total") > 1, (F.col("before") + F.col("i_")) / (F.col("total") - 1)).otherwise(0.0)
    return placed.withColumn("v", rank).select(*pixels.columns)


def local_maxima(response: DataFrame, distance: int, least: float) -> DataFrame:
    """Pixels that hold the maximum of their (2 d + 1) box and reach ``least``; of equal neighbours the first in raster order."""
    along = lambda k, o: Window.partitionBy(*FRAME, o).orderBy(k).rangeBetween(-distance, distance)
    best = F.struct(F.col("v"), -F.col("y"), -F.col("x"))
    out = response.withColumn("p_", best).withColumn("m_", F.max("p_").over(along("x", "y")))
    out = out.withColumn("m_", F.max("m_").over(along("y", "x")))
    return out.where((F.col("p_") == F.col("m_")) & (F.col("v") >= least)).drop("p_", "m_")


def intensity_gate(spots: DataFrame, pixels: DataFrame, p: float, bright: bool = True) -> DataFrame:
    """Spots whose pixel is at or beyond the frame's histogram percentile."""
    from .hist import hist_percentile

    gate = hist_percentile(pixels, p, name="gate_")
    at = spots.join(pixels.select(*FRAME, "y", "x", F.col("v").alias("i_")).hint("merge"), [*FRAME, "y", "x"]).join(gate, FRAME)
    return at.where(F.col("i_") >= F.col("gate_") if bright else F.col("i_") <= F.col("gate_")).drop("i_", "gate_")


# --- temporal windows


@step("frame_mean_normalise")
def frame_mean_normalise(pixels: DataFrame, top: int = 65535) -> DataFrame:
    """v / frame mean x grand mean, clipped and truncated; a frame whose mean is not positive stays."""
    from .project import frame_means

    both = pixels.join(frame_means(pixels), FRAME)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.round(F.col("v") / F.col("mean") * F.col("grand_mean"), 6)))
    return both.withColumn("v", F.when(F.col("mean") > 0, F.floor(scaled)).otherwise(F.col("v")).cast("int")).select(*pixels.columns)


@step("bleach_correction")
def bleach_correction(pixels: DataFrame, method: str = "ratio", top: int = 65535) -> DataFrame:
    if method != "ratio":
        raise ValueError(f"bleach method {method!r} is not supported; use 'ratio'")
    return frame_mean_normalise(pixels, top)


def temporal_fold(pixels: DataFrame, window: int, threshold: float, tile: tuple[int, int] | None = None, top: int = 65535) -> DataFrame:
    """Rescale by rolling mean over own mean where they differ by more than ``threshold``.

    Means of whole frames, or of tiles. An even window reaches one further back;
    times beyond the ends count as the end frame.
    """
    cell = [] if tile is None else [F.floor(F.col("y") / tile[0]).cast("int").alias("ty"), F.floor(F.col("x") / tile[1]).cast("int").alias("tx")]
    cells = [] if tile is None else ["ty", "tx"]
    px = pixels.select("*", *cell)
    means = px.groupBy(*FRAME, *cells).agg(F.avg("v").alias("mean"))
    series = [*SERIES, *cells]
    ends = means.groupBy(*series).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    offsets = F.sequence(F.lit(-(window // 2)), F.lit(window - 1 - window // 2))
    wanted = means.join(ends, series).withColumn("o", F.explode(offsets)).select(*series, "t", "mean", F.least("t1", F.greatest("t0", F.col("t") + F.col("o"))).alias("at"))
    rolled = wanted.join(means.select(*series, F.col("t").alias("at"), F.col("mean").alias("near")), [*series, "at"]).groupBy(*series, "t", "mean").agg(F.avg("near").alias("rolling"))
    ratio = F.when(F.col("mean") > 0, F.col("rolling") / F.col("mean")).otherwise(1.0)
    both = px.join(rolled.withColumn("ratio", ratio).select(*series, "t", "ratio"), [*series, "t"])
    scaled = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.col("v") * F.col("ratio"))), 6)).cast("int")
    return both.withColumn("v", F.when(F.abs(F.col("ratio") - 1) > threshold, scaled).otherwise(F.col("v"))).select(*pixels.columns)


def temporal_fold_pixels(pixels: DataFrame, window: int, threshold: float, sigma: float, top: int = 65535) -> DataFrame:
    """The fold of each pixel by its blurred neighbourhood over time; the series' ends repeat."""
    blurred = gaussian(pixels, sigma)
    line = Window.partitionBy(*SERIES, "y", "x").orderBy("t")
    back, ahead = window // 2, window - 1 - window // 2
    values = [F.coalesce(F.lag("v", -o).over(line) if o < 0 else F.lead("v", o).over(line), (F.first("v") if o < 0 else F.last("v")).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for o in range(-back, ahead + 1)]
    rolling = sum(values[1:], values[0]) / len(values)
    ratio = blurred.select(*FRAME, "y", "x", F.when(F.col("v") > 0, rolling / F.col("v")).otherwise(1.0).alias("ratio_"))
    both = pixels.join(ratio.hint("merge"), [*FRAME, "y", "x"])
    scaled = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.col("v") * F.col("ratio_"))), 6)).cast("int")
    return both.withColumn("v", F.when(F.abs(F.col("ratio_") - 1) > threshold, scaled).otherwise(F.col("v"))).select(*pixels.columns)
