"""Histograms of integer intensities, percentiles and automatic thresholds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FRAME


def histogram(pixels: DataFrame, by: Sequence[str] = FRAME, max_value: int | None = None) -> DataFrame:
    """Counts ``n`` by value, and each frame's ``total``. Values beyond ``max_value`` count in the total only."""
    counts = pixels.groupBy(*by, "v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return counts if max_value is None else counts.where((F.col("v") >= 0) & (F.col("v") <= max_value))


def cumulative(counts: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Add ``cdf``, the share of the total at or below each value."""
    w = Window.partitionBy(*by).orderBy("v")
    return counts.withColumn("cdf", F.sum("n").over(w) / F.col("total"))


def hist_percentile(pixels: DataFrame, p: float, by: Sequence[str] = FRAME, name: str = "value") -> DataFrame:
    """The first value whose share at or below reaches p percent; p = 0 gives 0."""
    if not 0 <= p <= 100:
        raise ValueError("percentile must lie in 0..100")
    c = cumulative(histogram(pixels, by), by)
    first = F.min(F.when(F.col("cdf") >= p / 100, F.col("v")))
    return c.groupBy(*by).agg((F.lit(0) if p == 0 else F.coalesce(first, F.max("v"))).alias(name))


def otsu(pixels: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Threshold of the largest variance between classes; the upper class starts above it. Ties go to the lower value."""
    counts = histogram(pixels, by)
    up = Window.partitionBy(*by).orderBy("v")
    whole = Window.partitionBy(*by)
    mass = F.col("n") * F.col("v")
    sums = counts.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(mass).over(up), "s": F.sum(mass).over(whole)})
    w1 = F.col("total") - F.col("w0")
    diff = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = sums.where(w1 > 0).withColumn("between", F.col("w0").cast("double") * w1 * diff * diff)
    best = scored.groupBy(*by).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))
    flat = counts.groupBy(*by).agg(F.min("v").alias("low"))
    return flat.join(best, list(by), "left").select(*by, F.coalesce("threshold", "low").alias("threshold"))


def triangle(pixels: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Value farthest from the line between the histogram's peak and its farther end. Ties go to the lower value."""
    counts = histogram(pixels, by)
    whole = Window.partitionBy(*by)
    c = counts.withColumns({"lo": F.min("v").over(whole), "hi": F.max("v").over(whole), "top": F.max(F.struct("n", -F.col("v"))).over(whole)})
    c = c.withColumns({"peak": -F.col("top.col2"), "height": F.col("top.n").cast("double")})
    right = (F.col("hi") - F.col("peak")) >= (F.col("peak") - F.col("lo"))
    end = F.when(right, F.col("hi")).otherwise(F.col("lo"))
    inside = F.when(right, F.col("v") >= F.col("peak")).otherwise(F.col("v") <= F.col("peak"))
    width = F.abs(end - F.col("peak"))
    along = F.abs(F.col("v") - F.col("peak"))
    drop = F.when(width > 0, F.col("height") * (width - along) / width - F.col("n")).otherwise(F.lit(0.0))
    return c.where(inside).groupBy(*by).agg(F.max_by("v", F.struct(drop, -F.col("v"))).alias("threshold"))


def _best_cuts(n: np.ndarray, v: np.ndarray, classes: int) -> list[int] | None:
    """Places of the last bins of all classes but the top one, for the largest sum of s^2 / w over classes; ties go to lower cuts.

    ``best[j]`` is the score of the first j bins in the classes so far; one
    more class takes the best place of its start, over prefix sums of counts
    and of mass. Time is classes x bins^2, done a block of rows at a time.
    """
    bins = len(n)
    if bins < classes:
        return None
    w, s = np.concatenate([[0.0], np.cumsum(n)]), np.concatenate([[0.0], np.cumsum(n * v)])
    best = np.full(bins + 1, -np.inf)
    best[1:] = s[1:] ** 2 / w[1:]
    came = []
    for k in range(2, classes + 1):
        new, start = np.full(bins + 1, -np.inf), np.zeros(bins + 1, dtype=np.int64)
        for lo in range(k, bins + 1, 256):
            j = np.arange(lo, min(lo + 256, bins + 1))[:, None]
            i = np.arange(k - 1, j[-1, 0])[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(i < j, np.round(best[i] + (s[j] - s[i]) ** 2 / (w[j] - w[i]), 6), -np.inf)
            at = score.argmax(axis=1)
            new[j[:, 0]], start[j[:, 0]] = score[np.arange(len(at)), at], i[0, at]
        best = new
        came.append(start)
    cuts, j = [], bins
    for start in reversed(came):
        j = int(start[j])
        cuts.append(j - 1)
    return cuts[::-1]


def multi_otsu(pixels: DataFrame, by: Sequence[str] = FRAME, classes: int = 3, bins: int = 4096) -> DataFrame:
    """Thresholds of the largest variance between ``classes`` classes of each frame; a class ends at its threshold.

    Columns ``low, high`` for three classes, else ``thresholds array<long>``.
    The classes are cut between the frame's own values, or, where these span
    more than ``bins`` whole numbers, between as many equal bins of their range.
    Frames with fewer values than classes have no row. A task holds one
    histogram.
    """
    if classes < 2:
        raise ValueError("at least two classes")
    keys = list(by)
    counts = histogram(pixels, by).select(*keys, "v", "n")
    ends = counts.groupBy(*keys).agg(F.min("v").alias("lo_"), F.max("v").alias("hi_"))
    width = F.greatest(F.lit(1), F.ceil((F.col("hi_") - F.col("lo_") + 1) / bins))
    edge = (F.col("lo_") + F.floor((F.col("v") - F.col("lo_")) / width) * width + width - 1).cast("long")
    binned = counts.join(ends, keys).groupBy(*keys, edge.alias("edge")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("mass"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("edge")
        n = pdf.n.to_numpy(dtype=float)
        found = _best_cuts(n, pdf.mass.to_numpy(dtype=float) / n, classes)
        cuts = None if found is None else [int(pdf.edge.iloc[i]) for i in found]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "thresholds": [cuts]})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in keys) + ", thresholds array<bigint>"
    out = binned.groupBy(*keys).applyInPandas(cut, schema).where("thresholds IS NOT NULL")
    kind = dict(pixels.dtypes)["v"]
    return out.select(*keys, F.col("thresholds")[0].cast(kind).alias("low"), F.col("thresholds")[1].cast(kind).alias("high")) if classes == 3 else out


def minimum_threshold(pixels: DataFrame, by: Sequence[str] = FRAME, rounds: int = 10_000) -> DataFrame:
    """Valley between the two modes of the histogram, smoothed by thirds until two are left; null if it never is so. One small histogram a task."""
    keys = list(by)

    def valley(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf.v.min())
        h = np.zeros(int(pdf.v.max()) - low + 1)
        h[pdf.v.to_numpy() - low] = pdf.n.to_numpy()
        found = None
        for _ in range(rounds):
            p = np.pad(h, 1, mode="edge")
            h = (p[:-2] + p[1:-1] + p[2:]) / 3
            d = np.sign(np.diff(np.concatenate([[0.0], h, [0.0]])))
            d = d[d != 0]
            if np.count_nonzero((d[:-1] > 0) & (d[1:] < 0)) <= 2:
                ext = np.diff(np.concatenate([[0.0], h, [0.0]]))
                tops = [i for i in range(len(h)) if ext[i] > 0 and ext[i + 1] <= 0]
                if len(tops) == 2:
                    found = tops[0] + int(np.argmin(h[tops[0] : tops[1] + 1])) + low
                break
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "threshold": pd.array([found], dtype="Int64")})

    counts = histogram(pixels, by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in keys) + ", threshold long"
    return counts.groupBy(*keys).applyInPandas(valley, schema)


#: A stack's channel; of these, the columns that a table has tell its histograms apart.
CHANNEL = ("source_file", "c")


def display_histogram(pixels: DataFrame, frames: int | None = 32, bins: int = 256) -> DataFrame:
    """Per file and channel ``bin, n, log_n`` with ``bins`` from 0 to the maximum, over evenly spread frames (None: all)."""
    from .select import even_frames

    by = [k for k in CHANNEL if k in pixels.columns]
    kept = pixels if frames is None else even_frames(pixels, frames)
    top = kept.groupBy(*by).agg(F.greatest(F.max("v"), F.lit(1)).alias("top"))
    # counted by value first: the join with the maxima is over values, not pixels
    counts = kept.groupBy(*by, "v").agg(F.count("*").alias("n_")).join(top, by)
    binned = counts.withColumn("bin", F.least(F.floor(F.col("v") * bins / F.col("top")), F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*by, "bin").agg(F.sum("n_").alias("n")).withColumn("log_n", F.log1p("n"))


def auto_contrast(bins: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """First bins whose share at or below reaches ``low`` and ``high``, per file and channel."""
    by = [k for k in CHANNEL if k in bins.columns]
    w = Window.partitionBy(*by).orderBy("bin")
    c = bins.withColumn("cdf", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy(*by)))
    pick = lambda p: F.min(F.when(F.col("cdf") >= p, F.col("bin")))
    return c.groupBy(*by).agg(pick(low).alias("low_bin"), pick(high).alias("high_bin"))
