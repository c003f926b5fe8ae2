"""Analyses composed of operators: threshold segmenter, spots, dark regions, shapes, full measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import written
from ..model import FRAME
from ..operators import hist, label, measure, neighbour, point, shapes
from ..registry import analysis

AT = [*FRAME, "y", "x"]


MODES = ("percentile", "single", "relative", "hysteresis")


def resolved_thresholds(
    pixels: DataFrame, mode: str, low: float | None = None, high: float | None = None, strict: float | None = None, permissive: float | None = None,
    floor: int | None = None, ceiling: int | None = None, reference: DataFrame | None = None,
) -> DataFrame:
    """What a mode compares with in each frame: ``mode, low, high`` (whole numbers; null: none), ``strict, permissive``, ``reference_median``, and what the report shows, ``low_reported, high_reported``.

    ``percentile``: histogram percentiles ``low`` and ``high``, guarded by
    ``floor`` and ``ceiling``, which the report leaves out. ``single``: as
    given. ``relative``: the median, within ``reference`` pixels if given,
    times ``low`` and ``high``, rounded half to even; the report truncates.
    ``hysteresis``: ``strict`` and ``permissive`` as given. A frame without
    reference pixels has no row.
    """
    whole = lambda c, name: c.cast("long").alias(name)
    null = F.lit(None).cast("long")
    lit = lambda v: null if v is None else F.lit(v)
    planes = pixels.select(*FRAME).distinct()
    if mode == "percentile":
        c = hist.cumulative(hist.histogram(pixels))
        at = lambda p: null if p is None else F.lit(0) if p == 0 else F.coalesce(F.min(F.when(F.col("cdf") >= p / 100, F.col("v"))), F.max("v"))
        found = c.groupBy(*FRAME).agg(whole(at(low), "low_reported"), whole(at(high), "high_reported"))
        low_, high_ = F.col("low_reported"), F.col("high_reported")
        out = found.withColumns({"low": low_ if floor is None else F.least(low_, F.lit(floor)), "high": high_ if ceiling is None else F.greatest(high_, F.lit(ceiling))})
        out = out.withColumns({"low": F.when(low_.isNotNull(), F.col("low")), "high": F.when(high_.isNotNull(), F.col("high")), "reference_median": F.lit(None).cast("double")})
    elif mode == "relative":
        inside = pixels if reference is None else pixels.join(reference.select(*AT).hint("merge"), AT, "left_semi")
        found = inside.groupBy(*FRAME).agg(F.percentile("v", F.lit(0.5)).cast("double").alias("reference_median"))
        part = lambda f: null if f is None else F.col("reference_median") * f
        shown = lambda f: null if not f else F.col("reference_median") * f
        out = found.select(*FRAME, "reference_median", whole(F.bround(part(low), 0), "low"), whole(F.bround(part(high), 0), "high"), whole(shown(low), "low_reported"), whole(shown(high), "high_reported"))
    elif mode in ("single", "hysteresis"):
        given = (low, high) if mode == "single" else (None, None)
        out = planes.select("*", whole(lit(given[0]), "low"), whole(lit(given[1]), "high"), whole(lit(given[0]), "low_reported"), whole(lit(given[1]), "high_reported"), F.lit(None).cast("double").alias("reference_median"))
    else:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    marks = (strict, permissive) if mode == "hysteresis" else (None, None)
    return out.select(*FRAME, F.lit(mode).alias("mode"), "low", "high", whole(lit(marks[0]), "strict"), whole(lit(marks[1]), "permissive"), "reference_median", "low_reported", "high_reported")


def _check_bounds(mode: str, method: str, low, high, strict, permissive) -> None:
    if mode == "hysteresis":
        if method not in ("below", "above"):
            raise ValueError(f"hysteresis only goes below or above, not {method!r}")
        if strict is None or permissive is None:
            raise ValueError("hysteresis needs strict and permissive")
        if (strict > permissive) if method == "below" else (strict < permissive):
            raise ValueError(f"strict ({strict}) must be the tighter bound of the two, permissive is {permissive}")
        return
    if method in ("below", "between", "outside") and low is None:
        raise ValueError(f"{method} needs low")
    if method in ("above", "between", "outside") and high is None:
        raise ValueError(f"{method} needs high")
    if mode == "single" and method in ("between", "outside") and high < low:
        raise ValueError(f"high ({high}) is below low ({low})")


@analysis("histogram_threshold")
def segment_by_histogram(
    pixels: DataFrame, method: str = "above", low: float | None = None, high: float | None = 95, strict: float | None = None, height: int = 50, width: int = 64,
    open_r: int = 0, close_r: int = 0, holes: int = 0, least: int = 0, most: int = 0, quiet: tuple[int, float] | None = None, pixel_um: float = 1.0,
    mode: str = "percentile", permissive: float | None = None, floor: int | None = None, ceiling: int | None = None, reference: DataFrame | None = None, depth: int | None = None, depth_strict: bool = False,
) -> dict[str, DataFrame]:
    """Threshold every frame, clean up, label and measure.

    ``method`` is below, above, between or outside. ``mode`` says what ``low``
    and ``high`` are: histogram ``percentile``s (guarded by ``floor`` and
    ``ceiling``), intensities (``single``), or fractions of the median within
    ``reference`` pixels (``relative``). ``hysteresis`` takes the pixels beyond
    ``permissive`` that are 4-connected to one beyond ``strict``, both
    intensities. A ``percentile`` mode with ``strict`` is hysteresis between
    percentiles. ``quiet`` keeps pixels whose box of that size has less than
    that deviation. With ``depth`` the frames are held against that bit depth;
    ``depth_strict`` raises if one exceeds it. Gives ``labels, regions,
    summary, provenance, thresholds``, and ``bit_depth`` if asked.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {MODES}")
    _check_bounds(mode, method, low, high, strict, permissive)
    status = {} if depth is None else {"bit_depth": point.bit_depth_status(pixels, depth, depth_strict)}
    found = resolved_thresholds(pixels, mode, low, high, strict, permissive, floor, ceiling, reference)
    if mode == "hysteresis":
        beyond = lambda v: point.threshold(pixels, method, v, v).select(*AT)
        mask = label.hysteresis(beyond(permissive), beyond(strict))
    else:
        bounds = found.select(*FRAME, F.col("low").alias("low_value"), F.col("high").alias("high_value"))
        mask = pixels.join(bounds, FRAME).where(point.inside(F.col("v"), method, F.col("low_value"), F.col("high_value")))
        if mode == "percentile" and strict is not None:
            sharp = point.percentile_threshold(pixels, method, strict if method == "below" else None, strict if method == "above" else None)
            mask = label.hysteresis(mask, sharp)
    if quiet:
        mask = neighbour.quiet_pixels(mask.select(*AT).join(pixels.hint("merge"), AT), *quiet)
    mask = label.spatial_cleanup(mask.select(*AT), pixels, height, width, open_r, close_r, holes, least, most)
    labels = written(label.components(mask), "labels")
    regions = measure.regions(labels.join(pixels.hint("merge"), AT))
    rows = regions.withColumn("frame", F.col("t"))
    from ..sources.stacks import probe_fingerprint

    size = pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return {"labels": labels, "regions": regions, "summary": measure.summary(rows, pixel_um), "provenance": probe_fingerprint(pixels).join(size, FRAME), "thresholds": found, **status}


@analysis("spots")
def find_spots(
    pixels: DataFrame, diameter_um: float, pixel_um: float | None = None, bright: bool = True, contrast: float = 0.3, gate: float | None = 90,
    symmetry: str = "all", grow: str = "disk", height: int = 50, width: int = 64, kernel: str = "dog", boundary: DataFrame | None = None, widen: str | None = None, widen_um: float = 0.0,
) -> dict[str, DataFrame]:
    """Spots of one size: scale-space response, local maxima, gates, disks or watershed regions, labels, regions with scores, background.

    ``grow`` makes a spot of each maximum: a ``disk`` of the diameter, or the
    ``region`` that a watershed from it covers, bounded by ``boundary`` pixels
    (by those beyond the intensity ``gate`` without one, by the plane without
    either). After the symmetry gate spots may grow once more by ``widen_um``:
    ``dilation`` by that radius, or ``watershed`` within ``boundary``.
    """
    if grow not in ("disk", "region") or widen not in (None, "dilation", "watershed") or kernel not in ("dog", "log"):
        raise ValueError(f"unknown grow {grow!r}, widen {widen!r} or kernel {kernel!r}")
    if diameter_um <= 0:
        raise ValueError("the diameter must be positive")
    um = pixel_um if pixel_um and pixel_um > 0 else 1.0
    size = diameter_um / um
    inner = size / 2.3548200450309493
    raw = neighbour.dog_response(pixels, inner, 1.6 * inner) if kernel == "dog" else neighbour.log_response(pixels, inner)
    response = written(neighbour.normalise_response(raw), "response")
    signed = response if bright else response.withColumn("v", -F.col("v"))
    peaks = neighbour.local_maxima(signed, max(1, int(size / 2)), contrast)
    if gate is not None:
        peaks = neighbour.intensity_gate(peaks, pixels, gate, bright)
    peaks = written(peaks.withColumn("label_id", F.row_number().over(Window.partitionBy(*FRAME).orderBy("y", "x"))), "peaks")
    if grow == "disk":
        spots = label.rasterise_disks(peaks.withColumn("r", F.lit(size / 2)), height, width)
    else:
        within = boundary if boundary is not None else neighbour.intensity_gate(pixels, pixels, gate, bright) if gate is not None else pixels
        # a seed outside the boundary has nothing to cover
        spots = label.watershed(pixels, peaks, within, bright)
    spots = written(spots.select(*AT, "label_id"), "spots")
    kept = label.symmetry_gate(written(label.components(spots.select(*AT)), "spot-parts"), symmetry)
    mask = kept.select(*AT)
    if widen is not None and widen_um > 0:
        if widen == "dilation":
            mask = label.dilate(mask, max(1, round(widen_um / um)), height, width)
        else:
            seeds = spots.join(mask.hint("merge"), AT, "left_semi")
            # seeds keep their pixels also where they lie outside the boundary
            mask = label.watershed(pixels, seeds, (boundary if boundary is not None else pixels).select(*AT), bright).select(*AT).union(mask).distinct()
        labels = label.components(mask)
    else:
        labels = label.relabel(kept)
    labels = written(labels, "spot-labels")
    regions = measure.regions(labels.join(pixels.hint("merge"), AT))
    score = labels.join(peaks.select(*AT, F.col("v").alias("score")).hint("merge"), AT).groupBy(*FRAME, "label_id").agg(F.max("score").alias("score"))
    back = measure.background_stats(pixels, labels)
    return {"labels": labels, "regions": regions.join(score, [*FRAME, "label_id"], "left").join(back, FRAME, "left"), "peaks": peaks, "background": back}


def tissue_mask(pixels: DataFrame, height: int, width: int, k: int = 4, sigma: float = 3.0, close_r: int = 5, open_r: int = 2) -> DataFrame:
    """Tissue of each frame: pooled by k, blurred, log, Otsu on 256 bins, closed, holes filled, opened, and spread back to pixels."""
    from ..operators.project import mean_pool

    small = mean_pool(pixels, k, height, width)
    h, w = height // k, width // k
    blurred = neighbour.gaussian(small, sigma, "reflect").withColumn("v", F.log1p(F.greatest("v", F.lit(0.0))))
    ends = blurred.groupBy(*FRAME).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    binned = blurred.join(ends, FRAME).withColumn("v", F.when(F.col("b") > F.col("a"), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * 255)).otherwise(0).cast("int"))
    binned = written(binned.select(*AT, "v"), "tissue-bins")
    on = binned.join(hist.otsu(binned), FRAME).where("v > threshold").select(*AT)
    on = label.fill_holes(label.closing(on, close_r, h, w), binned)
    on = label.opening(on, open_r, h, w)
    d = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(k) for b in range(k)])).alias("d")
    return on.select(*AT, d).select(*FRAME, (F.col("y") * k + F.col("d.dy")).alias("y"), (F.col("x") * k + F.col("d.dx")).alias("x"))


def homogeneity(pixels: DataFrame, mask: DataFrame, win: int, r: int, height: int, width: int) -> DataFrame:
    """(1 - intensity)(1 - variance)(1 - entropy), of the box and disk around each pixel, each by rank within the mask: high where dark and even."""
    ranked = lambda d, name: neighbour.rank_normalise(d.select(*AT, "v")).withColumnRenamed("v", name)
    box = neighbour.local_stats(pixels, win)
    inside, var = (box.select(*AT, F.round(k, 6).alias("v")).join(mask.select(*AT).hint("merge"), AT, "left_semi") for k in ("mean", "variance"))
    eight = point.auto_stretch(pixels)
    ent = neighbour.local_entropy(eight, r, height, width).withColumn("v", F.round("v", 9)).join(mask.select(*AT).hint("merge"), AT, "left_semi")
    all_ = ranked(inside, "i_").join(ranked(var, "w_").hint("merge"), AT).join(ranked(ent, "e_").hint("merge"), AT)
    return all_.select(*AT, ((1 - F.col("i_")) * (1 - F.col("w_")) * (1 - F.col("e_"))).alias("v"))


def region_classes(labels: DataFrame, counterstain: DataFrame, mask: DataFrame) -> DataFrame:
    """Class of each region by its counterstain mean against the frame's 15th percentile in tissue: tear below it, weak_stain at or above, unknown without."""
    low = counterstain.join(mask.select(*AT).hint("merge"), AT, "left_semi").groupBy(*FRAME).agg(F.percentile("v", F.lit(0.15)).alias("low"))
    mean = labels.join(counterstain.hint("merge"), AT, "left").groupBy(*FRAME, "label_id").agg(F.avg("v").alias("mean_"))
    kind = F.when(F.col("mean_").isNull() | F.col("low").isNull(), "unknown").when(F.col("mean_") < F.col("low"), "tear").otherwise("weak_stain")
    return mean.join(low, FRAME, "left").select(*FRAME, "label_id", kind.alias("region_class"))


@analysis("dark_regions")
def find_dark_regions(
    pixels: DataFrame, height: int = 50, width: int = 64, win: int = 5, r: int = 3, least_score: float = 0.3, least: int = 4, tissue: DataFrame | None = None,
    most: int = 0, counterstain: DataFrame | None = None, close_r: int = 2, open_r: int = 1, sigma: float = 1.0,
) -> dict[str, DataFrame]:
    """Dark, even regions within tissue: homogeneity score above ``least_score``, components, area filter, shape, class by ``counterstain`` (the image itself without one).

    Tissue is found by ``tissue_mask`` unless given. Regions also have their
    mean ``homogeneity_score``.
    """
    mask = written(tissue if tissue is not None else tissue_mask(pixels, height, width, close_r=close_r, open_r=open_r, sigma=sigma), "tissue")
    score = written(homogeneity(pixels, mask, win, r, height, width).where(F.col("v") > least_score), "dark-score")
    labels = written(label.relabel(label.by_size(label.components(score.select(*AT)), least, most)), "dark-labels")
    by = [*FRAME, "label_id"]
    regions = measure.regions(labels.join(pixels.hint("merge"), AT)).join(measure.moments(labels), by).join(measure.solidity(labels), by)
    even = labels.join(score.hint("merge"), AT).groupBy(*by).agg(F.round(F.avg("v"), 4).alias("homogeneity_score"))
    kinds = region_classes(labels, pixels if counterstain is None else counterstain, mask)
    return {"labels": labels, "regions": regions.join(even, by).join(kinds, by), "tissue": mask}


@analysis("shapes")
def label_shapes(pixels: DataFrame, drawn: DataFrame, specs: DataFrame | None = None, height: int = 50, width: int = 64) -> dict[str, DataFrame]:
    """Labels of strips, then of drawn shapes, whose ids follow; with voxel counts and a summary."""
    stripes = shapes.strips(specs, height, width) if specs is not None else None
    n = stripes.count() if stripes is not None else 0
    labels = shapes.shape_labels(pixels, shapes.shape_order(drawn, n))
    if stripes is not None:
        inside = pixels.join(F.broadcast(stripes), (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
        both = inside.select(*AT, "label_id").unionByName(labels.select(*AT, "label_id"))
        labels = both.groupBy(*AT).agg(F.max("label_id").alias("label_id"))
    labels = written(labels, "shape-labels")
    rows = labels.groupBy(*FRAME, "label_id").agg(F.count("*").alias("area_px")).withColumn("frame", F.col("t"))
    return {"labels": labels, "voxels": shapes.voxel_counts(labels), "summary": measure.summary(rows)}


def full_measurements(labels: DataFrame, pixels: DataFrame, channels: list[str], pixel_um: float = 1.0, z_step_um: float = 1.0, n_z: int = 1, intensities: DataFrame | None = None) -> DataFrame:
    """The whole measurement table of labelled objects: one row per object and frame.

    ``intensities`` chooses what is measured under the objects (raw pixels, or
    the recipe's result); by default ``pixels``. Areas, volumes and centroids
    come in px and um, deltas from frame to frame.
    """
    by = [*FRAME, "label_id"]
    base = measure.regions(labels.join(pixels.hint("merge"), AT)).drop("mean_intensity", "min_intensity", "max_intensity")
    shaped = base.join(measure.perimeter(labels), by).join(measure.moments(labels), by).join(measure.solidity(labels), by)
    stats = measure.channel_intensities(labels, intensities if intensities is not None else pixels, channels).withColumnRenamed("segmentation_channel", "c")
    rows = point.to_units(shaped.join(stats, by, "left"), pixel_um)
    rows = rows.withColumns({
        "volume_um3": measure.volume(F.col("area_px"), F.lit(None).cast("long"), pixel_um, z_step_um, n_z),
        "circularity": point.circularity(F.col("area_px"), F.col("perimeter")),
        "segmentation_channel": F.col("c"), "frame": F.col("t"),
    })
    return measure.deltas(rows, ("area_px", "area_um2", "volume_um3")).drop("c", "t", "z")


def blob_subtract(pixels: DataFrame, sigmas: list[float], least: float, height: int, width: int, action: str = "median", expand: float = 1.0) -> DataFrame:
    """Find blobs over scales (maxima of the scale-normalised Laplacian in space and scale) and replace their disks.

    ``zero``: by 0. ``median``: by that of 15 x 15. ``interpolate``: by the
    frame's mean over the ring that an ellipse of 15 x 15 adds to its disks,
    truncated; over all other pixels if there is no ring, 0 if there are none.
    """
    if action not in ("zero", "median", "interpolate"):
        raise ValueError(f"unknown action {action!r}")
    levels = None
    for i, s in enumerate(sigmas):
        r = neighbour.log_response(pixels, s).withColumns({"level": F.lit(i), "sigma": F.lit(float(s))})
        levels = r if levels is None else levels.unionByName(r)
    scaled = levels.withColumn("v", F.col("v") / F.greatest(F.max("v").over(Window.partitionBy(*FRAME)), F.lit(1e-8)))
    best = written(scaled.groupBy(*AT).agg(F.max(F.struct("v", F.col("sigma"))).alias("b")).select(*AT, F.col("b.v").alias("v"), F.col("b.sigma").alias("sigma")), "blobs")
    peaks = neighbour.local_maxima(best, 2, least)
    peaks = peaks.withColumns({"label_id": F.row_number().over(Window.partitionBy(*FRAME).orderBy("y", "x")), "r": F.col("sigma") * (2**0.5) * expand})
    disks = label.rasterise_disks(peaks, height, width).select(*AT, F.lit(1).alias("hit_"))
    if action == "zero":
        return pixels.join(disks.hint("merge"), AT, "left").withColumn("v", F.when(F.col("hit_") == 1, 0).otherwise(F.col("v"))).drop("hit_")
    if action == "interpolate":
        disks = written(disks, "blob-disks")
        wide = label.morphology(disks, "d", 7, height, width, ellipse=True).select(*AT, F.lit(1).alias("wide_"))
        marked = pixels.join(disks.hint("merge"), AT, "left").join(wide.hint("merge"), AT, "left")
        free, ring = F.col("hit_").isNull(), F.col("hit_").isNull() & F.col("wide_").isNotNull()
        fill = marked.groupBy(*FRAME).agg(F.coalesce(F.avg(F.when(ring, F.col("v"))), F.avg(F.when(free, F.col("v"))), F.lit(0.0)).alias("fill_"))
        filled = marked.join(fill, FRAME)
        return filled.withColumn("v", F.when(free, F.col("v")).otherwise(F.floor(F.greatest(F.round("fill_", 6), F.lit(0.0))).cast("int"))).select(*pixels.columns)
    smooth = neighbour.median(pixels, 15, height, width).withColumnRenamed("v", "s_")
    out = pixels.join(disks.hint("merge"), AT, "left").join(smooth.hint("merge"), AT)
    return out.withColumn("v", F.when(F.col("hit_") == 1, F.floor("s_").cast("int")).otherwise(F.col("v"))).drop("hit_", "s_")
