"""Analyses and filters without SQL against numpy models over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack import registry
from lumastack.operators import label, neighbour, point
from lumastack.plans import analyses

from .test_frontier_and_chains import flood_fill, flooded, moved_by_disk
from .test_operators import pixels, plane, stack

SEGMENT = lambda df, **k: registry.ANALYSES["histogram_threshold"](df, **k)


def dark_image():
    rng = np.random.default_rng(0)
    a = rng.integers(800, 2400, (64, 64))
    a[10:22, 10:22] = rng.integers(5, 30, (12, 12))
    a[40:48, 30:44] = rng.integers(10, 40, (8, 14))
    return a


def mask_of(found, shape):
    return plane(found["labels"].withColumn("v", F.lit(1)), shape) == 1


def test_single_and_percentile_segments(spark):
    a = dark_image()
    df, size = stack(spark, a), {"height": 64, "width": 64}
    assert (mask_of(SEGMENT(df, mode="single", method="below", low=80, high=None, **size), a.shape) == (a <= 80)).all()
    found = SEGMENT(df, method="below", low=5, high=None, **size)
    values = np.sort(a.ravel())
    low = values[math.ceil(0.05 * a.size) - 1]
    assert (mask_of(found, a.shape) == (a <= low)).all()
    row = found["thresholds"].first()
    assert (row.mode, row.low, row.high, row.low_reported) == ("percentile", low, None, low)


def test_hysteresis_segment_drops_what_no_strict_pixel_touches(spark):
    a = np.full((9, 9), 200)
    a[1, 1], a[1, 2], a[2, 3], a[6, 6] = 20, 60, 60, 60
    found = SEGMENT(stack(spark, a), mode="hysteresis", method="below", strict=50, permissive=100, height=9, width=9)
    assert pixels(found["labels"]) == {(1, 1), (1, 2)}
    row = found["thresholds"].first()
    assert (row.strict, row.permissive, row.low) == (50, 100, None)
    df = stack(spark, dark_image())
    two = SEGMENT(df, mode="hysteresis", method="below", strict=50, permissive=100, least=20, height=64, width=64)
    assert two["regions"].count() == 2 and two["provenance"].count() == 1


def test_relative_segment_uses_the_reference(spark):
    a = np.arange(100).reshape(10, 10)
    df = stack(spark, a)
    found = SEGMENT(df, mode="relative", method="above", high=1.26, reference=df.where("y < 5"), height=10, width=10)
    assert (mask_of(found, a.shape) == (a >= round(24.5 * 1.26))).all()
    row = found["thresholds"].first()
    assert (row.reference_median, row.high, row.high_reported) == (24.5, 31, 30)


def test_guards_and_depth(spark):
    a = np.full((10, 10), 1000)
    a[3, 3] = 800
    df, size = stack(spark, a), {"height": 10, "width": 10}
    assert SEGMENT(df, method="below", low=5, high=None, floor=500, **size)["labels"].count() == 0
    assert SEGMENT(df, method="above", high=50, ceiling=2000, **size)["labels"].count() == 0
    assert SEGMENT(df, depth=12, **size)["bit_depth"].first().status == "ok"
    with pytest.raises(ValueError):
        SEGMENT(stack(spark, [[5000]]), depth=12, depth_strict=True)


@pytest.mark.parametrize("wrong", [
    {"mode": "single", "method": "below"}, {"mode": "single", "method": "above", "high": None}, {"mode": "single", "method": "between", "low": 9, "high": 3}, {"mode": "nothing"},
    {"mode": "hysteresis", "method": "between", "strict": 1, "permissive": 2}, {"mode": "hysteresis", "method": "below", "strict": 9, "permissive": 2}, {"mode": "hysteresis", "method": "above", "strict": 1, "permissive": 2}, {"mode": "hysteresis", "method": "above", "strict": 1},
])
def test_segments_refuse_wrong_bounds(spark, wrong):
    with pytest.raises(ValueError):
        SEGMENT(stack(spark, [[1]]), **wrong)


# --- spots


def blobs(shape=(48, 48)):
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    a = 300 + rng.integers(0, 30, shape) + sum(3000 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * 2.5**2)) for y, x in ((12, 12), (34, 30), (12, 22)))
    return a.astype(int)


def test_spot_regions_stay_within_the_boundary(spark):
    a = blobs()
    df, size = stack(spark, a), {"height": 48, "width": 48}
    bound = a > 500
    bounded = registry.ANALYSES["spots"](df, 6.0, grow="region", boundary=df.where("v > 500"), **size)
    peaks = plane(bounded["peaks"], a.shape, "label_id").astype(int)
    want = flooded(a, np.where(bound, peaks, 0), bound) > 0
    assert (mask_of(bounded, a.shape) == want).all() and want.sum() > 50
    gated = registry.ANALYSES["spots"](df, 6.0, grow="region", gate=90, **size)
    gate = np.sort(a.ravel())[math.ceil(0.9 * a.size) - 1]
    assert (mask_of(gated, a.shape) <= (a >= gate)).all()
    dark = registry.ANALYSES["spots"](stack(spark, 4095 - a), 6.0, bright=False, grow="region", gate=10, boundary=df.where("v > 500"), **size)
    assert (mask_of(dark, a.shape) == want).all()


def test_spots_widen(spark):
    a = blobs()
    df, size = stack(spark, a), {"height": 48, "width": 48}
    plain = mask_of(registry.ANALYSES["spots"](df, 6.0, **size), a.shape)
    wide = mask_of(registry.ANALYSES["spots"](df, 6.0, widen="dilation", widen_um=2.0, **size), a.shape)
    assert (wide == moved_by_disk(plain, 2, True)).all()
    grown = mask_of(registry.ANALYSES["spots"](df, 6.0, widen="watershed", widen_um=1.0, boundary=df.where("v > 400"), **size), a.shape)
    assert (plain <= grown).all() and (grown <= (plain | (a > 400))).all() and grown.sum() > plain.sum()
    with pytest.raises(ValueError):
        registry.ANALYSES["spots"](df, 6.0, grow="nothing")
    with pytest.raises(ValueError):
        registry.ANALYSES["spots"](df, 0.0)


# --- dark regions


def symmetric(a, k):
    return np.pad(a, k, mode="symmetric")


def blurred(a, sigma):
    k = neighbour.gaussian_kernel(sigma)
    r = len(k) // 2
    p = np.pad(a, r, mode="symmetric")
    p = np.apply_along_axis(lambda v: np.correlate(v, k, "valid"), 1, p)
    return np.apply_along_axis(lambda v: np.correlate(v, k, "valid"), 0, p)


def tissue(a, close_r, open_r, sigma, k=4):
    h, w = a.shape[0] // k, a.shape[1] // k
    small = np.floor(a[: h * k, : w * k].reshape(h, k, w, k).mean(axis=(1, 3)))
    log = np.log1p(np.maximum(blurred(small, sigma), 0))
    bins = np.floor((log - log.min()) / (log.max() - log.min()) * 255).astype(int)
    best = max(range(int(bins.min()), int(bins.max())), key=lambda t: ((bins <= t).sum() * (bins > t).sum() * (bins[bins <= t].mean() - bins[bins > t].mean()) ** 2 if (bins <= t).any() else -1, -t))
    on = moved_by_disk(moved_by_disk(bins > best, close_r, True), close_r, False)
    holes = flood_fill(~on, False)
    edge = set(holes[0]) | set(holes[-1]) | set(holes[:, 0]) | set(holes[:, -1])
    on |= (holes > 0) & ~np.isin(holes, list(edge))
    on = moved_by_disk(moved_by_disk(on, open_r, False), open_r, True)
    out = np.zeros(a.shape, bool)
    out[: h * k, : w * k] = np.kron(on, np.ones((k, k), bool))
    return out


def rank(values):
    out = np.empty(len(values))
    out[np.argsort(values, kind="stable")] = np.linspace(0, 1, len(values)) if len(values) > 1 else 0.0
    return out


def test_dark_regions_find_their_own_tissue(spark):
    rng = np.random.default_rng(9)
    yy, xx = np.mgrid[:48, :64]
    a = np.where((yy - 24) ** 2 / 20**2 + (xx - 32) ** 2 / 28**2 <= 1, 1500, 100) + rng.integers(0, 60, (48, 64))
    a[20:28, 24:34] = 700 + rng.integers(0, 3, (8, 10))
    df = stack(spark, a)
    found = registry.ANALYSES["dark_regions"](df, 48, 64, win=5, r=2, least_score=0.3, least=6)
    want = tissue(a, 2, 1, 1.0)
    assert pixels(found["tissue"]) == set(zip(*np.nonzero(want))) and 0.2 < want.mean() < 0.9
    # the score: three ranks within the tissue
    win = symmetric(a.astype(float), 2)
    box = np.lib.stride_tricks.sliding_window_view(win, (5, 5))
    mean, var = box.mean(axis=(2, 3)), box.var(axis=(2, 3))
    eight = plane(point.auto_stretch(df), a.shape).astype(int)
    entropy = np.zeros(a.shape)
    for y, x in np.ndindex(a.shape):
        near = [eight[y + dy, x + dx] for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4 and 0 <= y + dy < 48 and 0 <= x + dx < 64]
        p = np.unique(near, return_counts=True)[1] / len(near)
        entropy[y, x] = -(p * np.log2(p)).sum()
    score = np.zeros(a.shape)
    score[want] = (1 - rank(np.round(mean[want], 6))) * (1 - rank(np.round(var[want], 6))) * (1 - rank(np.round(entropy[want], 9)))
    got = plane(analyses.homogeneity(df, found["tissue"], 5, 2, 48, 64), a.shape)
    assert np.allclose(got, score, atol=2e-3)
    parts = flood_fill(got > 0.3, True)
    sizes = {i: (parts == i).sum() for i in range(1, parts.max() + 1)}
    rows = found["regions"].collect()
    assert sorted(r.area_px for r in rows) == sorted(n for n in sizes.values() if n >= 6) and rows
    assert all(0.3 < r.homogeneity_score <= 1 and r.region_class in ("tear", "weak_stain") for r in rows)


# --- filters


@pytest.mark.parametrize("action", ["interpolate", "zero", "median"])
def test_blob_actions(spark, action):
    a = blobs((40, 40))
    df = stack(spark, a)
    got = plane(analyses.blob_subtract(df, [2.0, 3.0], 0.5, 40, 40, action=action), a.shape)
    zero = plane(analyses.blob_subtract(df, [2.0, 3.0], 0.5, 40, 40, action="zero"), a.shape)
    hit = (zero == 0) & (a > 0)
    assert hit.sum() > 20 and (got[~hit] == a[~hit]).all()
    if action == "interpolate":
        wide = np.zeros_like(hit)
        for y, x in zip(*np.nonzero(hit)):
            for dy in range(-7, 8):
                half = round(math.sqrt(49 - dy * dy))
                if 0 <= y + dy < 40:
                    wide[y + dy, max(x - half, 0) : x + half + 1] = True
        assert (got[hit] == int(a[wide & ~hit].mean())).all()
    with pytest.raises(ValueError):
        analyses.blob_subtract(df, [2.0], 0.5, 40, 40, action="nothing")


def test_non_local_means_in_eight_bits(spark):
    a = np.random.default_rng(2).integers(0, 65536, (12, 14))
    got = plane(neighbour.nlmeans(stack(spark, a), 3, 5, 20.0, 12, 14, tile=5, top=65535), a.shape)
    e = np.pad(np.floor(a / 65535 * 255), 3, mode="reflect")
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            far = np.zeros(a.shape)
            for py in (-1, 0, 1):
                for px in (-1, 0, 1):
                    b = e[3 + py : 15 + py, 3 + px : 17 + px]
                    far += (e[3 + dy + py : 15 + dy + py, 3 + dx + px : 17 + dx + px] - b) ** 2 / 9
            w = np.exp(-far / 400)
            total, weight = total + w * e[3 + dy : 15 + dy, 3 + dx : 17 + dx], weight + w
    assert (got == np.floor(np.rint(total / weight) / 255 * 65535)).all()


def test_growing_a_point(spark):
    df = stack(spark, [[1]]).withColumns({"y": F.lit(32), "x": F.lit(32)})
    assert label.dilate(df, 0, 64, 64).count() == 1
    n = label.dilate(df, 5, 64, 64).count()
    assert 0.8 * math.pi * 25 <= n <= 1.3 * math.pi * 25
