"""Literal cases and invariants of the frame-stack operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.model import FRAME
from lumastack.operators import hist, joins, label, layout, measure, neighbour, point, project, select, track
from lumastack.plans import analyses, jobs
from lumastack.sources import stacks
from lumastack.streaming import events

SCHEMA = "source_file string, m int, t int, z int, c string, y int, x int, v int"


def stack(spark, array, t=0):
    rows = [("s", 0, t, 0, "c", y, x, int(v)) for (y, x), v in np.ndenumerate(np.asarray(array))]
    return spark.createDataFrame(rows, SCHEMA)


def plane(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def pixels(df):
    return {(r.y, r.x) for r in df.collect()}


@pytest.mark.parametrize("method, low, high, want", [("below", 50, None, {0, 1}), ("above", None, 100, {2, 3}), ("between", 50, 100, {1, 2}), ("outside", 50, 100, {0, 3})])
def test_threshold_methods(spark, method, low, high, want):
    assert {x for _, x in pixels(point.threshold(stack(spark, [[10, 50, 100, 200]]), method, low, high))} == want


def test_threshold_refuses_inverted_bounds(spark):
    with pytest.raises(ValueError):
        point.threshold(stack(spark, [[1]]), "between", 9, 3)
    with pytest.raises(ValueError):
        point.inside(F.col("v"), "no such method")


def test_histogram_percentile_of_ramp(spark):
    ramp = stack(spark, np.arange(100).reshape(10, 10))
    assert hist.hist_percentile(ramp, 50).first().value == 49
    assert hist.hist_percentile(ramp, 0).first().value == 0
    with pytest.raises(ValueError):
        hist.hist_percentile(ramp, 101)


def test_otsu_splits_two_levels(spark):
    t = hist.otsu(stack(spark, [[10] * 20 + [200] * 12])).first().threshold
    assert 10 <= t < 200
    assert hist.otsu(stack(spark, [[7, 7]])).first().threshold == 7


def test_sanity_floor(spark):
    a = np.full((10, 10), 1000)
    a[3, 3] = 800
    assert point.percentile_threshold(stack(spark, a), "below", low=5, floor=500).count() == 0


def test_bit_depth(spark):
    df = stack(spark, [[0, 5000]])
    assert point.bit_depth_status(df, 12).first().status == "overflow"
    with pytest.raises(ValueError):
        point.bit_depth_status(df, 12, strict=True).count()
    with pytest.raises(TypeError):
        point.bit_depth_status(df.withColumn("v", F.col("v").cast("double")), 12)
    assert point.infer_bit_depth(df).first().bit_depth == 14


@pytest.mark.parametrize("tile", [2, 3, 100])
@pytest.mark.parametrize("eight", [True, False])
def test_components_equal_flood_fill(spark, tile, eight):
    rng = np.random.default_rng(5)
    a = rng.random((9, 11)) < 0.5
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    want, n = np.zeros(a.shape, int), 0
    for p in zip(*np.nonzero(a)):
        if not want[p]:
            n += 1
            open_ = [p]
            while open_:
                q = open_.pop()
                if 0 <= q[0] < 9 and 0 <= q[1] < 11 and a[q] and not want[q]:
                    want[q] = n
                    open_ += [(q[0] + d[0], q[1] + d[1]) for d in near]
    got = plane(label.components(stack(spark, a).where("v = 1"), eight, tile), a.shape, "label_id")
    assert (got == want).all()


def test_hysteresis_keeps_connected(spark):
    a = np.full((5, 5), 200)
    a[1, 1], a[1, 2], a[4, 4] = 20, 60, 60
    df = stack(spark, a)
    assert pixels(label.hysteresis(df.where("v < 100"), df.where("v < 50"))) == {(1, 1), (1, 2)}


def test_fill_holes_and_sizes(spark):
    a = np.zeros((10, 10))
    a[2:8, 2:8] = 1
    a[4:6, 4:6] = 0
    a[0, 9] = 1
    df = stack(spark, a)
    filled = label.fill_holes(df.where("v = 1"), df)
    assert len(pixels(filled)) == 37
    assert len(pixels(label.by_size(label.components(filled), 2))) == 36
    assert len(pixels(label.by_size(label.components(filled), 0, 5))) == 1


def test_opening_drops_points(spark):
    a = np.zeros((20, 20))
    a[3, 3] = 1
    a[8:16, 8:16] = 1
    kept = pixels(label.opening(stack(spark, a).where("v = 1"), 1, 20, 20))
    assert (3, 3) not in kept and (10, 10) in kept


@pytest.mark.parametrize("tile", [2, 256])
def test_watershed_splits_two_peaks(spark, tile):
    v = np.array([[1, 5, 9, 5, 2, 6, 8, 6, 1]])
    df = stack(spark, v)
    seeds = df.where("v >= 8").withColumn("label_id", F.when(F.col("x") < 4, 1).otherwise(2))
    got = plane(label.watershed(df, seeds, df, tile=tile), v.shape, "label_id")[0]
    assert got[:4].tolist() == [1, 1, 1, 1] and got[5:].tolist() == [2, 2, 2, 2]


@pytest.mark.parametrize("tile", [2, 256])
def test_h_maxima(spark, tile):
    df = stack(spark, [[0, 3, 0, 9, 0]])
    assert pixels(label.h_maxima(df, 5, tile=tile)) == {(0, 3)}


def test_filters_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1000, (16, 16))
    df = stack(spark, a)
    k = neighbour.gaussian_kernel(1.2)
    r = len(k) // 2
    pad = np.pad(a.astype(float), r, mode="reflect")
    want = np.apply_along_axis(lambda v: np.correlate(v, k, "valid"), 1, pad)
    want = np.apply_along_axis(lambda v: np.correlate(v, k, "valid"), 0, want)
    assert np.allclose(plane(neighbour.gaussian(df, 1.2), a.shape), want)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, mode="edge"), (3, 3))
    assert np.allclose(plane(neighbour.median(df, 3, 16, 16, tile=5), a.shape), np.median(views, axis=(2, 3)))
    flat = stack(spark, np.full((8, 8), 40))
    assert np.allclose(plane(neighbour.bilateral(flat, 5, 10, 2, 8, 8), (8, 8)), 40)
    assert np.allclose(plane(neighbour.nlmeans(flat, 3, 5, 10, 8, 8), (8, 8)), 40)


def test_haar_without_noise_is_identity(spark):
    a = np.arange(64).reshape(8, 8)
    assert np.allclose(plane(neighbour.haar_denoise(stack(spark, a), 2, sigma=0.0), a.shape), a)


def test_pyramid_and_projection(spark):
    a = np.arange(64).reshape(8, 8)
    levels = project.pyramid(stack(spark, a), 8, 8, 2, least=2)
    assert plane(levels.where("level = 1"), (4, 4))[0, 0] == np.floor(a[:2, :2].mean())
    with pytest.raises(ValueError):
        project.z_project(stack(spark, a), "median")
    with pytest.raises(ValueError):
        neighbour.bleach_correction(stack(spark, a), "exponential")


def test_subset_keeps_all_when_empty(spark):
    df = stack(spark, [[1, 2]])
    assert select.subset(df, "t", []).count() == 2
    with pytest.raises(ValueError):
        select.channels(df, [])


def objects(spark, rows):
    return spark.createDataFrame([("s", 0, "c", f, i, float(y), float(x), y - 2, x - 2, y + 2, x + 2) for f, i, y, x in rows], "source_file string, m int, c string, frame int, label_id int, cy double, cx double, y0 int, x0 int, y1 int, x1 int")


def test_tracking_follows_objects_over_a_gap(spark):
    rows = objects(spark, [(0, 1, 10, 10), (0, 2, 30, 30), (2, 1, 31, 30), (2, 2, 11, 10), (3, 1, 12, 11)])
    got = {(r.frame, r.label_id): (r.track_id, r.track_length) for r in track.link_objects(rows, 5.0, 3).collect()}
    assert got[(0, 1)] == got[(2, 2)] == got[(3, 1)] == (1, 3)
    assert got[(0, 2)] == got[(2, 1)] == (None, 2)


def test_tracking_single_frame_is_untracked(spark):
    assert track.link_objects(objects(spark, [(0, 1, 5, 5)]), 5.0).first().track_id is None


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = sorted(int(k) for k in rng.integers(1, 6, 2))
    cost = rng.random((n, m))
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    got = track.assign(cost)
    assert len(set(got)) == n and abs(sum(cost[i, j] for i, j in enumerate(got)) - best) < 1e-9


def test_perimeter_and_shape_of_square(spark):
    a = np.zeros((9, 9))
    a[2:6, 2:6] = 1
    labels = stack(spark, a).where("v = 1").withColumn("label_id", F.lit(1))
    assert measure.perimeter(labels).first().perimeter == 12
    assert measure.solidity(labels).first().solidity == 1
    assert measure.moments(labels).first().eccentricity == 0


def test_summary_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "frame int, area_px long")
    assert [*measure.summary(empty).first()] == [0, 0, 0.0, 0.0, 0.0, 0.0]


def test_chain_errors(spark):
    sizes = spark.createDataFrame([(0, 2), (1, 1)], "file_idx int, n int")
    with pytest.raises(ValueError):
        joins.chain_map(sizes, "zigzag")
    assert [tuple(r) for r in joins.chain_map(sizes, "interleaved").orderBy("out_idx").collect()] == [(0, 0, 0), (1, 1, 0), (2, 0, 1)]


def test_stage_layout_falls_back_to_a_grid(spark):
    tiles = spark.createDataFrame([(i, 0.0, 0.0) for i in range(4)], "m int, stage_x double, stage_y double")
    assert {(r.off_y, r.off_x) for r in layout.stage_layout(tiles, 0.5, 10, 20).collect()} == {(0, 0), (0, 20), (10, 0), (10, 20)}


def test_dimension_order_must_fit(spark):
    with pytest.raises(ValueError):
        stacks.assign_dimensions(spark.createDataFrame([(0, 1)], "i int, v int"), "TYX", {"T": 1, "Y": 1})


def test_recipe_refuses_unknown_steps(spark):
    df = stack(spark, [[1, 2]])
    with pytest.raises(KeyError):
        jobs.apply_recipe(df, [("nothing", {})])
    assert jobs.apply_recipe(df, [("nothing", {})], skip_unknown=True).count() == 2


def test_batch_skips_what_is_done_and_isolates_bad_files(spark, tmp_path):
    good = stack(spark, np.arange(64).reshape(8, 8))
    bad = stack(spark, np.full((8, 8), 99_999)).withColumn("source_file", F.lit("bad"))
    params = {"high": 90, "height": 8, "width": 8}
    first = jobs.run_batch(spark, good.union(bad), [], "histogram_threshold", params, str(tmp_path / "out"))
    assert first["errors"].first().source_file == "bad"
    ledger = spark.createDataFrame(first["ledger"].collect(), jobs.LEDGER)
    n = first["regions"].count()
    again = jobs.run_batch(spark, good, [], "histogram_threshold", params, str(tmp_path / "out"), ledger)
    assert again["regions"].count() == n > 0


def test_spots_find_blobs(spark):
    rng = np.random.default_rng(0)
    yy, xx = np.mgrid[:48, :48]
    a = 300 + rng.integers(0, 30, (48, 48)) + sum(3000 * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * 2.5**2)) for y, x in ((12, 12), (34, 30)))
    kind = {"height": 48, "width": 48}
    found = {(r.y, r.x) for r in analyses.find_spots(stack(spark, a), 6.0, **kind)["peaks"].collect()}
    assert len(found) == 2 and all(min(abs(y - p) + abs(x - q) for p, q in found) <= 3 for y, x in ((12, 12), (34, 30)))
    dark = {(r.y, r.x) for r in analyses.find_spots(stack(spark, 4095 - a.astype(int)), 6.0, bright=False, gate=10, **kind)["peaks"].collect()}
    assert len(dark) == 2


def test_empty_stacks(spark):
    empty = stack(spark, [[1]]).where("v < 0")
    assert label.components(empty).count() == 0
    assert measure.regions(empty.withColumn("label_id", F.lit(1))).count() == 0
    assert hist.otsu(empty).count() == 0
    assert neighbour.gaussian(empty, 1.0).count() == 0


def test_debounce_stream_equals_batch_before_the_watermark(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, cast(id % 3 AS long) AS user_id, timestamp_seconds(1700000000 + id * id % 997 * 7) AS ts FROM range(300)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in events.debounce(rows, "user_id", 60_000).select("user_id", "event_id", "ts").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.debounce_stream(stream, "user_id", 60_000, "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("bursts").select("user_id", "event_id", "ts").collect()}
    last = rows.agg(F.max("ts")).first()[0]
    want = {r for r in batch if (last - r[2]).total_seconds() > 130}
    assert want <= got <= batch


def test_upgrade_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, cast(id % 2 AS long) AS user_id, timestamp_millis(1700000000000 + id * 300) AS ts, CASE WHEN id % 5 < 2 THEN 'generic' ELSE 'rich' END AS event_type FROM range(60)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {r.event_id for r in events.upgrade(rows, "user_id", "generic", "rich", 700).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.upgrade_stream(stream, "user_id", "generic", "rich", 700, "1 second").writeStream.format("memory").queryName("upgraded").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id for r in spark.table("upgraded").collect()} == batch


def test_labels_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    df = stack(spark, rng.random((12, 12)) < 0.4).where("v = 1")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in label.components(df, tile=5).select(*FRAME, "y", "x", "label_id").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_dimensions_and_canvas_follow_the_table(spark, tmp_path):
    from lumastack import registry

    rows = [(i, 0, [0.001 * ((i + k) % 300) for k in range(64)]) for i in range(1006)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    s6 = registry.queries()["s6_dimension_order"](spark, str(tmp_path))
    assert s6.count() == s6.select("t", "z", "c", "y", "x").distinct().count() == 1006 * 64
    assert s6.agg(F.max("t")).first()[0] == 4
    r23 = registry.queries()["r23_tile_placement"](spark, str(tmp_path))
    # the canvas holds whole tiles: the 20th has all of its 50 rows, where it was once cut at 20
    assert r23.agg(F.max("y")).first()[0] == 19 * 20 + 49
    assert r23.agg(F.max("x")).first()[0] == 2 * 40 + 63
    flat = spark.createDataFrame([(i, 1) for i in range(5)], "i int, v int")
    for size in (4, 6):
        with pytest.raises(ValueError):
            stacks.assign_dimensions(flat, "X", {"X": size})
    with pytest.raises(ValueError):
        stacks.assign_dimensions(flat, "YX", {"Y": 2, "X": 2}, open_end=True)
    assert stacks.assign_dimensions(flat, "YX", {"Y": 3, "X": 2}, open_end=True).count() == 5


def test_per_frame_spine_reaches_the_last_event(spark, tmp_path):
    from lumastack import registry

    rows = [(i, i % 2 * (i % 3), i, "view", 2.0) for i in range(900)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double")
    table.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["r15_per_frame"](spark, str(tmp_path))
    assert got.agg(F.sum("n")).first()[0] == 900
    assert got.count() == 600
