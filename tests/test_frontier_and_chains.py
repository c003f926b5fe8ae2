"""Labels, morphology, floods, chains, galleries, ranks and nearest search against numpy or plain Python models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lumastack.operators import hist, joins, label, measure, neighbour, point, ranks, track
from lumastack.streaming import events

from .test_operators import pixels, plane, stack


def flood_fill(a, eight):
    near = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    want, n = np.zeros(a.shape, int), 0
    for p in zip(*np.nonzero(a)):
        if not want[p]:
            n += 1
            open_ = [p]
            while open_:
                q = open_.pop()
                if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] and not want[q]:
                    want[q] = n
                    open_ += [(q[0] + d[0], q[1] + d[1]) for d in near]
    return want


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("density", [0.3, 0.55, 1.0])
def test_runs_label_like_a_flood_fill(eight, density):
    rng = np.random.default_rng(int(density * 10))
    for shape in ((1, 30), (30, 1), (17, 23)):
        a = rng.random(shape) < density
        y, x = np.nonzero(a)
        first = label._local_labels(y, x, eight)
        want = flood_fill(a, eight)[y, x]
        assert [want[i] for i in first] == want.tolist()
        assert all(first[i] == min(np.flatnonzero(want == want[i])) for i in range(len(y)))
    assert len(label._local_labels(np.zeros(0, int), np.zeros(0, int), eight)) == 0


@pytest.mark.parametrize("tile", [1, 4, 7])
def test_components_over_many_levels_of_squares(spark, tile):
    spiral = np.zeros((21, 26), dtype=int)
    y0, x0, y1, x1 = 0, 0, 20, 25
    while y0 <= y1 and x0 <= x1:  # one long winding line
        spiral[y0, x0 : x1 + 1] = 1
        spiral[y0 : y1 + 1, x1] = 1
        spiral[y1, x0 + 2 : x1 + 1] = 1
        spiral[y0 + 2 : y1 + 1, x0 + 2] = 1
        y0, x0, y1, x1 = y0 + 2, x0 + 2, y1 - 2, x1 - 2
    for a in (spiral, np.random.default_rng(tile).random((21, 26)) < 0.6):
        got = plane(label.components(stack(spark, a).where("v = 1"), True, tile), a.shape, "label_id")
        assert (got == flood_fill(np.asarray(a) == 1, True)).all()
    left = stack(spark, spiral).where("v = 1").withColumns({"y": F.col("y") - 9, "x": F.col("x") - 5})
    moved = {(r.y + 9, r.x + 5, r.label_id) for r in label.components(left, True, tile).collect()}
    assert moved == {(*p, flood_fill(spiral == 1, True)[p]) for p in zip(*np.nonzero(spiral))}


def disk(r):
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def moved_by_disk(a, r, grow):
    """Definition: any (all) of the disk is set; beyond the plane counts as unset for any and as set for all."""
    out = np.zeros_like(a)
    for y, x in np.ndindex(a.shape):
        near = [a[y + dy, x + dx] for dy, dx in disk(r) if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
        out[y, x] = any(near) if grow else all(near)
    return out


@pytest.mark.parametrize("r", [0, 1, 2, 5, 9])
def test_distance_threshold_is_the_disk(r):
    rng = np.random.default_rng(r)
    for share in (0.02, 0.3, 0.0):
        a = rng.random((23, 31)) < share
        assert (label.within(a, r) == moved_by_disk(a, r, True)).all()


@pytest.mark.parametrize(("r", "tile"), [(1, 4), (3, 8), (3, 256), (6, 5)])
def test_morphology_over_tiles_equals_its_definition(spark, r, tile):
    a = np.random.default_rng(r * tile).random((17, 22)) < 0.8
    a[4:12, 5:16] = True
    df, size = stack(spark, a).where("v = 1"), a.shape
    got = lambda d: plane(d.withColumn("v", F.lit(1)), size) == 1
    grown, shrunk = moved_by_disk(a, r, True), moved_by_disk(a, r, False)
    assert (got(label.dilate(df, r, *size, tile=tile)) == grown).all()
    assert (got(label.erode(df, r, *size, tile=tile)) == shrunk).all()
    assert (got(label.opening(df, r, *size, tile=tile)) == moved_by_disk(shrunk, r, True)).all()
    assert (got(label.closing(df, r, *size, tile=tile)) == moved_by_disk(grown, r, False)).all()
    free = pixels(label.dilate(df, r, tile=tile))
    assert free == {(y + dy, x + dx) for y, x in zip(*np.nonzero(a)) for dy, dx in disk(r)}
    padded = moved_by_disk(np.pad(a, r + 1), r, False)[r + 1 : -r - 1, r + 1 : -r - 1]
    assert pixels(label.erode(df, r, tile=tile)) == set(zip(*np.nonzero(padded)))


def test_morphology_reads_few_copies(spark):
    df = stack(spark, np.ones((64, 64), int)).where("v = 1")
    assert label._dealt(df, 10, 256).count() < 1.2 * 64 * 64 + 64 * 20 * 3


def flooded(v, seeds, mask):
    """Whole-plane model: heights by a priority queue, then labels along the ways that give the heights."""
    h, near = {p: -v[p] for p in zip(*np.nonzero(seeds))}, lambda p: [q for q in ((p[0], p[1] + 1), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0] - 1, p[1])) if 0 <= q[0] < v.shape[0] and 0 <= q[1] < v.shape[1] and mask[q]]
    queue, done = [(x, p) for p, x in h.items()], set()
    while queue:
        queue.sort(reverse=True)
        x, p = queue.pop()
        if p not in done:
            done.add(p)
            for q in near(p):
                if max(x, -v[q]) < h.get(q, math.inf):
                    h[q] = max(x, -v[q])
                    queue.append((h[q], q))
    out = np.zeros(v.shape, int)
    for label_id in sorted(set(seeds[seeds > 0]), reverse=True):  # smaller labels come later and win
        open_ = list(zip(*np.nonzero(seeds == label_id)))
        seen = set(open_)
        while open_:
            p = open_.pop()
            out[p] = label_id
            for q in near(p):
                if q not in seen and not seeds[q] and max(h[p], -v[q]) == h[q]:
                    seen.add(q)
                    open_.append(q)
    return out


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_watershed_equals_a_whole_plane_model(spark, tile):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 12, (19, 24))
    mask = rng.random(v.shape) < 0.85
    seeds = np.zeros(v.shape, int)
    for i, p in enumerate(rng.choice(np.flatnonzero(mask), 6, replace=False)):
        seeds.flat[p] = i + 1
    df = stack(spark, v)
    marks, ground = stack(spark, seeds).where("v > 0").withColumnRenamed("v", "label_id"), stack(spark, mask).where("v = 1")
    settled = []
    got = plane(label.watershed(df, marks, ground, tile=tile, settled=settled), v.shape, "label_id")
    assert (got == flooded(v, seeds, mask)).all()
    tiles = -(-19 // tile) * -(-24 // tile)
    assert settled[0] == tiles and (len(settled) == 1 if tiles == 1 else settled[-1] < tiles / 2)


@pytest.mark.parametrize("tile", [4, 256])
def test_h_maxima_equal_a_whole_plane_model(spark, tile):
    v = np.random.default_rng(3).integers(0, 30, (18, 21))
    g, r = v.astype(float), v - 8.0
    while True:
        p = np.pad(r, 1, constant_values=-np.inf)
        new = np.minimum(g, np.max([p[1 + a : 19 + a, 1 + b : 22 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0))
        if (new == r).all():
            break
        r = new
    settled = []
    assert pixels(label.h_maxima(stack(spark, v), 8, tile=tile, settled=settled)) == set(zip(*np.nonzero(g - r >= 8 - 1e-9)))
    assert settled == sorted(settled, reverse=True) or tile == 256


def test_a_snake_is_settled_at_its_head_only(spark):
    """One seed at the end of a long line: after the first round only the tiles at the front settle."""
    v = np.ones((1, 120), int)
    df = stack(spark, v)
    seeds = df.where("x = 0").withColumn("label_id", F.lit(5))
    settled = []
    got = plane(label.watershed(df, seeds, df, tile=10, settled=settled), v.shape, "label_id")
    assert (got == 5).all() and settled[0] == 12 and max(settled[1:]) <= 2 and len(settled) > label._VERSIONS


# --- tracks


def linked(rows, distance, least):
    """Plain model: frame by frame, best one-to-one assignment by brute force over crowded objects, chains, ids."""
    frames = sorted({r[0] for r in rows})
    after = {}
    for a, b in itertools.pairwise(frames):
        left, right = [r for r in rows if r[0] == a], [r for r in rows if r[0] == b]
        ok = {(p[1], q[1]): math.hypot(p[2] - q[2], p[3] - q[3]) for p in left for q in right if math.hypot(p[2] - q[2], p[3] - q[3]) <= distance}
        best = (math.inf, ())

        def go(rest, used, cost, chosen):
            nonlocal best
            if cost >= best[0] - 1e-12:
                return
            if not rest:
                best = (cost, tuple(chosen))
                return
            p, *others = rest
            for q in right:
                if q[1] not in used and (p[1], q[1]) in ok:
                    go(others, used | {q[1]}, cost + ok[p[1], q[1]], [*chosen, (p[1], q[1])])
            go(others, used, cost + distance + 1, chosen)

        go(left, frozenset(), 0.0, [])
        after |= {(a, p): (b, q) for p, q in best[1]}
    heads = sorted({(r[0], r[1]) for r in rows} - set(after.values()))
    out = {}
    for n, head in enumerate(heads, 1):
        chain = [head]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        out |= {o: (n if len(chain) >= least else None, len(chain)) for o in chain}
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_tracks_equal_a_plain_linker(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(12):
        if t == 5:
            continue
        for i in range(int(rng.integers(2, 6))):
            cy, cx = rng.uniform(0, 20, 2)
            rows.append((t, i + 1, float(cy), float(cx)))
    big = [("s", 0, "c", t, i, cy, cx, int(cy) - 30, int(cx) - 30, int(cy) + 30, int(cx) + 30) for t, i, cy, cx in rows]
    table = spark.createDataFrame(big, "source_file string, m int, c string, frame int, label_id int, cy double, cx double, y0 int, x0 int, y1 int, x1 int")
    got = {(r.frame, r.label_id): (r.track_id, r.track_length) for r in track.link_objects(table, 6.0, 2).collect()}
    assert got == linked(rows, 6.0, 2)


def test_long_chains_take_logarithmic_rounds(spark, monkeypatch):
    n = 200
    links = spark.createDataFrame([("s", 0, "c", t, 1, t + 1, 1, 0.0) for t in range(n)] + [("s", 0, "c", 4, 7, 5, 9, 0.0)], "source_file string, m int, c string, frame_a int, label_a int, frame_b int, label_b int, distance double")
    made = []
    write = track.written
    monkeypatch.setattr(track, "written", lambda df, name: made.append(name) or write(df, name))
    got = {(r.frame, r.label_id): (r.head_frame, r.head_label) for r in track.chain_heads(links).collect()}
    assert got == {(t, 1): (0, 1) for t in range(n + 1)} | {(4, 7): (4, 7), (5, 9): (4, 7)}
    assert len(made) <= 3 + math.ceil(math.log2(n / track.STRIDE)) + 1


def test_numbers_follow_the_levels(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b), int(c), i) for i, (a, b, c) in enumerate(rng.integers(0, 5, (300, 3)))]
    df = spark.createDataFrame(rows, "g int, b int, c int, i int")
    got = {r.i: r.nth for r in ranks.numbered(df, ["g"], ["b"], ["c"], ["i"]).collect()}
    want = {}
    for g in range(5):
        want |= {r[3]: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1)}
    assert got == want


def test_gallery_pages_equal_a_numpy_layout(spark):
    rng = np.random.default_rng(8)
    height, width, k, per_row = 30, 40, 4, 3
    images = rng.integers(0, 200, (3, height, width, 3))
    boxes = {1: (0, 0, 7, 9), 2: (5, 6, 30, 20), 3: (10, 10, 15, 40), 4: (0, 30, 12, 40), 6: (20, 0, 30, 11)}
    there = [(t, i) for t in range(3) for i in boxes if (t + i) % 4]
    marks = {(t, i): (boxes[i][0] + 1, boxes[i][1] + 2) for t, i in there}
    rgb = spark.createDataFrame([("s", 0, "c", t, y, x, *map(int, images[t, y, x])) for t in range(3) for y in range(height) for x in range(width)], "source_file string, m int, c string, t int, y int, x int, r int, g int, b int")
    own = lambda rows, form: spark.createDataFrame([("s", 0, "c", *r) for r in rows], "source_file string, m int, c string, " + form)
    b = own([(i, *v) for i, v in boxes.items()], "track_id long, cy0 int, cx0 int, cy1 int, cx1 int")
    members, labels = own(there, "t int, track_id long"), own([(t, y, x, i) for (t, i), (y, x) in marks.items()], "t int, y int, x int, track_id long")
    got = track.gallery_pages(rgb, labels, b, members, k, per_row, blank=(9, 9, 9)).collect()
    ph, pw = max(v[2] - v[0] for v in boxes.values()), max(v[3] - v[1] for v in boxes.values())
    want = {}
    for n, i in enumerate(boxes):
        for t in range(3):
            if (t, i) in marks:
                sheet = want.setdefault((n // k, t), np.full((-(-k // per_row) * ph, per_row * pw, 3), 9))
                y0, x0, y1, x1 = boxes[i]
                crop = images[t, y0:y1, x0:x1].copy()
                y, x = marks[t, i]
                crop[y - y0, x - x0] = np.floor(np.round(crop[y - y0, x - x0] * 0.45 + np.array(point.PALETTE[(i - 1) % 12]) * 0.55, 6))
                oy, ox = n % k // per_row * ph, n % k % per_row * pw
                sheet[oy : oy + y1 - y0, ox : ox + x1 - x0] = crop
    assert {(r.page, r.t) for r in got} == set(want) and len(got) == sum(v.shape[0] * v.shape[1] for v in want.values())
    assert all(tuple(want[r.page, r.t][r.y, r.x]) == (r.r, r.g, r.b) for r in got)


# --- thresholds, ranks, nearest


@pytest.mark.parametrize("classes", [2, 3, 4, 5])
def test_multi_otsu_equals_brute_force(spark, classes):
    rng = np.random.default_rng(classes)
    a = rng.choice([3, 4, 9, 10, 11, 20, 31, 32, 40, 55], (20, 20), p=np.array([3, 1, 4, 2, 2, 5, 1, 1, 6, 2]) / 27)
    got = hist.multi_otsu(stack(spark, a), classes=classes).first()
    values, n = np.unique(a, return_counts=True)
    best = None
    for cuts in itertools.combinations(range(len(values) - 1), classes - 1):
        edges = [-1, *cuts, len(values) - 1]
        score = sum((n[i + 1 : j + 1] * values[i + 1 : j + 1]).sum() ** 2 / n[i + 1 : j + 1].sum() for i, j in itertools.pairwise(edges))
        if best is None or score > best[0] + 1e-7:
            best = (score, [int(values[c]) for c in cuts])
    assert ([got.low, got.high] if classes == 3 else got.thresholds) == best[1]


def test_multi_otsu_of_few_values_and_of_bins(spark):
    assert hist.multi_otsu(stack(spark, [[1, 2]]), classes=3).count() == 0
    with pytest.raises(ValueError):
        hist.multi_otsu(stack(spark, [[1]]), classes=1)
    wide = np.concatenate([np.arange(0, 500, 3), np.arange(30_000, 30_600, 2), np.arange(65_000, 65_500)])
    low, high = hist.multi_otsu(stack(spark, [wide]), bins=128).select("low", "high").first()
    assert 495 <= low < 30_000 and 30_598 <= high < 65_000


def test_ranks_of_hot_and_odd_values(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((24, 30)) < 0.4, 0, rng.integers(-50, 5000, (24, 30)))
    got = plane(neighbour.rank_normalise(stack(spark, a)), a.shape)
    want = np.empty(a.size)
    want[np.argsort(a.ravel(), kind="stable")] = np.arange(a.size) / (a.size - 1)
    assert np.allclose(got.ravel(), want, atol=1e-15)
    assert neighbour.rank_normalise(stack(spark, [[7]])).first().v == 0.0
    floats = [-math.inf, -1e300, -0.1, 0.0, 0.0, 1e-300, 0.3, 0.3, 5.0, math.inf]
    rows = spark.createDataFrame([("g", v) for v in floats], "g string, v double")
    seen = {r.v: (r.before, r.n, r.total) for r in ranks.ranked_values(rows, ["g"], "v").collect()}
    assert all(seen[v] == (floats.index(v), floats.count(v), len(floats)) for v in floats)


def test_latency_is_exact_for_a_hot_event(spark, tmp_path):
    rng = np.random.default_rng(6)
    values = {"hot": np.concatenate([np.full(4000, 12.5), rng.exponential(100, 3000).round(2)]), "one": np.array([3.0]), "two": np.array([4.0, 2.0])}
    rows = [(e, float(v)) for e, vs in values.items() for v in vs] + [("hot", None)]
    got = {r.event: r for r in measure.latency_summary(spark.createDataFrame(rows, "event string, duration_us double")).collect()}
    for e, vs in values.items():
        vs, n = np.sort(vs), len(vs)
        assert (got[e].n, got[e].p50_ms, got[e].p99_ms) == (n, vs[n // 2] / 1000, vs[min(n - 1, int(n * 0.99))] / 1000)
        assert math.isclose(got[e].mean_ms, vs.mean() / 1000)
    log = spark.sql("SELECT timestamp_seconds(1700000000 + id * 7) AS ts, if(id % 3 = 0, 'a', 'b') AS event_type, cast(id * 37 % 101 AS double) AS value FROM range(4000)")
    batch = {tuple(r) for r in events.latency_windows(log, "1 hour").collect()}
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.latency_stream(stream, "1 hour", "12 hours", str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()]
    assert len(found) == len(set(found)) and set(found) <= batch


def test_nearest_of_a_crowded_frame_reads_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    spots = [(0, int(y), int(x)) for y, x in rng.integers(0, 60, (2500, 2))] + [(1, 5, 5), (1, 900, 1000)] + [(2, y, x) for y in range(400, 440) for x in range(400, 440)]
    spots = list(dict.fromkeys(spots))
    d = spark.createDataFrame([(t, i, y, x, i * 10) for i, (t, y, x) in enumerate(spots)], "t int, i int, y int, x int, score int")
    asked = [(t, n, float(cy), float(cx)) for n, (t, cy, cx) in enumerate([(0, 30.2, 31.7), (0, -80.0, 200.0), (0, 12.0, 12.0), (1, 400.0, 500.0), (1, 452.5, 502.5), (2, 0.0, 0.0), (2, 420.3, 300.0), (2, 419.5, 419.5), (3, 1.0, 1.0)])]
    r = spark.createDataFrame(asked, "t int, lid int, cy double, cx double")
    got = {x.lid: x.score for x in joins.nearest(r, d, ["t"], "i", "score").collect()}
    want = {}
    for t, lid, cy, cx in asked:
        own = [(round((cy - y) ** 2 + (cx - x) ** 2, 6), i) for i, (s, y, x) in enumerate(spots) if s == t]
        if own:
            want[lid] = min(own)[1] * 10
    assert got == want
    # the detections that a region is compared with: rows of the last join
    seen, join = [], DataFrame.join

    def counting(self, other, *args, **kwargs):
        out = join(self, other, *args, **kwargs)
        if "tie_" in other.columns:
            seen.append(out.groupBy("lid").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(DataFrame, "join", counting)
    joins.nearest(r, d, ["t"], "i", "score")
    assert max(seen) <= 100  # of 1,600 and about 1,800


def test_nearest_on_empty_tables(spark):
    d = spark.createDataFrame([], "t int, i int, y int, x int, score int")
    r = spark.createDataFrame([(0, 1, 2.0, 3.0)], "t int, lid int, cy double, cx double")
    assert joins.nearest(r, d, ["t"], "i", "score").count() == 0
    assert joins.nearest(r.where("lid > 5"), d, ["t"], "i", "score").count() == 0
