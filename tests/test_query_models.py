"""Every registered query without SQL against a numpy or plain Python model over all of its rows."""

import heapq
import itertools
import math
import os
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumastack import registry
from lumastack.operators import neighbour

from .test_analyses_models import rank, tissue
from .test_frontier_and_chains import disk, flood_fill, moved_by_disk

SF = "/root/testdata/sf0.001"
SQL, ALL = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def planes():
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    v = np.floor((np.stack(t["embedding"].to_pylist()).astype(float) + 0.6) * 1000).astype(int)
    return {i: p for i, p in enumerate(v.reshape(-1, 50, 64))}


def as_planes(rows, value, fill=0.0):
    out = defaultdict(lambda: np.full((50, 64), fill))
    for r in rows:
        out[r.t][r.y, r.x] = r[value] if value else 1
    return out


def correlated(a, k, axis, mode):
    r = len(k) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    return np.apply_along_axis(lambda v: np.correlate(v, k, "valid"), axis, np.pad(a.astype(float), pad, mode=mode))


def gauss(a, sigma):
    k = neighbour.gaussian_kernel(sigma)
    return correlated(correlated(a, k, 1, "symmetric"), k, 0, "symmetric")


def log_response(a, s):
    g, d = neighbour.gaussian_kernel(s), neighbour.gaussian_kernel(s, 2)
    both = correlated(correlated(a, d, 1, "symmetric"), g, 0, "symmetric") + correlated(correlated(a, g, 1, "symmetric"), d, 0, "symmetric")
    return -(s**2) * both


def maxima(a, d, least):
    """Box maxima; of equal values the first in raster order."""
    out = []
    for y, x in zip(*np.nonzero(a >= least)):
        box = a[max(y - d, 0) : y + d + 1, max(x - d, 0) : x + d + 1]
        if box.max() == a[y, x] and min((i + max(y - d, 0), j + max(x - d, 0)) for i, j in zip(*np.nonzero(box == a[y, x]))) == (y, x):
            out.append((int(y), int(x)))
    return out


def draw(points, r, shape=(50, 64)):
    out = np.zeros(shape, int)
    for i, (y, x) in enumerate(points, 1):
        for dy, dx in disk(max(1, round(r))):
            if 0 <= y + dy < shape[0] and 0 <= x + dx < shape[1]:
                out[y + dy, x + dx] = i
    return out


def percentile(a, p):
    return np.sort(a.ravel())[math.ceil(p / 100 * a.size) - 1]


def flood(v, seeds, mask):
    """Heights by a priority queue, then the smallest label along the ways that give them; seeds keep theirs."""
    near = lambda p: [q for q in ((p[0], p[1] + 1), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0] - 1, p[1])) if 0 <= q[0] < v.shape[0] and 0 <= q[1] < v.shape[1] and mask[q]]
    h = {p: -v[p] for p in zip(*np.nonzero(seeds * mask))}
    queue = [(x, p) for p, x in h.items()]
    heapq.heapify(queue)
    while queue:
        x, p = heapq.heappop(queue)
        if x == h[p]:
            for q in near(p):
                if max(x, -v[q]) < h.get(q, math.inf):
                    h[q] = max(x, -v[q])
                    heapq.heappush(queue, (h[q], q))
    out = np.zeros(v.shape, int)
    for label_id in sorted(set(seeds[(seeds > 0) & mask]), reverse=True):
        open_ = list(zip(*np.nonzero((seeds == label_id) & mask)))
        seen = set(open_)
        while open_:
            p = open_.pop()
            out[p] = label_id
            for q in near(p):
                if q not in seen and not (seeds * mask)[q] and max(h[p], -v[q]) == h[q]:
                    seen.add(q)
                    open_.append(q)
    return out


def areas(labels):
    return sorted(np.unique(labels[labels > 0], return_counts=True)[1].tolist())


def same_areas(rows, want):
    got = defaultdict(list)
    for r in rows:
        got[r.t].append(r.area_px)
    assert {t: sorted(v) for t, v in got.items()} == {t: a for t, a in want.items() if a}


# --- models, by query


def h6(rows, planes):
    got = {r.t: r.threshold for r in rows}
    for t, a in planes.items():
        v = a.ravel() // 8
        h, want = np.bincount(v - v.min()).astype(float), None
        for _ in range(10_000):
            h = np.array([(h[max(i - 1, 0)] + h[i] + h[min(i + 1, len(h) - 1)]) / 3 for i in range(len(h))])
            line = [0.0, *h, 0.0]
            turns = [s for s in np.sign(np.diff(line)) if s]
            if sum(a > 0 > b for a, b in itertools.pairwise(turns)) <= 2:
                tops = [i for i in range(len(h)) if line[i + 1] > line[i] and line[i + 1] >= line[i + 2]]
                want = tops[0] + int(np.argmin(h[tops[0] : tops[1] + 1])) + int(v.min()) if len(tops) == 2 else None
                break
        assert got[t] == want


def s8(rows, planes):
    assert [(r.name, r.n_bytes) for r in rows] == [(n, os.path.getsize(f"{SF}/{n}")) for n in sorted(os.listdir(SF)) if n.lower().endswith(".parquet")]


def blocks(a):
    y, x = np.indices(a.shape)
    return np.where(a >= 600, (y // 10) * 4 + x // 16 + 1, 0)


def r11(rows, planes):
    got = {(r.t, r.label_id): r.solidity for r in rows}
    n = 0
    for t, a in planes.items():
        lab = blocks(a)
        for i in np.unique(lab[lab > 0]):
            own = np.argwhere(lab == i) * 2
            pts = np.unique(np.concatenate([own + d for d in ((0, 1), (0, -1), (1, 0), (-1, 0))]), axis=0)
            inside = np.ones(len(cells := np.argwhere(np.ones((12, 18), bool)) + own.min(axis=0) // 2 - 1), bool)
            # every line through two outline points with all others on one side bounds the hull
            for p, q in itertools.permutations(pts.tolist(), 2):
                side = (q[0] - p[0]) * (pts[:, 1] - p[1]) - (q[1] - p[1]) * (pts[:, 0] - p[0])
                if (side >= 0).all():
                    inside &= (q[0] - p[0]) * (cells[:, 1] * 2 - p[1]) - (q[1] - p[1]) * (cells[:, 0] * 2 - p[0]) >= 0
            assert math.isclose(got[t, i], (len(own)) / inside.sum())
            n += 1
        if t == 1:
            break
    assert n > 20


def k10(rows, planes):
    got = as_planes(rows, "v")
    for t, a in planes.items():
        e = np.pad(np.floor(a / 4095 * 255), 3, mode="reflect")
        total, weight = np.zeros(a.shape), np.zeros(a.shape)
        for dy, dx in itertools.product(range(-2, 3), repeat=2):
            far = sum((e[3 + dy + p : 53 + dy + p, 3 + dx + q : 67 + dx + q] - e[3 + p : 53 + p, 3 + q : 67 + q]) ** 2 for p in (-1, 0, 1) for q in (-1, 0, 1)) / 9
            w = np.exp(-far / 100)
            total, weight = total + w * e[3 + dy : 53 + dy, 3 + dx : 67 + dx], weight + w
        assert (got[t] == np.floor(np.round(np.rint(np.round(total / weight, 9)) / 255 * 4095, 6))).all()


def k13(rows, planes):
    got = as_planes(rows, "v")
    for t, a in planes.items():
        b = np.minimum(a * 256 // 4096, 255)
        curves = {}
        for gy, gx in itertools.product(range(4), range(4)):
            cell = b[gy * 13 : gy * 13 + 13, gx * 16 : gx * 16 + 16]
            n, limit = np.bincount(cell.ravel(), minlength=256).astype(float), max(1.0, 2.0 * cell.size / 256)
            curves[gy, gx] = np.cumsum(np.minimum(n, limit) + np.maximum(n - limit, 0).sum() / 256) / cell.size
        want = np.zeros(a.shape)
        for y, x in np.ndindex(a.shape):
            fy, fx = (y + 0.5) / 13 - 0.5, (x + 0.5) / 16 - 0.5
            for i, j in itertools.product((0, 1), repeat=2):
                w = (fy % 1 if i else 1 - fy % 1) * (fx % 1 if j else 1 - fx % 1)
                want[y, x] += w * curves[min(max(math.floor(fy) + i, 0), 3), min(max(math.floor(fx) + j, 0), 3)][b[y, x]]
        want = np.floor(np.round(np.minimum(want, 1) * 4095, 6))
        assert (got[t] == want).all()


def k14(rows, planes):
    got = as_planes(rows, "v")
    for t, p in planes.items():
        a, b, c, d = (p[i::2, j::2].astype(float) for i in (0, 1) for j in (0, 1))
        low, parts = (a + b + c + d) / 2, [(a - b + c - d) / 2, (a + b - c - d) / 2, (a - b - c + d) / 2]
        cut = np.median(np.abs(parts[2])) / 0.6745 * math.sqrt(2 * math.log(3200))
        h, w, g = (np.sign(k) * np.maximum(np.abs(k) - cut, 0) for k in parts)
        want = np.empty(p.shape)
        want[::2, ::2], want[::2, 1::2], want[1::2, ::2], want[1::2, 1::2] = (low + h + w + g) / 2, (low - h + w - g) / 2, (low + h - w - g) / 2, (low - h - w + g) / 2
        assert np.allclose(got[t], want, atol=1e-9)


def homogeneity(a, mask, win, r):
    box = np.lib.stride_tricks.sliding_window_view(np.pad(a.astype(float), win // 2, mode="symmetric"), (win, win))
    lo, hi = np.percentile(a, 0.5), np.percentile(a, 99.5)
    hi = lo + 1 if hi <= lo else hi
    eight = np.floor(np.clip((a - lo) / (hi - lo), 0, 1) * 255).astype(int)
    entropy = np.zeros(a.shape)
    for y, x in np.ndindex(a.shape):
        near = [eight[y + dy, x + dx] for dy, dx in disk(r) if 0 <= y + dy < a.shape[0] and 0 <= x + dx < a.shape[1]]
        p = np.unique(near, return_counts=True)[1] / len(near)
        entropy[y, x] = -(p * np.log2(p)).sum()
    out = np.zeros(a.shape)
    ranks = [rank(k[mask]) for k in (np.round(box.mean(axis=(2, 3)), 6), np.round(box.var(axis=(2, 3)), 6), np.round(entropy, 9))]
    out[mask] = np.prod([1 - k for k in ranks], axis=0)
    return out


def k19(rows, planes):
    got = as_planes(rows, "v")
    for t in (0, 7):
        want = homogeneity(planes[t], planes[t] >= 400, 5, 2)
        # last digits of a variance may swap neighbouring ranks
        assert np.allclose(got[t], want, atol=2e-3) and np.abs(got[t] - want).mean() < 1e-5


def k20(rows, planes):
    got = as_planes(rows, None)
    assert all((got[t] == tissue(a, 2, 1, 1.0)).all() for t, a in planes.items())


def k22(rows, planes):
    got = as_planes(rows, None)
    for t, a in planes.items():
        g, r = a.astype(float), a - 300.0
        while True:
            p = np.pad(r, 1, constant_values=-np.inf)
            new = np.minimum(g, np.max([p[1 + i : 51 + i, 1 + j : 65 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0))
            if (new == r).all():
                break
            r = new
        assert ((got[t] == 1) == (g - r >= 300 - 1e-9)).all()


def blob_disks(a, sigmas, least):
    levels = np.stack([log_response(a, s) for s in sigmas])
    levels = levels / max(levels.max(), 1e-8)
    at = len(sigmas) - 1 - levels[::-1].argmax(axis=0)
    out = np.zeros(a.shape, bool)
    for y, x in maxima(levels.max(axis=0), 2, least):
        out |= draw([(y, x)], sigmas[at[y, x]] * 2**0.5) > 0
    return out


def k24(rows, planes):
    got = as_planes(rows, "v")
    for t, a in planes.items():
        hit = blob_disks(a, [1.0, 1.6, 2.4], 0.35)
        medians = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(a, 7, mode="edge"), (15, 15)), axis=(2, 3))
        assert hit.any() and (got[t] == np.where(hit, np.floor(medians), a)).all()


def k24_interpolate(rows, planes):
    got = as_planes(rows, "v")
    for t, a in planes.items():
        hit = blob_disks(a, [1.0, 2.0], 0.5)
        wide = np.zeros(a.shape, bool)
        for y, x in zip(*np.nonzero(hit)):
            for dy in range(-7, 8):
                half = round(math.sqrt(49 - dy * dy))
                if 0 <= y + dy < 50:
                    wide[y + dy, max(x - half, 0) : x + half + 1] = True
        fill = a[wide & ~hit].mean() if (wide & ~hit).any() else a[~hit].mean()
        assert hit.any() and (got[t] == np.where(hit, math.floor(round(fill, 6)), a)).all()


def m8(rows, planes):
    got = as_planes(rows, "label_id")
    for t, a in planes.items():
        assert (got[t] == flood(a, flood_fill(a >= 850, True), a >= 700)).all()


def spots(a, **size):
    response = gauss(a, 4 / 2.3548200450309493) - gauss(a, 6.4 / 2.3548200450309493)
    response = response / max(np.abs(response).max(), 1e-8)
    return response, [p for p in maxima(response, 2, 0.5) if a[p] >= percentile(a, 90)]


def a2(rows, planes):
    same_areas(rows, {t: areas(flood_fill(draw(spots(a)[1], 2) > 0, True)) for t, a in planes.items()})
    for t, a in planes.items():
        response, peaks = spots(a)
        labels = flood_fill(draw(peaks, 2) > 0, True)
        want = {i: max((response[p] for p in peaks if labels[p] == i), default=None) for i in range(1, labels.max() + 1)}
        assert {r.label_id: r.score for r in rows if r.t == t} == pytest.approx(want)


def a2_regions(rows, planes):
    want = {}
    for t, a in planes.items():
        seeds = np.zeros(a.shape, int)
        for i, p in enumerate(spots(a)[1], 1):
            seeds[p] = i
        want[t] = areas(flood_fill(moved_by_disk(flood(a, seeds, a >= 650) > 0, 1, True), True))
    same_areas(rows, want)


def dark(planes, mask):
    out = {}
    for t, a in planes.items():
        parts = flood_fill(homogeneity(a, mask(a), 5, 3) > 0.2, True)
        out[t] = [n for n in areas(parts) if n >= 2]
    return out


def nearly_same_areas(rows, want):
    """Ranks of nearly equal variances may swap, and with them a pixel at the threshold."""
    got = defaultdict(list)
    for r in rows:
        got[r.t].append(r.area_px)
    for t, w in want.items():
        assert abs(sum(got[t]) - sum(w)) <= 2 and abs(len(got[t]) - len(w)) <= 2


def a3(rows, planes):
    nearly_same_areas([r for r in rows if r.t < 3], dark({t: planes[t] for t in range(3)}, lambda a: a >= 300))


def a3_own(rows, planes):
    nearly_same_areas([r for r in rows if r.t < 3], dark({t: planes[t] for t in range(3)}, lambda a: tissue(a, 2, 1, 1.0)))


def a6(rows, planes):
    seen, last = 0, {}
    label_of = {int(i): int(v) for i, v in zip(*pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "label"]).to_pydict().values())}
    for r in sorted(rows, key=lambda r: r.frame):
        a = planes[r.frame]
        ys, xs = np.nonzero(blocks(a) == r.label_id)
        assert (r.area_px, r.bbox_min_row, r.bbox_min_col, r.bbox_max_row, r.bbox_max_col) == (len(ys), ys.min(), xs.min(), ys.max() + 1, xs.max() + 1)
        second = np.array([(label_of[r.frame * 50 + y] * 97 + x * 3 + y) % 4096 for y, x in zip(ys.tolist(), xs.tolist())])
        for c, v in (("ch0", a[ys, xs]), ("ch1", second)):
            assert r[f"mean_intensity_{c}"] == pytest.approx(v.mean()) and r[f"std_intensity_{c}"] == pytest.approx(v.std(), abs=1e-9)
        assert (r.centroid_y_px, r.centroid_x_px, r.area_um2) == pytest.approx((ys.mean(), xs.mean(), len(ys) / 4))
        assert r.delta_area_px == (len(ys) - last[r.label_id] if r.label_id in last else None)
        last[r.label_id] = len(ys)
        seen += 1
    assert seen == sum(len(np.unique(blocks(a)[blocks(a) > 0])) for a in planes.values())


def objects(planes):
    out = {}
    for t, a in planes.items():
        for i in np.unique(blocks(a)[blocks(a) > 0]).tolist():
            ys, xs = np.nonzero(blocks(a) == i)
            out[t, i] = (ys.mean(), xs.mean(), ys.min(), xs.min(), ys.max() + 1, xs.max() + 1)
    return out


def assignment(left, right, distance, boxes=True):
    """The one-to-one links of least total cost by searching through all, one group of competing objects at a time."""
    ok = defaultdict(dict)
    for (i, p), (j, q) in itertools.product(left.items(), right.items()):
        far = math.hypot(p[0] - q[0], p[1] - q[1])
        if far <= distance and (not boxes or (p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])):
            ok[i][j] = far
    out, todo = {}, set(ok)
    while todo:
        group, ends = {todo.pop()}, set()
        while True:
            ends = {j for i in group for j in ok[i]}
            more = {i for i in todo if ends & set(ok[i])}
            if not more:
                break
            group, todo = group | more, todo - more
        best = [math.inf, {}]

        def go(rest, used, cost, chosen):
            if cost >= best[0]:
                return
            if not rest:
                best[:] = [cost, chosen]
                return
            i, *others = rest
            for j in sorted(ok[i], key=ok[i].get):
                if j not in used:
                    go(others, used | {j}, cost + ok[i][j], {**chosen, i: j})
            go(others, used, cost + distance + 1, chosen)

        go(sorted(group), frozenset(), 0.0, {})
        out |= best[1]
    return out, ok


def links_of(planes, distance):
    o, out = objects(planes), {}
    of = lambda t: {i: v for (s, i), v in o.items() if s == t}
    for t in range(len(planes) - 1):
        chosen, ok = assignment(of(t), of(t + 1), distance)
        out |= {(t, i): (t + 1, j, ok[i][j]) for i, j in chosen.items()}
    return o, out


def j13(rows, planes):
    _, want = links_of(planes, 12.0)
    got = {(r.frame_a, r.label_a): (r.frame_b, r.label_b, r.distance) for r in rows}
    assert len(got) == len(rows) == len({v[:2] for v in got.values()}) == len(want)
    assert math.isclose(sum(v[2] for v in got.values()), sum(v[2] for v in want.values()))


def j14(rows, planes):
    o, tp = objects(planes), 0
    found, truth = ({k: v for k, v in o.items() if k[1] % n} for n in (7, 5))
    for t in planes:
        one = lambda d: {i: v for (s, i), v in d.items() if s == t}
        tp += len(assignment(one(truth), one(found), 3.0, boxes=False)[0])
    (r,) = rows
    assert (r.tp, r.fp, r.fn) == (tp, len(found) - tp, len(truth) - tp)
    assert (r.precision, r.recall) == pytest.approx((tp / len(found), tp / len(truth)))


def tracks(planes):
    o, links = links_of(planes, 6.0)
    ends = {v[:2] for v in links.values()}
    out, n = {}, 0
    for head in sorted(o):
        if head not in ends:
            n += 1
            chain = [head]
            while chain[-1] in links:
                chain.append(links[chain[-1]][:2])
            out |= {k: (n if len(chain) >= 2 else None, len(chain)) for k in chain}
    return out


def a7(rows, planes):
    assert {(r.frame, r.label_id): (r.track_id, r.track_length) for r in rows} == tracks(planes)


def a8(rows, planes):
    want = defaultdict(list)
    for (t, _), (track, _) in tracks(planes).items():
        if track is not None:
            want[track].append(t)
    assert [(r.track_id, r.first_frame, r.n) for r in rows] == sorted(((k, min(v), len(v)) for k, v in want.items()), key=lambda x: (x[1], x[0]))


MODELS = {
    "h6_minimum": h6, "s8_folder_scan": s8, "r11_solidity": r11, "k10_nlmeans": k10, "k13_clahe": k13, "k14_wavelet_denoise": k14, "k19_homogeneity": k19, "k20_tissue_mask": k20, "k22_h_maxima": k22,
    "k24_blob_subtract": k24, "k24_blob_interpolate": k24_interpolate, "m8_watershed": m8, "a2_spots": a2, "a2_spot_regions": a2_regions, "a3_dark_regions": a3, "a3_dark_regions_own_tissue": a3_own,
    "a6_full_measurements": a6, "j13_assignment": j13, "j14_detection_score": j14, "a7_tracking": a7, "a8_track_queue": a8,
}


def test_every_query_has_sql_or_a_model():
    assert set(MODELS) == set(ALL) - set(SQL)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_query_equals_its_model(spark, planes, name):
    rows = ALL[name](spark, SF).collect()
    assert rows
    MODELS[name](rows, planes)
