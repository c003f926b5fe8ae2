"""Binary morphology, connected components, hysteresis, holes, watershed."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import dropped, reread, written
from ..functions.grouped import map_groups
from ..model import FRAME

AT = [*FRAME, "y", "x"]


def _dealt(pixels: DataFrame, halo: int, tile: int) -> DataFrame:
    """Each pixel with the tiles ``ty, tx`` whose core it is at most ``halo`` away from: nearly always one."""
    tiles = lambda k: F.explode(F.sequence(F.floor((F.col(k) - halo) / tile).cast("int"), F.floor((F.col(k) + halo) / tile).cast("int")))
    return pixels.withColumn("ty", tiles("y")).withColumn("tx", tiles("x"))


def within(on: np.ndarray, r: int, ellipse: bool = False) -> np.ndarray:
    """Where the squared distance to the nearest set cell is at most r squared, in two passes whatever r is.

    The first gives each cell's distance g to the nearest set cell of its
    column. A set column at distance g covers sqrt(r^2 - g^2) cells to either
    side along the row; the second adds these stretches' ends and sums them up.
    With ``ellipse`` the stretches are rounded instead of cut to whole cells.
    """
    h, w = on.shape
    rows, far = np.arange(h)[:, None], 2 * (h + r + 1)
    above = np.maximum.accumulate(np.where(on, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(on, rows, far + h)[::-1], axis=0)[::-1]
    g = np.minimum(rows - above, below - rows)
    y, x = np.nonzero(g <= r)
    half = np.array([round(math.sqrt(r * r - d * d)) if ellipse else math.isqrt(r * r - d * d) for d in range(r + 1)])[g[y, x]]
    ends = np.zeros((h, w + 1), dtype=np.int32)
    np.add.at(ends, (y, np.maximum(x - half, 0)), 1)
    np.add.at(ends, (y, np.minimum(x + half + 1, w)), -1)
    return np.cumsum(ends, axis=1)[:, :w] > 0


def morphology(mask: DataFrame, steps: str, r: int, height: int | None = None, width: int | None = None, tile: int = 256, ellipse: bool = False) -> DataFrame:
    """Dilations (``d``) and erosions (``e``) of a mask by a disk, one after another in one pass over tiles.

    Beyond a plane of a given size nothing is mask for a dilation and all is
    for an erosion; without a size planes have no end. A tile's halo is r for
    each step, so a pixel goes to its own tile and, near its border, to the
    next; a task holds one tile, cut to the plane if its size is given.
    """
    halo = r * len(steps)
    side = tile + 2 * halo
    ends = [None if n is None else (0, n) for n in (height, width)]
    types = ", ".join(f"{k} {mask.schema[k].dataType.simpleString()}" for k in FRAME)

    def cut(at: int, end: tuple[int, int] | None) -> tuple[int, int]:
        low = at * tile - halo
        return (low, low + side) if end is None else (max(low, end[0]), min(low + side, end[1]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        (y0, y1), (x0, x1) = cut(ty, ends[0]), cut(tx, ends[1])
        if y0 >= y1 or x0 >= x1:
            return pd.DataFrame(columns=[*FRAME, "y", "x"])
        on = np.zeros((y1 - y0, x1 - x0), dtype=bool)
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        seen = (y >= y0) & (y < y1) & (x >= x0) & (x < x1)
        on[y[seen] - y0, x[seen] - x0] = True
        for s in steps:
            on = within(on, r, ellipse) if s == "d" else ~within(~on, r, ellipse)
        core_y, core_x = max(ty * tile - y0, 0), max(tx * tile - x0, 0)
        y, x = np.nonzero(on[core_y : (ty + 1) * tile - y0, core_x : (tx + 1) * tile - x0])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in FRAME}, "y": (y + y0 + core_y).astype(np.int32), "x": (x + x0 + core_x).astype(np.int32)})

    return _dealt(mask.select(*AT), halo, tile).groupBy(*FRAME, "ty", "tx").applyInPandas(run, f"{types}, y int, x int")


def dilate(mask: DataFrame, r: int, height: int | None = None, width: int | None = None, tile: int = 256) -> DataFrame:
    """Pixels within a disk of the mask, clipped to the plane if its size is given."""
    return morphology(mask, "d", r, height, width, tile)


def erode(mask: DataFrame, r: int, height: int | None = None, width: int | None = None, tile: int = 256) -> DataFrame:
    """Pixels whose whole disk lies in the mask; with a plane size, what lies beyond the plane counts as mask."""
    return morphology(mask, "e", r, height, width, tile)


def opening(mask: DataFrame, r: int, height: int, width: int, tile: int = 256) -> DataFrame:
    return morphology(mask, "ed", r, height, width, tile)


def closing(mask: DataFrame, r: int, height: int, width: int, tile: int = 256) -> DataFrame:
    return morphology(mask, "de", r, height, width, tile)


def _least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least one that it is connected to by the pairs ``a, b``: hook the larger root to the smaller, then shorten all paths, until nothing is left to hook."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _touching_runs(y: np.ndarray, x: np.ndarray, eight: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of pixels in raster order: each pixel's run, and the pairs of runs that touch across two rows."""
    if not len(y):
        return (np.zeros(0, dtype=np.int64),) * 3
    fresh = np.concatenate([[True], (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)])
    run = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(y)]]) - 1
    reach = 1 if eight else 0
    wide = int(x.max() - x.min()) + 5
    row, start, end = y[first].astype(np.int64) * wide, x[first] - int(x.min()) + 2, x[last] - int(x.min()) + 2
    lo = np.searchsorted(row + end, row - wide + start - reach)
    hi = np.searchsorted(row + start, row - wide + end + reach, side="right")
    n = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(len(first)), n)
    above = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return run, above, below


def _local_labels(y: np.ndarray, x: np.ndarray, eight: bool) -> np.ndarray:
    """Index of the least connected pixel (in the given raster order) of each pixel of one tile."""
    run, above, below = _touching_runs(y, x, eight)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    return first[_least_connected(len(first), above, below)][run]


def components(mask: DataFrame, eight: bool = True, tile: int = 256) -> DataFrame:
    """Connected components: ``..., y, x, label_id``, numbered from 1 in raster order of their first pixels in each plane.

    Tiles are labelled one to a task, by runs of pixels. Then squares of 2 x 2
    tiles are merged, then of 4 x 4, and so on: a merge sees only the rims of
    its four parts, tells which labels became which, and passes on its own
    rim. A plane of any size is thus spread over tasks that hold a tile or
    the rims of four squares.
    """
    cells = mask.select(*AT, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name not in ("ty", "tx"))

    def local(rows: pa.Table, tile_number: np.ndarray) -> pa.Table:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        # a free row between tiles keeps their pixels apart
        first = _local_labels(tile_number * (tile + 1) + y % tile, x % tile, eight)
        return rows.drop(["ty", "tx"]).append_column("fy", pa.array(y[first], pa.int32())).append_column("fx", pa.array(x[first], pa.int32()))

    tiled = written(map_groups(cells, [*FRAME, "ty", "tx"], ["y", "x"], local, f"{types}, fy int, fx int"), "tile-labels")
    span = tiled.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).first()
    changes, side = None, tile
    if span.y0 is not None:
        origin = span.y0 // tile * tile, span.x0 // tile * tile
        rim = _rim(tiled, side, origin)
    while span.y0 is not None and max(span.y1 - origin[0], span.x1 - origin[1]) >= side:
        side *= 2
        merged = written(_merged(rim, side, origin, eight, types), "tile-merges")
        change = merged.where("gy IS NOT NULL").select(*FRAME, "fy", "fx", "gy", "gx")
        if changes is None:
            changes = change
        else:  # what became (gy, gx) before may have become something else now
            later = change.select(*FRAME, F.col("fy").alias("gy"), F.col("fx").alias("gx"), F.col("gy").alias("hy"), F.col("gx").alias("hx"))
            on = changes.join(later.hint("merge"), [*FRAME, "gy", "gx"], "left").select(*FRAME, "fy", "fx", F.coalesce("hy", "gy").alias("gy"), F.coalesce("hx", "gx").alias("gx"))
            changes = on.unionByName(change)
        rim = merged.where("gy IS NULL").select(*AT, "fy", "fx")
    if changes is not None:
        tiled = tiled.join(changes.hint("merge"), [*FRAME, "fy", "fx"], "left").select(*AT, F.coalesce("gy", "fy").alias("fy"), F.coalesce("gx", "fx").alias("fx"))
    firsts = tiled.where("y = fy AND x = fx").select(*FRAME, "fy", "fx")
    ids = firsts.withColumn("label_id", F.row_number().over(Window.partitionBy(*FRAME).orderBy("fy", "fx")))
    return tiled.select(*AT, "fy", "fx").join(ids.hint("merge"), [*FRAME, "fy", "fx"]).select(*AT, "label_id")


def _rim(labelled: DataFrame, side: int, origin: tuple[int, int]) -> DataFrame:
    """The pixels on the border of squares of that side."""
    edge = lambda k, o: ((F.col(k) - o) % side).isin(0, side - 1)
    return labelled.where(edge("y", origin[0]) | edge("x", origin[1]))


def _merged(rim: DataFrame, side: int, origin: tuple[int, int], eight: bool, types: str) -> DataFrame:
    """Merge labels that touch within squares of that side. Rows with ``gy, gx`` tell what a label became, the others are the squares' own rim under its new labels."""

    def merge(rows: pa.Table, square_number: np.ndarray) -> pa.Table:
        y, x = rows["y"].to_numpy().astype(np.int64), rows["x"].to_numpy().astype(np.int64)
        v, w = (y - origin[0]) % side, (x - origin[1]) % side
        labels, at, label = np.unique(np.stack([square_number, rows["fy"].to_numpy(), rows["fx"].to_numpy()], axis=1), axis=0, return_index=True, return_inverse=True)
        label = label.ravel()
        run, above, below = _touching_runs(square_number * (side + 1) + v, w, eight)
        some, same = label[np.flatnonzero(np.diff(run, prepend=-1))], np.diff(run) == 0
        # runs that touch, and neighbours in a run that come from two tiles
        least = _least_connected(len(labels), np.concatenate([some[above], label[:-1][same]]), np.concatenate([some[below], label[1:][same]]))
        moved = np.flatnonzero(least != np.arange(len(labels)))
        outer = np.flatnonzero((v == 0) | (v == side - 1) | (w == 0) | (w == side - 1))
        take = np.concatenate([at[moved], outer])
        new = labels[np.concatenate([least[moved], least[label[outer]]])]
        is_change = np.arange(len(take)) < len(moved)
        keys = rows.select(FRAME).take(pa.array(take))
        pixel = lambda k: pa.array(k[take], pa.int32(), mask=is_change)
        old = lambda i: np.where(is_change, rows[i].to_numpy()[take], new[:, 1 if i == "fy" else 2])
        became = lambda i: pa.array(new[:, i], pa.int32(), mask=~is_change)
        columns = [*keys.columns, pixel(y), pixel(x), pa.array(old("fy"), pa.int32()), pa.array(old("fx"), pa.int32()), became(1), became(2)]
        return pa.table(columns, names=[*AT, "fy", "fx", "gy", "gx"])

    square = [F.floor((F.col(k) - o) / side).cast("int").alias(t) for k, t, o in (("y", "ty", origin[0]), ("x", "tx", origin[1]))]
    return map_groups(rim.select("*", *square), [*FRAME, "ty", "tx"], ["y", "x"], merge, f"{types}, fy int, fx int, gy int, gx int")


def relabel(labels: DataFrame) -> DataFrame:
    """Contiguous ids from 1 in each plane, in the order of the old ones."""
    return labels.withColumn("label_id", F.dense_rank().over(Window.partitionBy(*FRAME).orderBy("label_id")))


def hysteresis(permissive: DataFrame, strict: DataFrame, tile: int = 256) -> DataFrame:
    """Permissive pixels 4-connected to a strict pixel."""
    labels = components(permissive, eight=False, tile=tile)
    seeded = labels.join(strict.select(*AT).hint("merge"), AT, "left_semi").select(*FRAME, "label_id").distinct()
    return labels.join(seeded, [*FRAME, "label_id"], "left_semi").select(*AT)


def by_size(labels: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Components of at least ``least`` and at most ``most`` pixels (0: any)."""
    n = F.count("*").over(Window.partitionBy(*FRAME, "label_id"))
    keep = labels.withColumn("n_", n).where(F.col("n_") >= least)
    return (keep.where(F.col("n_") <= most) if most else keep).drop("n_")


def complement(mask: DataFrame, plane: DataFrame) -> DataFrame:
    return plane.select(*AT).join(mask.select(*AT).hint("merge"), AT, "left_anti")


def background_mask(labels: DataFrame, plane: DataFrame) -> DataFrame:
    """The complement of the objects as label 1."""
    return complement(labels, plane).withColumn("label_id", F.lit(1))


def fill_holes(mask: DataFrame, plane: DataFrame, most: int | None = None, tile: int = 256, height: int | None = None, width: int | None = None) -> DataFrame:
    """Add holes: components of the complement below ``most`` pixels (4-connected), or, without it, those that don't touch the plane's border.

    The border is that of a plane of the given size, also where a plane has
    fewer pixels; without a size it is where the plane's own pixels end.
    """
    holes = components(complement(mask, plane), eight=False, tile=tile)
    if most is not None:
        n = F.count("*").over(Window.partitionBy(*FRAME, "label_id"))
        inner = holes.withColumn("n_", n).where(F.col("n_") < most)
    else:
        if height is None or width is None:
            size = plane.groupBy(*FRAME).agg(F.max("y").alias("h_"), F.max("x").alias("w_"))
            sized = holes.join(size, FRAME)
        else:
            sized = holes.withColumns({"h_": F.lit(height - 1), "w_": F.lit(width - 1)})
        edge = sized.where("y = 0 OR x = 0 OR y = h_ OR x = w_").select(*FRAME, "label_id").distinct()
        inner = holes.join(edge, [*FRAME, "label_id"], "left_anti")
    return mask.select(*AT).union(inner.select(*AT))


def spatial_cleanup(mask: DataFrame, plane: DataFrame, height: int, width: int, open_r: int = 0, close_r: int = 0, holes: int = 0, least: int = 0, most: int = 0) -> DataFrame:
    """Open, close, fill holes, drop small, drop large, in this order; 0 leaves a step out."""
    if open_r:
        mask = opening(mask, open_r, height, width)
    if close_r:
        mask = closing(mask, close_r, height, width)
    if holes:
        mask = fill_holes(mask, plane, holes)
    if least or most:
        mask = by_size(components(mask, eight=False), least, most)
    return mask.select(*AT)


def grow(mask: DataFrame, r: int, height: int, width: int) -> DataFrame:
    """Dilate and label anew."""
    return components(dilate(mask, r, height, width))


#: The eight directions in which a tile has neighbours.
_SIDES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
#: So many tables of rounds are read beside each other before they are made one.
_VERSIONS = 6


def _strip(dy: int, dx: int, tile: int, inner: bool) -> tuple:
    """Index of the cells of a (tile + 2)^2 array along one side: the core's last ones, or the halo's."""
    at = lambda d: slice(1, tile + 1) if d == 0 else (1 if inner else 0) if d < 0 else (tile if inner else tile + 1)
    return at(dy), at(dx)


def _settle_tiles(state: DataFrame, values: Sequence[str], settle, tile: int, settled: list[int] | None = None) -> DataFrame:
    """Repeat a local fixpoint over tiles until no pixel changes; ``state`` has ``y, x`` and the values.

    First every tile settles as far as its own pixels and a rim of one allow.
    What changed along a side is sent to the tile beyond it, and only tiles
    that are sent something settle again. So work goes on at the frontier
    only, and rounds are counted in tiles, not in pixels. A tile is one row
    with its values as a packed array; a task holds one tile, which is no wider
    than the planes need. ``settle`` takes and gives arrays by value, NaN where
    there is none. ``settled`` gets the number of tiles of each round.
    """
    ends = state.agg(F.least(F.min("y"), F.min("x")), F.greatest(F.max("y"), F.max("x"))).first()
    if ends[0] is not None and ends[0] >= 0:
        tile = min(tile, ends[1] + 1)
    types = ", ".join(f"{k} {state.schema[k].dataType.simpleString()}" for k in FRAME)
    form = f"{types}, ty int, tx int, dy int, dx int, cells binary"
    shape = (len(values), tile + 2, tile + 2)
    pack = lambda a: zlib.compress(np.ascontiguousarray(a).tobytes(), 1)
    unpack = lambda b: np.frombuffer(zlib.decompress(b))

    def rows(keys: dict, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        out = [{**keys, "dy": None, "dx": None, "cells": pack(after)}]
        for dy, dx in _SIDES:
            at = (slice(None), *_strip(dy, dx, tile, inner=True))
            if not np.array_equal(before[at], after[at], equal_nan=True):
                out.append({**keys, "ty": keys["ty"] + dy, "tx": keys["tx"] + dx, "dy": -dy, "dx": -dx, "cells": pack(after[at])})
        return pd.DataFrame(out, columns=[*FRAME, "ty", "tx", "dy", "dx", "cells"]).astype({"dy": "Int32", "dx": "Int32"})

    def settled_rows(keys: dict, before: np.ndarray, now: np.ndarray) -> pd.DataFrame:
        after = settle(dict(zip(values, now)))
        return rows(keys, before, np.stack([after[v] for v in values]))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = {k: pdf[k].iloc[0] for k in [*FRAME, "ty", "tx"]}
        y, x = pdf.y.to_numpy() - keys["ty"] * tile + 1, pdf.x.to_numpy() - keys["tx"] * tile + 1
        if not ((y > 0) & (y <= tile) & (x > 0) & (x <= tile)).any():
            return pd.DataFrame(columns=[*FRAME, "ty", "tx", "dy", "dx", "cells"])
        cells = np.full(shape, np.nan)
        for i, v in enumerate(values):
            cells[i, y, x] = pdf[v].to_numpy(dtype=float, na_value=np.nan)
        return settled_rows(keys, cells, cells)

    def again(tiles: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(tiles) or not len(sent):
            return pd.DataFrame(columns=[*FRAME, "ty", "tx", "dy", "dx", "cells"])
        before = unpack(tiles.cells.iloc[0]).reshape(shape)
        now = before.copy()
        for dy, dx, cells in zip(sent.dy, sent.dx, sent.cells):
            at = (slice(None), *_strip(int(dy), int(dx), tile, inner=False))
            now[at] = unpack(cells).reshape(now[at].shape)
        return settled_rows({k: tiles[k].iloc[0] for k in [*FRAME, "ty", "tx"]}, before, now)

    place = [*FRAME, "ty", "tx"]

    def latest(tables: list[DataFrame]) -> DataFrame:
        both = None
        for number, t in enumerate(tables):
            tiles = t.where("dy IS NULL").select(*place, "cells", F.lit(number).alias("round_"))
            both = tiles if both is None else both.unionAll(tiles)
        return both.groupBy(*place).agg(F.max_by("cells", "round_").alias("cells"))

    tables = [written(_dealt(state.select(*AT, *values), 1, tile).groupBy(*place).applyInPandas(first, form), "settle")]
    home = written(tables[0].where("dy IS NULL").select(*place), "settle-tiles")
    while True:
        if settled is not None:
            settled.append(tables[-1].where("dy IS NULL").count())
        sent = reread(tables[-1]).where("dy IS NOT NULL").join(home, place, "left_semi")
        if not sent.limit(1).count():
            break
        if len(tables) >= _VERSIONS:
            whole = written(latest(tables).select(*place, F.lit(None).cast("int").alias("dy"), F.lit(None).cast("int").alias("dx"), "cells"), "settle")
            dropped(*tables[:-1])
            tables = [whole, tables[-1]]
        wanted = reread(tables[-1]).where("dy IS NOT NULL").select(*place).distinct()
        current = latest([t.join(wanted, place, "left_semi") for t in tables])
        tables.append(written(current.groupBy(*place).cogroup(sent.groupBy(*place)).applyInPandas(again, form), "settle"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                cells = unpack(row.cells).reshape(shape)[:, 1:-1, 1:-1]
                y, x = np.nonzero(~np.isnan(cells[0]))
                yield pd.DataFrame({**{k: getattr(row, k) for k in FRAME}, "y": (y + row.ty * tile).astype(np.int32), "x": (x + row.tx * tile).astype(np.int32), **{v: cells[i, y, x] for i, v in enumerate(values)}})

    dropped(home)
    out = written(latest(tables).mapInPandas(spread, f"{types}, y int, x int" + "".join(f", {v} double" for v in values)), "settled")
    dropped(*tables)
    return out


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    out = np.full_like(a, np.nan)
    h, w = a.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = a[max(-dy, 0) : h - max(dy, 0), max(-dx, 0) : w - max(dx, 0)]
    return out


def watershed(pixels: DataFrame, seeds: DataFrame, mask: DataFrame, bright: bool = True, tile: int = 256, settled: list[int] | None = None) -> DataFrame:
    """Labels of the seeds flooded over the mask: each pixel joins a seed that it is reached from over the lowest pass.

    First heights: a pixel's is the least, over all 4-connected ways from a
    seed, of the highest value on the way. Then labels: a pixel takes the
    smallest label among those neighbours that its height can come from; seeds
    keep theirs. Both settle to one result, whatever the tiles. Bright objects
    flood downwards from their peaks.
    """
    cost = (-F.col("v") if bright else F.col("v")).cast("double")
    ground = pixels.join(mask.select(*AT).hint("merge"), AT, "left_semi").select(*AT, cost.alias("g"))
    marks = seeds.select(*AT, F.col("label_id").cast("double").alias("s"))
    state = written(ground.join(marks.hint("merge"), AT, "left").select(*AT, "g", F.when(F.col("s").isNotNull(), F.col("g")).alias("h"), "s"), "flood")
    four = ((-1, 0), (1, 0), (0, -1), (0, 1))

    def rise(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g, h = a["g"], a["h"]
        while True:
            low = np.fmin.reduce([_shifted(h, dy, dx) for dy, dx in four])
            new = np.where(np.isnan(g), np.nan, np.fmin(h, np.maximum(low, g)))
            if np.array_equal(new, h, equal_nan=True):
                return {**a, "h": h}
            h = new

    def name(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g, h, lab, seed = a["g"], a["h"], a["l"], ~np.isnan(a["s"])
        ways = [np.maximum(_shifted(h, dy, dx), g) == h for dy, dx in four]
        while True:
            near = np.fmin.reduce([np.where(way, _shifted(lab, dy, dx), np.nan) for way, (dy, dx) in zip(ways, four)])
            new = np.where(seed, lab, np.fmin(lab, near))
            if np.array_equal(new, lab, equal_nan=True):
                return {**a, "l": lab}
            lab = new

    high = _settle_tiles(state, ["g", "h", "s"], rise, tile, settled)
    flooded = _settle_tiles(high.withColumn("l", F.col("s")), ["g", "h", "s", "l"], name, tile)
    dropped(state, high)
    return flooded.where(~F.isnan("l") & F.col("l").isNotNull()).select(*AT, F.col("l").cast("int").alias("label_id"))


def h_maxima(pixels: DataFrame, h: float, bright: bool = True, tile: int = 256, settled: list[int] | None = None) -> DataFrame:
    """Seeds: pixels that rise at least h above the pass to anything higher: v at least h above its reconstruction from v - h.

    The reconstruction rises to the least of a neighbour's level and the pixel's
    own value (8 neighbours) until nothing changes.
    """
    value = F.col("v").cast("double") * (1 if bright else -1)
    state = written(pixels.select(*AT, value.alias("g"), (value - h).alias("r")), "rise")

    def settle(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        g, r = a["g"], a["r"].copy()
        while True:
            top = r
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    top = np.fmax(top, _shifted(r, dy, dx))
            new = np.where(np.isnan(g), np.nan, np.minimum(g, top))
            if np.array_equal(new, r, equal_nan=True):
                return {"g": g, "r": r}
            r = new

    risen = _settle_tiles(state, ["g", "r"], settle, tile, settled)
    dropped(state)
    return risen.where(F.col("g") - F.col("r") >= h - 1e-9).select(*AT)


#: Least circularity of the symmetry settings. Fixed values.
SYMMETRY = {"all": 0.0, "more": 0.45, "medium": 0.65, "less": 0.80}


def symmetry_gate(labels: DataFrame, setting: str) -> DataFrame:
    """Drop objects whose circularity (clipped to 1) is below the setting's floor."""
    from .measure import perimeter
    from .point import circularity

    by = [*FRAME, "label_id"]
    area = labels.groupBy(*by).agg(F.count("*").alias("a"))
    shape = area.join(perimeter(labels, by), by).where(circularity(F.col("a"), F.col("perimeter"), clip=True) >= SYMMETRY[setting])
    return labels.join(shape.select(*by), by, "left_semi")


def rasterise_disks(centres: DataFrame, height: int, width: int) -> DataFrame:
    """Disks of radius max(1, round(r)) around centroids ``y, x, r, label_id``; the larger label wins."""
    r = F.greatest(F.lit(1), F.bround("r", 0).cast("int"))
    cy, cx = F.bround("y", 0).cast("int"), F.bround("x", 0).cast("int")
    c = centres.select(*FRAME, "label_id", r.alias("r_"), cy.alias("cy"), cx.alias("cx"))
    c = c.withColumn("dy", F.explode(F.expr("sequence(-r_, r_)"))).withColumn("dx", F.explode(F.expr("sequence(-r_, r_)"))).where("dy * dy + dx * dx <= r_ * r_")
    at = c.select(*FRAME, (F.col("cy") + F.col("dy")).alias("y"), (F.col("cx") + F.col("dx")).alias("x"), "label_id")
    return at.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).groupBy(*AT).agg(F.max("label_id").alias("label_id"))
