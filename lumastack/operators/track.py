"""Tracks: one-to-one links between frames, chains, crop boxes, galleries, scores."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import dropped, least_reachable, reread, written
from ..functions.grouped import map_groups
from .joins import link_candidates
from .ranks import numbered


#: Track ids count from 1 in each file; these columns, where a table has them, tell equal ids apart.
OWNER = ("source_file", "m", "c")


def _owner(*tables: DataFrame) -> list[str]:
    return [k for k in OWNER if all(k in t.columns for t in tables)]


def crop_boxes(rows: DataFrame, height: int, width: int) -> DataFrame:
    """Each track's union box, widened to three times its size and clipped; boxes under 4 px are the whole frame. Keyed by ``OWNER`` and track_id."""
    keys = [*_owner(rows), "track_id"]
    b = rows.where("track_id IS NOT NULL").groupBy(*keys).agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    b = b.select(
        *keys, F.greatest(F.lit(0), F.col("y0") - h).alias("cy0"), F.greatest(F.lit(0), F.col("x0") - w).alias("cx0"),
        F.least(F.lit(height), F.col("y1") + h).alias("cy1"), F.least(F.lit(width), F.col("x1") + w).alias("cx1"),
    )
    small = (F.col("cy1") - F.col("cy0") < 4) | (F.col("cx1") - F.col("cx0") < 4)
    pick = lambda c, whole: F.when(small, whole).otherwise(F.col(c)).alias(c)
    return b.select(*keys, pick("cy0", 0), pick("cx0", 0), pick("cy1", height), pick("cx1", width))


def gallery_layout(boxes: DataFrame, per_page: int) -> DataFrame:
    """``track_id, page, place, pad_h, pad_w``: the tracks of each owner in order, ``per_page`` to an output, padded to the owner's largest crop."""
    keys = _owner(boxes)
    pads = boxes.groupBy(*keys).agg(F.max(F.col("cy1") - F.col("cy0")).alias("pad_h"), F.max(F.col("cx1") - F.col("cx0")).alias("pad_w"))
    stretch = F.floor(F.col("track_id") / 4096).alias("stretch_")
    ranked = numbered(boxes.select(*keys, "track_id", stretch), keys, ["stretch_"], ["track_id"], name="n").withColumn("n", F.col("n") - 1)
    joined = ranked.join(pads, keys) if keys else ranked.crossJoin(pads)
    return joined.select(*keys, "track_id", F.expr(f"cast(n div {per_page} as int)").alias("page"), F.expr(f"cast(n % {per_page} as int)").alias("place"), "pad_h", "pad_w")


def assign(cost: np.ndarray) -> list[int]:
    """Row -> column of least total cost (rows at most columns), by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[j]:
            used[j] = True
            reduced = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], j
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            owner[j] = owner[came[j]]
            j = came[j]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


PAIR = ["source_file", "m", "c", "frame_a", "frame_b"]


def one_to_one(candidates: DataFrame, distance: float) -> DataFrame:
    """Of the candidate links of each frame pair the one-to-one choice of least total cost; an object left out costs distance + 1.

    Links whose ends have no other candidate stand. The others fall into
    components, as only candidates compete; each is solved by itself, which is
    exact and keeps a task's matrix to one cluster of crowded objects.
    """
    a, b = Window.partitionBy(*PAIR, "label_a"), Window.partitionBy(*PAIR, "label_b")
    marked = candidates.withColumn("lone", (F.count("*").over(a) == 1) & (F.count("*").over(b) == 1))
    alone, crowded = marked.where("lone").drop("lone"), written(marked.where("NOT lone").drop("lone"), "crowded-links")
    if not crowded.limit(1).count():
        return alone
    node = lambda side: F.struct(*PAIR, F.lit(side).alias("side"), F.col(f"label_{side}").alias("label"))
    parts = least_reachable(crowded.select(node("a").alias("a"), node("b").alias("b"))).where("node.side = 'a'")
    keyed = crowded.withColumn("node", node("a")).join(parts, "node").select(*candidates.columns, F.col("label.side").alias("part_side"), F.col("label.label").alias("part"))

    columns = candidates.columns

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf.label_a.unique()), sorted(pdf.label_b.unique())
        at_r, at_c = {k: i for i, k in enumerate(rows)}, {k: i for i, k in enumerate(cols)}
        cost = np.full((len(rows), len(cols)), distance + 1.0)
        for r, c, d in zip(pdf.label_a, pdf.label_b, pdf.distance):
            cost[at_r[r], at_c[c]] = d
        flip = len(rows) > len(cols)
        chosen = {(j, i) if flip else (i, j) for i, j in enumerate(assign(cost.T if flip else cost))}
        keep = [(at_r[r], at_c[c]) in chosen for r, c in zip(pdf.label_a, pdf.label_b)]
        return pdf[keep][columns]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    return alone.unionByName(keyed.groupBy(*PAIR, "part_side", "part").applyInPandas(solve, schema))


def link_objects(rows: DataFrame, max_displacement: float, min_length: int = 2, min_circularity: float | None = None, max_eccentricity: float | None = None) -> DataFrame:
    """Track objects over frames: all rows with ``track_id, track_length``.

    ``rows``: ``source_file, m, c, frame, label_id, cy, cx, y0, x0, y1, x1`` and
    optionally ``circularity, eccentricity``. Nulls pass the filters. Objects of
    consecutive present frames link one to one if near enough and their boxes
    (at least 1 px) overlap. Every frame pair is independent; chains of links
    are tracks. Ids count from 1 over (m, c, first frame, label); tracks shorter
    than ``min_length`` lose their id but keep their length; objects of a group
    with a single frame, and filtered ones, have neither.
    """
    ok = F.lit(True)
    if min_circularity is not None:
        ok = ok & (F.col("circularity").isNull() | (F.col("circularity") >= min_circularity))
    if max_eccentricity is not None:
        ok = ok & (F.col("eccentricity").isNull() | (F.col("eccentricity") <= max_eccentricity))
    group = ["source_file", "m", "c"]
    fit = rows.where(ok)
    frames = fit.groupBy(*group).agg(F.count_distinct("frame").alias("n_")).where("n_ > 1").select(*group)
    fit = fit.join(frames, group, "left_semi").withColumns({"y1": F.greatest("y1", F.col("y0") + 1), "x1": F.greatest("x1", F.col("x0") + 1)})
    links = one_to_one(link_candidates(fit, max_displacement), max_displacement)
    heads = chain_heads(links)
    object_ = [*group, "frame", "label_id"]
    own = fit.select(*object_).join(heads, object_, "left").select(*object_, F.coalesce("head_frame", "frame").alias("head_frame"), F.coalesce("head_label", "label_id").alias("head_label"))
    own = written(own, "chains")
    tracks = own.groupBy(*group, "head_frame", "head_label").agg(F.count("*").alias("track_length"))
    ids = numbered(tracks, ["source_file"], ["m", "c"], ["head_frame"], ["head_label"])
    told = own.join(ids, [*group, "head_frame", "head_label"]).select(*object_, F.when(F.col("track_length") >= min_length, F.col("nth")).alias("track_id"), "track_length")
    return rows.join(told, object_, "left")


#: Frames whose links are followed within one task before pointers are doubled by joins.
STRIDE = 32


def chain_heads(links: DataFrame) -> DataFrame:
    """The first object of the chain that each linked object is in: ``source_file, m, c, frame, label_id, head_frame, head_label``.

    Links are one to one, so chains are lists and need no components: each
    object points to the one before it. Within a stretch of STRIDE frames
    tasks follow the pointers to the stretch's end. Then a round points each
    object to where its own points, so distances double, and a chain over n
    stretches takes log2 n rounds of one join; objects whose pointer has
    reached a head are set aside.
    """
    group = ["source_file", "m", "c"]
    links = written(links.select(*group, "frame_a", "label_a", "frame_b", "label_b"), "track-links")
    back = links.select(*group, F.col("frame_b").alias("frame"), F.col("label_b").alias("label_id"), F.col("frame_a").alias("head_frame"), F.col("label_a").alias("head_label"))

    def follow(rows: pa.Table, number: np.ndarray) -> pa.Table:
        ends = [np.stack([number, rows[f].to_numpy(), rows[k].to_numpy()], axis=1) for f, k in (("frame", "label_id"), ("head_frame", "head_label"))]
        _, code = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
        own, to = np.split(code.ravel(), 2)
        row_of = np.full(int(code.max()) + 1, -1)
        row_of[own] = np.arange(len(own))
        at = np.where(row_of[to] >= 0, row_of[to], np.arange(len(own)))
        while not np.array_equal(further := at[at], at):
            at = further
        return rows.select([*group, "frame", "label_id"]).append_column("head_frame", rows["head_frame"].take(pa.array(at))).append_column("head_label", rows["head_label"].take(pa.array(at)))

    cut = back.withColumn("stretch_", F.floor(F.col("frame") / STRIDE))
    form = ", ".join(f"{c} {back.schema[c].dataType.simpleString()}" for c in back.columns)
    short = map_groups(cut, [*group, "stretch_"], [], follow, form)
    object_ = [*group, "frame", "label_id"]
    firsts = links.select(*group, F.col("frame_a").alias("frame"), F.col("label_a").alias("label_id")).join(reread(links).select(*group, F.col("frame_b").alias("frame"), F.col("label_b").alias("label_id")), object_, "left_anti")
    there = written(firsts.withColumns({"head_frame": F.col("frame"), "head_label": F.col("label_id"), "done": F.lit(True)}).unionByName(short.withColumn("done", F.lit(False))), "chain-heads")
    made, found, going = [there], [there.where("done")], there.where("NOT done")
    while going.limit(1).count():
        known = functools.reduce(DataFrame.unionByName, [reread(t).where("done") for t in made], reread(made[-1]).where("NOT done"))
        ahead = known.select(*group, F.col("frame").alias("head_frame"), F.col("label_id").alias("head_label"), F.col("head_frame").alias("far_frame"), F.col("head_label").alias("far_label"), F.col("done").alias("far_done"))
        moved = going.join(ahead, [*group, "head_frame", "head_label"]).select(*object_, F.col("far_frame").alias("head_frame"), F.col("far_label").alias("head_label"), F.col("far_done").alias("done"))
        made.append(written(moved, "chain-heads"))
        found.append(made[-1].where("done"))
        going = made[-1].where("NOT done")
    out = written(functools.reduce(DataFrame.unionByName, found).drop("done"), "chain-heads")
    dropped(links, *made)
    return out


def track_queue(tracked: DataFrame) -> DataFrame:
    """Tracks of each owner by first frame, then id."""
    keys = _owner(tracked)
    return tracked.where("track_id IS NOT NULL").groupBy(*keys, "track_id").agg(F.min("frame").alias("first_frame"), F.count("*").alias("n")).orderBy(*keys, "first_frame", "track_id")


def gallery(rgb: DataFrame, boxes: DataFrame, members: DataFrame, tile: int = 64) -> DataFrame:
    """Crops of each track in its own frames: ``track_id, t, y, x, r, g, b`` in crop coordinates, with the owner's columns.

    Boxes are cut along a grid of tiles, so that a pixel meets the boxes that
    reach into its own tile, not all those of its frame.
    """
    keys = _owner(rgb, boxes, members)
    near = members.join(boxes, [*keys, "track_id"]).select(*keys, "t", "track_id", "cy0", "cx0", "cy1", "cx1").where("cy1 > cy0 AND cx1 > cx0")
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile)))
    near = near.withColumn("ty_", cut("cy0", "cy1")).withColumn("tx_", cut("cx0", "cx1"))
    cells = rgb.withColumns({"ty_": F.floor(F.col("y") / tile), "tx_": F.floor(F.col("x") / tile)})
    hit = cells.join(near, [*keys, "t", "ty_", "tx_"]).where("y >= cy0 AND y < cy1 AND x >= cx0 AND x < cx1")
    return hit.select(*keys, "track_id", "t", (F.col("y") - F.col("cy0")).alias("y"), (F.col("x") - F.col("cx0")).alias("x"), "r", "g", "b")


def gallery_pages(rgb: DataFrame, labels: DataFrame, boxes: DataFrame, members: DataFrame, per_page: int, per_row: int, blank: tuple[int, int, int] = (0, 0, 0), highlight: bool = True, alpha: float = 0.55) -> DataFrame:
    """Pages of track crops: ``page, t, y, x, r, g, b`` with the owner's columns.

    Tracks go ``per_page`` to a page and ``per_row`` to a row, each into a cell
    of the owner's largest crop, its crop in the cell's upper left corner. What
    a crop doesn't fill, cells of a last page without a track, and the cells
    of tracks that aren't in a frame are ``blank``. A page has all times at
    which one of its tracks is there. With ``highlight`` the track's own
    object (``labels``: ``t, y, x, track_id``) is blended with its colour.
    """
    from .point import PALETTE

    keys = _owner(rgb, boxes, members)
    own = labels.select(*[k for k in keys if k in labels.columns], "t", "y", "x", F.col("track_id").alias("own_"))
    on = [k for k in own.columns if k != "own_"]
    marked = rgb.join(own, on, "left") if highlight else rgb.withColumn("own_", F.lit(None).cast("long"))
    crops = gallery(marked.withColumn("b", F.struct("b", "own_")), boxes, members)
    colours = F.array(*[F.array(*map(F.lit, c)) for c in PALETTE])
    of = F.element_at(colours, ((F.col("track_id") - 1) % len(PALETTE) + 1).cast("int"))
    blend = lambda v, i: F.when(F.col("own_") == F.col("track_id"), F.floor(F.round(v * (1 - alpha) + of[i] * alpha, 6)).cast("int")).otherwise(v)
    crops = crops.withColumns({"own_": F.col("b.own_"), "b": F.col("b.b")}).withColumns({"r": blend(F.col("r"), 0), "g": blend(F.col("g"), 1), "b": blend(F.col("b"), 2)})
    layout = gallery_layout(boxes, per_page)
    corner = {"oy_": F.expr(f"place div {per_row}") * F.col("pad_h"), "ox_": F.col("place") % per_row * F.col("pad_w")}
    cells = layout.withColumns(corner)
    placed = crops.join(cells, [*keys, "track_id"]).select(*keys, "page", "t", (F.col("y") + F.col("oy_")).cast("int").alias("y"), (F.col("x") + F.col("ox_")).cast("int").alias("x"), "r", "g", "b")
    rows = -(-per_page // per_row)
    times = members.join(cells, [*keys, "track_id"]).select(*keys, "page", "t", "pad_h", "pad_w").distinct()
    sheet = times.withColumn("y", F.explode(F.expr(f"sequence(0, cast({rows} * pad_h as int) - 1)"))).withColumn("x", F.explode(F.expr(f"sequence(0, cast({per_row} * pad_w as int) - 1)")))
    full = sheet.drop("pad_h", "pad_w").join(placed, [*keys, "page", "t", "y", "x"], "left")
    return full.select(*keys, "page", "t", "y", "x", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in zip("rgb", blank)])


def detection_score(found: DataFrame, truth: DataFrame, gate: float) -> DataFrame:
    """One-to-one matches within ``gate`` of ``frame, label_id, cy, cx``: ``tp, fp, fn, precision, recall``."""
    box = {k: v for k, v in (("y0", F.col("cy") - gate), ("x0", F.col("cx") - gate), ("y1", F.col("cy") + gate), ("x1", F.col("cx") + gate))}
    side = lambda d, f: d.select(F.lit("s").alias("source_file"), F.col("frame").alias("m"), F.lit("c").alias("c"), F.lit(f).alias("frame"), "label_id", "cy", "cx").withColumns(box)
    links = one_to_one(link_candidates(side(truth, 0).unionByName(side(found, 1)), gate), gate)
    sums = links.agg(F.count("*").alias("tp")).crossJoin(found.agg(F.count("*").alias("nf"))).crossJoin(truth.agg(F.count("*").alias("nt")))
    return sums.select(
        "tp", (F.col("nf") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"),
        F.when(F.col("nf") > 0, F.col("tp") / F.col("nf")).otherwise(0.0).alias("precision"), F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0).alias("recall"),
    )
