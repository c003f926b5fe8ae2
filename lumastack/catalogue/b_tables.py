"""Sources, sinks, joins, object tables, sorts and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import SQL_MEAS, SQL_PX, SQL_PX2, SQL_PXZ, frames, frames_two_channels, frames_with_depth, measurements, table
from ..operators import joins, measure, select
from ..registry import map_frames, query
from ..sources import stacks
from .a_points import KEYS, PIX, PX, PX2, PXZ

MEAS = f"WITH {SQL_MEAS}"
LAB = PX + ", lab AS (SELECT *, (y // 10) * 4 + x // 16 + 1 label_id FROM px WHERE v >= 600)"


def blocks(spark, sf):
    """Pixels of at least 600 with the block of the plane they lie in as their label."""
    return frames(spark, sf).where("v >= 600").withColumn("label_id", F.expr("cast((y div 10) * 4 + x div 16 + 1 as int)"))


def scratch(spark, name):
    """A new folder of its own for a sink's output, in the shared folder."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s4_materialise", PX2 + f" SELECT {PIX}, v FROM px2")
def s4(spark, sf):
    path = scratch(spark, "stack")
    stacks.write_frames(frames_two_channels(spark, sf), path)
    return spark.read.parquet(path).select("source_file", F.col("m").cast("int").alias("m"), "t", "z", "c", "y", "x", "v")


@query("s5_page_addressing", "SELECT o_orderkey, CAST(o_orderkey // 6 AS INT) t, CAST(o_orderkey // 2 % 3 AS INT) z, CAST(o_orderkey % 2 AS INT) c FROM orders")
def s5(spark, sf):
    t, z, c = stacks.page_keys(F.col("o_orderkey"), 3, 2)
    return table(spark, sf, "orders").select("o_orderkey", t.alias("t"), z.alias("z"), c.alias("c"))


@query("s6_dimension_order", PX + ", f AS (SELECT (t * 50 + y) * 64 + x i, v FROM px) SELECT CAST(i // 16000 AS INT) t, CAST(i // 1600 % 10 AS INT) z, CAST(i // 800 % 2 AS INT) c, CAST(i // 40 % 20 AS INT) y, CAST(i % 40 AS INT) x, v FROM f")
def s6(spark, sf):
    flat = frames(spark, sf).select(((F.col("t") * 50 + F.col("y")) * 64 + F.col("x")).alias("i"), "v")
    n_t = -(-((flat.agg(F.max("i")).first()[0] or 0) + 1) // 16_000)
    return stacks.assign_dimensions(flat, "TZCYX", {"T": n_t, "Z": 10, "C": 2, "Y": 20, "X": 40}, open_end=True)


@query("s7_colour_channels", PX + " SELECT t, y, x, u.c, CAST(CASE u.c WHEN 'red' THEN v WHEN 'green' THEN v // 2 ELSE v % 256 END AS INT) v FROM px, (VALUES ('red'), ('green'), ('blue')) u(c)")
def s7(spark, sf):
    return stacks.colour_channels(frames(spark, sf).select("t", "y", "x", F.col("v").alias("r"), F.expr("cast(v div 2 as int)").alias("g"), (F.col("v") % 256).alias("b")))


@query("s8_folder_scan")
def s8(spark, sf):
    return stacks.scan_folder(spark, sf, [".parquet"]).orderBy("name")


CATALOG = "cat AS (SELECT s_name source_file, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey % 4 END n_c, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 1000 END pixel_size_um, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 10::DOUBLE END z_step_um FROM supplier)"


@query("s9_metadata_record", f"WITH {CATALOG} SELECT source_file, coalesce(n_c, 1) n_c, coalesce(pixel_size_um, 1.0::DOUBLE) pixel_size_um, coalesce(z_step_um, 1.0::DOUBLE) z_step_um, list_transform(range(greatest(coalesce(n_c, 1), 1)), lambda i: 'Ch' || i) channel_names FROM cat")
def s9(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_name").alias("source_file"), F.expr("nullif(s_nationkey % 4, 0)").alias("n_c"), F.expr("if(s_suppkey % 3 = 0, null, s_acctbal / 1000)").alias("pixel_size_um"),
        F.expr("if(s_suppkey % 2 = 0, cast(s_suppkey as double) / 10, null)").alias("z_step_um"), F.array().cast("array<string>").alias("channel_names"),
    )
    return stacks.metadata_record(s)


@query("s10_flat_index", PXZ + " SELECT t, z, y, x, (t * 2 + z) * 50 + y flat FROM pxz")
def s10(spark, sf):
    return frames_with_depth(spark, sf).select("t", "z", "y", "x", stacks.flat_index([F.col("t"), F.col("z"), F.col("y")], [1, 2, 50]).alias("flat"))


@query("s11_metadata_fallback", """WITH e AS (SELECT n_name source_file, n_nationkey k, n_nationkey % 3 + 1 n_m FROM nation), s AS (SELECT 'NATION_' || s_nationkey source_file, count(*) FILTER (s_acctbal > 5000) p, count(*) r FROM supplier GROUP BY 1)
 SELECT e.source_file, CASE WHEN p >= n_m THEN 'stage_xy:planned' WHEN r >= n_m THEN 'stage_xy:readback' WHEN r > 0 THEN 'partial:' || r || '/' || n_m || ':readback' ELSE 'missing' END source, CAST(coalesce(CASE WHEN p >= n_m THEN p ELSE r END, 0) AS INT) n_positions FROM e LEFT JOIN s USING (source_file)""")
def s11(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("source_file"), F.col("s_suppkey").alias("m"), F.col("s_acctbal").alias("x"), (-F.col("s_acctbal")).alias("y"))
    n = table(spark, sf, "nation").select(F.col("n_name").alias("source_file"), (F.col("n_nationkey") % 3 + 1).alias("n_m"))
    return stacks.stage_positions(s.where("x > 5000"), s, n)


@query("s12_sidecar_reuse", "WITH s AS (SELECT o_orderkey path, o_orderdate mtime FROM orders), c AS (SELECT o_orderkey path, o_orderdate - INTERVAL (o_custkey % 3 - 1) DAY mtime, o_orderkey % 2 + 1 AS ver FROM orders WHERE o_orderkey % 5 > 0), ok AS (SELECT c.path FROM c JOIN s USING (path) WHERE ver = 2 AND c.mtime >= s.mtime) SELECT path, CASE WHEN path IN (SELECT path FROM ok) THEN 'cached' ELSE 'read' END how FROM s")
def s12(spark, sf):
    o = table(spark, sf, "orders")
    sources = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    cached = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("path"), F.expr("cast(o_orderdate as timestamp) - make_interval(0, 0, 0, cast(o_custkey % 3 - 1 as int))").alias("mtime"), (F.col("o_orderkey") % 2 + 1).alias("version"))
    fresh, again = stacks.refresh_catalog(sources, cached, 2)
    return fresh.select("path", F.lit("cached").alias("how")).union(again.select("path", F.lit("read").alias("how")))


@query("s13_source_fingerprint", "SELECT doc_id, substr(sha256(n_chars || '|' || doc_id || '|' || left(text, 64) || '|' || right(text, 64)), 1, 16) fingerprint FROM documents")
def s13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", stacks.source_fingerprint(F.col("n_chars"), F.col("doc_id"), F.left("text", F.lit(64)), F.right("text", F.lit(64))).alias("fingerprint"))


@query("s14_frame_fingerprint", PX + ", r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY y, x) - 1 i, count(*) OVER (PARTITION BY t) n FROM px), h AS (SELECT * FROM r WHERE i < 256 OR (i >= (n - 256) // 2 AND i < (n - 256) // 2 + 256) OR i >= n - 256) "
       f"SELECT h.source_file, h.m, h.t, h.z, h.c, substr(sha256(any_value(e.s) || ':' || string_agg(v, ',' ORDER BY i)), 1, 16) fingerprint FROM h JOIN (SELECT t, (max(y) + 1) || 'x' || (max(x) + 1) s FROM px GROUP BY 1) e ON h.t = e.t GROUP BY ALL")
def s14(spark, sf):
    return stacks.probe_fingerprint(frames(spark, sf))


@query("s15_full_fingerprint", PX + f" SELECT {KEYS}, sha256(string_agg(v, ',' ORDER BY y, x)) fingerprint FROM px GROUP BY ALL")
def s15(spark, sf):
    return stacks.full_fingerprint(frames(spark, sf))


@query("s16_csv_sink", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s16(spark, sf):
    rows, path = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), scratch(spark, "csv")
    stacks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("s17_batch_csv", "SELECT 'a' source_file, p_partkey k, p_size extra_a, NULL::DOUBLE extra_b FROM part UNION ALL SELECT 'b', s_suppkey, NULL, s_acctbal FROM supplier")
def s17(spark, sf):
    a = table(spark, sf, "part").select(F.lit("a").alias("source_file"), F.col("p_partkey").alias("k"), F.col("p_size").alias("extra_a"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("source_file"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("extra_b"))
    path = scratch(spark, "batch")
    stacks.write_batch_csv([a, b], path)
    return spark.read.option("header", True).schema("k long, extra_a int, extra_b double, source_file string").csv(path)


@query("s18_label_stack", LAB + " SELECT t, y, x, label_id, m FROM lab")
def s18(spark, sf):
    path = scratch(spark, "labels")
    stacks.write_labels(blocks(spark, sf).select("t", "y", "x", "label_id", "m"), path)
    return spark.read.parquet(path)


@query("s19_label_export", LAB + " SELECT t, y, x, label_id, c FROM lab")
def s19(spark, sf):
    path = scratch(spark, "labels")
    stacks.write_labels(blocks(spark, sf).select("t", "y", "x", "label_id", "c"), path, ["c"])
    return spark.read.parquet(path)


@query("s20_processed_export", PX2 + f", b AS (SELECT c, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi FROM px2 GROUP BY 1) SELECT {PIX}, CAST(floor(greatest(0, least(1, (v - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))) * 255) AS INT) v FROM px2 JOIN b USING (c)")
def s20(spark, sf):
    from ..operators.point import export_rescale

    path = scratch(spark, "export")
    stacks.write_frames(export_rescale(frames_two_channels(spark, sf)), path)
    return spark.read.parquet(path).select("source_file", F.col("m").cast("int").alias("m"), "t", "z", "c", "y", "x", "v")


@query("s21_depth_stack_export", PXZ + " SELECT source_file, m, t, z, c, y - 10 y, x - 8 x, v FROM pxz WHERE m = 0 AND y >= 10 AND y < 30 AND x >= 8 AND x < 40")
def s21(spark, sf):
    path = scratch(spark, "depth")
    stacks.write_frames(select.crop(frames_with_depth(spark, sf).where("m = 0"), 8, 10, 32, 20), path)
    return spark.read.parquet(path).select("source_file", F.col("m").cast("int").alias("m"), "t", "z", "c", "y", "x", "v")


@query("s22_frame_naming", "SELECT o_orderkey, 'img_t' || lpad(CAST(o_orderkey % 120 + 1 AS VARCHAR), 3, '0') || '_c' || (o_custkey % 3 + 1) name FROM orders")
def s22(spark, sf):
    axes = {"t": (F.col("o_orderkey") % 120, F.lit(120)), "z": (F.lit(0), F.lit(1)), "c": (F.col("o_custkey") % 3, F.lit(3))}
    return table(spark, sf, "orders").select("o_orderkey", stacks.frame_name(F.lit("img"), axes).alias("name"))


@query("s25_stage_json", "SELECT o_custkey stage, count(*) n, CAST(max(o_orderkey) AS BIGINT) last_key FROM orders GROUP BY 1")
def s25(spark, sf):
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("stage")).agg(F.to_json(F.struct(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))).alias("summary"))
    back = stored.select("stage", F.from_json("summary", "n long, last_key long").alias("s"))
    return back.select("stage", "s.n", "s.last_key")


@query("j1_mask_intensity", LAB.replace(SQL_PX, SQL_PX2) + " SELECT lab.t, lab.label_id, px2.c, count(*) n, round(avg(px2.v), 6) mean_v FROM lab JOIN px2 ON lab.t = px2.t AND lab.y = px2.y AND lab.x = px2.x GROUP BY ALL")
def j1(spark, sf):
    lab = blocks(spark, sf).select("m", "t", "y", "x", "label_id")
    return lab.join(frames_two_channels(spark, sf), ["m", "t", "y", "x"]).groupBy("t", "label_id", "c").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("j2_voxel_lookup", LAB + ", a AS (SELECT t, label_id, count(*) area FROM lab GROUP BY 1, 2) SELECT t, label_id, CASE WHEN label_id % 2 = 0 THEN area + t ELSE area * 5 END voxels FROM a")
def j2(spark, sf):
    a = blocks(spark, sf).groupBy("t", "label_id").agg(F.count("*").alias("area"))
    known = a.where("label_id % 2 = 0").select("t", "label_id", (F.col("area") + F.col("t")).alias("n"))
    return a.join(known, ["t", "label_id"], "left").select("t", "label_id", F.coalesce("n", F.col("area") * 5).alias("voxels"))


SIZES = "sizes AS (SELECT CAST(n_nationkey AS INT) file_idx, CAST(n_nationkey % 4 + 1 AS INT) n FROM nation), sp AS (SELECT file_idx, CAST(l AS INT) local_idx FROM (SELECT file_idx, unnest(range(n)) l FROM sizes))"


def sizes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("file_idx"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("n"))


@query("j3_chain_mapping", PX + f", {SIZES}, ch AS (SELECT CAST(row_number() OVER (ORDER BY file_idx DESC, local_idx) - 1 AS INT) out_idx, file_idx, local_idx FROM sp), p AS (SELECT t // 4 file_idx, t % 4 t, y, x, v FROM px) SELECT out_idx t, y, x, v FROM p JOIN ch ON p.file_idx = ch.file_idx AND p.t = ch.local_idx")
def j3(spark, sf):
    parts = frames(spark, sf).select(F.expr("cast(t div 4 as int)").alias("file_idx"), (F.col("t") % 4).alias("t"), "y", "x", "v")
    return joins.apply_chain(parts, joins.chain_map(sizes(spark, sf), "desc"))


for _order, _by in {"asc": "file_idx, local_idx", "desc": "file_idx DESC, local_idx", "interleaved": "local_idx, file_idx"}.items():

    @query(f"j4_chain_map_{_order}", f"WITH {SIZES} SELECT CAST(row_number() OVER (ORDER BY {_by}) - 1 AS INT) out_idx, file_idx, local_idx FROM sp")
    def j4(spark, sf, order=_order):
        return joins.chain_map(sizes(spark, sf), order)


@query("j5_chain_validation", f"WITH {SIZES}, ch AS (SELECT CAST(o_orderkey AS INT) out_idx, CAST(o_custkey % 30 AS INT) file_idx, CAST(o_orderkey % 5 AS INT) local_idx FROM orders) SELECT out_idx, file_idx, local_idx FROM ch LEFT JOIN sizes USING (file_idx) WHERE n IS NULL OR local_idx >= n")
def j5(spark, sf):
    ch = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("out_idx"), (F.col("o_custkey") % 30).cast("int").alias("file_idx"), (F.col("o_orderkey") % 5).cast("int").alias("local_idx"))
    return joins.chain_faults(ch, sizes(spark, sf))


@query("j6_shape_mismatch", "SELECT 'n_m' axis, count(DISTINCT n_regionkey) n_values FROM nation HAVING count(DISTINCT n_regionkey) > 1 UNION ALL SELECT 'n_c', count(DISTINCT n_nationkey * 0) FROM nation HAVING count(DISTINCT n_nationkey * 0) > 1")
def j6(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n_t"), F.col("n_regionkey").alias("n_m"), (F.col("n_nationkey") * 0).alias("n_c"))
    return joins.axis_mismatches(n, ["n_t", "n_m", "n_c"], "n_t")


@query("j7_combined_metadata", f"WITH {SIZES}, ch AS (SELECT row_number() OVER (ORDER BY local_idx, file_idx) - 1 out_idx, file_idx, local_idx FROM sp), r AS (SELECT out_idx, file_idx * 3.5::DOUBLE + local_idx pos, 'f' || file_idx AS name FROM ch), d AS (SELECT *, abs(pos - lag(pos) OVER (ORDER BY out_idx)) step FROM r) SELECT count(*) n, round(avg(step), 6) mean_step, string_agg(name || '=' || CAST(CAST(round(pos * 10) AS INT) AS VARCHAR), ',' ORDER BY out_idx) listed FROM d")
def j7(spark, sf):
    ch = joins.chain_map(sizes(spark, sf), "interleaved")
    cat = ch.select("file_idx", "local_idx", (F.col("file_idx") * F.lit(3.5) + F.col("local_idx")).alias("pos"), F.concat(F.lit("f"), F.col("file_idx").cast("string")).alias("name"))
    listed = F.concat_ws(",", F.transform("entries", lambda e: F.concat(e["name"], F.lit("="), F.round(e["pos"] * 10).cast("int").cast("string"))))
    return joins.combined_metadata(ch, cat).select("n", F.round("mean_step", 6).alias("mean_step"), listed.alias("listed"))


#: Patterns without lookahead: "not followed by a letter" is "a digit, then no letter or the end". Fixed values.
NAME_SQL = [(r"count\d+", "T"), (r"time\d+", "T"), (r"t\d([^a-z]|$)", "T"), (r"zstack\d+", "Z"), (r"z\d([^a-z]|$)", "Z"), (r"pos\d+", "M"), (r"m\d([^a-z]|$)", "M"), (r"p\d([^a-z]|$)", "M"), (r"channel\w+", "C"), (r"ch\d+", "C"), (r"c\d([^a-z]|$)", "C")]


@query(
    "j8_axis_suggestion",
    "WITH n AS (SELECT lower(regexp_extract(url, '[^/]*$')) u FROM pages), h AS (SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(u, '{p}')) h{i}" for i, (p, _) in enumerate(NAME_SQL)) + " FROM n) SELECT CASE " + " ".join(f"WHEN h{i} >= 2 THEN '{a}'" for i, (_, a) in enumerate(NAME_SQL)) + " END axis FROM h",
)
def j8(spark, sf):
    return joins.suggest_axis(table(spark, sf, "pages"), "url")


@query("j11_nearest_detection", LAB + ", r AS (SELECT t, label_id lid, avg(y) cy, avg(x) cx FROM lab GROUP BY 1, 2), d AS (SELECT t, y * 64 + x i, y, x, v score FROM px WHERE v >= 800) SELECT r.t, lid, score FROM r JOIN d USING (t) QUALIFY row_number() OVER (PARTITION BY r.t, lid ORDER BY round((cy - y) * (cy - y) + (cx - x) * (cx - x), 6), i) = 1")
def j11(spark, sf):
    r = blocks(spark, sf).groupBy("t", F.col("label_id").alias("lid")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    d = frames(spark, sf).where("v >= 800").select("t", (F.col("y") * 64 + F.col("x")).alias("i"), "y", "x", F.col("v").alias("score"))
    return joins.nearest(r, d, ["t"], "i", "score").select("t", "lid", "score")


OBJ = LAB + ", ob AS (SELECT t frame, label_id, avg(y) cy, avg(x) cx, min(y) y0, min(x) x0, max(y) + 1 y1, max(x) + 1 x1 FROM lab GROUP BY 1, 2)"


def objects(spark, sf):
    return blocks(spark, sf).groupBy("source_file", "m", "c", F.col("t").alias("frame"), "label_id").agg(
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1")
    )


@query("j12_link_candidates", OBJ + " SELECT a.frame frame_a, a.label_id label_a, b.frame frame_b, b.label_id label_b, round(sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2), 6) distance FROM ob a JOIN ob b ON b.frame = a.frame + 1 WHERE sqrt((a.cy - b.cy) ** 2 + (a.cx - b.cx) ** 2) <= 6 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1")
def j12(spark, sf):
    return joins.link_candidates(objects(spark, sf), 6.0).select("frame_a", "label_a", "frame_b", "label_b", F.round("distance", 6).alias("distance"))


@query("j15_tracked_channels", "SELECT DISTINCT event_type c FROM events WHERE user_id % 3 > 0")
def j15(spark, sf):
    rows = table(spark, sf, "events").withColumn("track_id", F.expr("nullif(user_id % 3, 0)"))
    return rows.where("track_id IS NOT NULL").select(F.col("event_type").alias("c")).distinct().orderBy("c")


@query("j16_track_decisions", "WITH e AS (SELECT event_id, nullif(user_id % 7, 0) track_id FROM events) SELECT track_id, event_id, CASE WHEN track_id IN (2, 3) THEN 'accepted' END track_validation FROM e WHERE track_id IS NULL OR track_id NOT IN (1, 4)")
def j16(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("nullif(user_id % 7, 0)").alias("track_id"), "event_id")
    d = table(spark, sf, "nation").where("n_nationkey BETWEEN 1 AND 4").select(F.col("n_nationkey").cast("long").alias("track_id"), F.expr("if(n_nationkey IN (1, 4), 'rejected', 'accepted')").alias("status"))
    return joins.without_rejected(rows, d)


@query("j17_pending_work", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(spark, sf):
    return joins.pending(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("j18_config_diff", "WITH a AS (SELECT p_name || p_partkey k, p_size v FROM part WHERE p_partkey % 5 > 0), b AS (SELECT p_name || p_partkey k, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END v FROM part WHERE p_partkey % 4 > 0) SELECT coalesce(a.k, b.k) AS key, a.v AS before, b.v AS after, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v")
def j18(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("value"))
    b = p.where("p_partkey % 4 > 0").withColumn("value", F.expr("if(p_partkey % 7 = 0, null, value)"))
    return joins.config_diff(p.where("p_partkey % 5 > 0"), b)


@query("r7_regions", LAB + f" SELECT {KEYS}, label_id, count(*) area_px, round(avg(y), 6) centroid_y_px, round(avg(x), 6) centroid_x_px, min(y) bbox_min_row, min(x) bbox_min_col, max(y) + 1 bbox_max_row, max(x) + 1 bbox_max_col, round(avg(v), 6) mean_intensity, min(v) min_intensity, max(v) max_intensity FROM lab GROUP BY ALL")
def r7(spark, sf):
    r = measure.regions(blocks(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("centroid_y_px", "centroid_x_px", "mean_intensity")})


@query("r8_channel_intensities", LAB.replace(SQL_PX, SQL_PX2) + " SELECT lab.source_file, lab.m, lab.t, lab.z, lab.c segmentation_channel, label_id, " + ", ".join(f"round(avg(px2.v) FILTER (px2.c = '{c}'), 6) mean_intensity_{c}, round(stddev_pop(px2.v) FILTER (px2.c = '{c}'), 4) std_intensity_{c}" for c in ("ch0", "ch1")) + " FROM lab JOIN px2 ON lab.t = px2.t AND lab.y = px2.y AND lab.x = px2.x GROUP BY ALL")
def r8(spark, sf):
    r = measure.channel_intensities(blocks(spark, sf), frames_two_channels(spark, sf), ["ch0", "ch1"])
    return r.withColumns({c: F.round(c, 6 if c.startswith("mean") else 4) for c in r.columns if "intensity" in c})


@query("r9_perimeter", LAB + """, inn AS (SELECT a.t, a.label_id, a.y, a.x FROM lab a JOIN lab b ON a.t = b.t AND a.label_id = b.label_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(*) = 4),
 bo AS (SELECT t, label_id, y, x FROM lab EXCEPT SELECT t, label_id, y, x FROM inn),
 co AS (SELECT a.t, a.label_id, a.y, a.x, sum(CASE WHEN a.y = b.y AND a.x = b.x THEN 1 WHEN a.y = b.y OR a.x = b.x THEN 2 ELSE 10 END) code FROM bo a JOIN bo b ON a.t = b.t AND a.label_id = b.label_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
 SELECT t, label_id, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) perimeter FROM co GROUP BY ALL""")
def r9(spark, sf):
    return measure.perimeter(blocks(spark, sf), ["t", "label_id"]).withColumn("perimeter", F.round("perimeter", 6))


@query("r10_eccentricity", LAB + ", q AS (SELECT t, label_id, var_pop(y) + 1 / 12::DOUBLE a, var_pop(x) + 1 / 12::DOUBLE b, covar_pop(y, x) k FROM lab GROUP BY ALL) SELECT t, label_id, round(sqrt(greatest(0, round(1 - ((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + k * k)) / ((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + k * k)), 9))), 5) eccentricity FROM q")
def r10(spark, sf):
    return measure.moments(blocks(spark, sf), ["t", "label_id"]).withColumn("eccentricity", F.round("eccentricity", 5))


@query("r11_solidity")
def r11(spark, sf):
    return measure.solidity(blocks(spark, sf), ["t", "label_id"])


@query("r12_volume", LAB + ", a AS (SELECT t, label_id, count(*) area FROM lab GROUP BY 1, 2) SELECT t, label_id, round(CASE WHEN label_id % 2 = 0 THEN area + t ELSE area * 5 END * (0.5 * 0.5 * 2.0::DOUBLE), 6) volume_um3 FROM a")
def r12(spark, sf):
    a = blocks(spark, sf).groupBy("t", "label_id").agg(F.count("*").alias("area"))
    v = F.when(F.col("label_id") % 2 == 0, F.col("area") + F.col("t"))
    return a.select("t", "label_id", F.round(measure.volume(F.col("area"), v, 0.5, 2.0, 5), 6).alias("volume_um3"))


@query("r14_summary", MEAS + " SELECT count(*) n_objects, count(DISTINCT frame) n_frames, round(avg(area_px), 4) mean_area_px, round(stddev_pop(area_px), 4) std_area_px, round(avg(area_px * 0.25::DOUBLE), 4) mean_area_um2, round(stddev_pop(area_px * 0.25::DOUBLE), 4) std_area_um2 FROM meas")
def r14(spark, sf):
    s = measure.summary(measurements(spark, sf), 0.5)
    return s.withColumns({c: F.round(c, 4) for c in s.columns if c.startswith(("mean", "std"))})


@query("r15_per_frame", MEAS + ", s AS (SELECT unnest(range(greatest(200, (SELECT max(frame) + 1 FROM meas)))) frame) SELECT CAST(s.frame AS INT) frame, count(area_px) n, round(coalesce(avg(area_px), 0), 6) mean_area FROM s LEFT JOIN meas USING (frame) GROUP BY 1")
def r15(spark, sf):
    most = table(spark, sf, "events").groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    return measure.per_frame(measurements(spark, sf), spark.range(max(200, most)).select(F.col("id").cast("int").alias("frame"))).withColumn("mean_area", F.round("mean_area", 6))


@query("r16_results_summary", MEAS + ", w AS (SELECT frame, area_px, CASE WHEN area_px % 3 > 0 THEN area_px / 7::DOUBLE END a, area_px / 11::DOUBLE b FROM meas) SELECT u.col AS name, round(avg(CASE u.col WHEN 'mean_intensity_a' THEN a ELSE b END), 6) mean_value FROM w, (VALUES ('mean_intensity_a'), ('mean_intensity_b')) u(col) GROUP BY 1")
def r16(spark, sf):
    w = measurements(spark, sf).select(F.expr("if(area_px % 3 > 0, area_px / 7, null)").alias("mean_intensity_a"), (F.col("area_px") / 11).alias("mean_intensity_b"))
    return w.unpivot([], ["mean_intensity_a", "mean_intensity_b"], "name", "value").groupBy("name").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query("r17_background", PX + f" SELECT {KEYS}, round(avg(v), 6) background_mean, round(stddev_pop(v), 6) background_std FROM px WHERE v < 600 GROUP BY ALL")
def r17(spark, sf):
    b = measure.background_stats(frames(spark, sf), blocks(spark, sf))
    return b.withColumns({c: F.round(c, 6) for c in ("background_mean", "background_std")})


@query("r18_track_length", MEAS + " SELECT event_id, nullif(label_id % 5, 0) track_id, CASE WHEN label_id % 5 > 0 THEN count(*) OVER (PARTITION BY label_id % 5) END track_length FROM meas")
def r18(spark, sf):
    rows = measurements(spark, sf).select("event_id", F.expr("nullif(label_id % 5, 0)").alias("track_id"))
    n = rows.where("track_id IS NOT NULL").groupBy("track_id").agg(F.count("*").alias("track_length"))
    return rows.join(n, "track_id", "left").select("event_id", "track_id", "track_length")


BOX = OBJ + ", b AS (SELECT label_id track_id, min(y0) y0, min(x0) x0, max(y1) y1, max(x1) x1 FROM ob GROUP BY 1), g AS (SELECT track_id, greatest(0, y0 - (y1 - y0)) cy0, greatest(0, x0 - (x1 - x0)) cx0, least(50, y1 + (y1 - y0)) cy1, least(64, x1 + (x1 - x0)) cx1 FROM b), crops AS (SELECT track_id, CASE WHEN small THEN 0 ELSE cy0 END cy0, CASE WHEN small THEN 0 ELSE cx0 END cx0, CASE WHEN small THEN 50 ELSE cy1 END cy1, CASE WHEN small THEN 64 ELSE cx1 END cx1 FROM (SELECT *, cy1 - cy0 < 4 OR cx1 - cx0 < 4 small FROM g))"


@query("r19_track_crop_box", BOX + " SELECT * FROM crops")
def r19(spark, sf):
    from ..operators.track import crop_boxes

    return crop_boxes(objects(spark, sf).withColumn("track_id", F.col("label_id")), 50, 64).drop("source_file", "m", "c")


@query("r20_gallery_layout", BOX + " SELECT track_id, CAST((row_number() OVER (ORDER BY track_id) - 1) // 6 AS INT) page, CAST((row_number() OVER (ORDER BY track_id) - 1) % 6 AS INT) place, max(cy1 - cy0) OVER () pad_h, max(cx1 - cx0) OVER () pad_w FROM crops")
def r20(spark, sf):
    from ..operators.track import crop_boxes, gallery_layout

    return gallery_layout(crop_boxes(objects(spark, sf).withColumn("track_id", F.col("label_id")), 50, 64), 6).drop("source_file", "m", "c")


LATENCY = """WITH r AS (SELECT event_type event, value / 1000 ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 i, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL)
 SELECT event, max(n) n, round(avg(ms), 9) mean_ms, max(ms) FILTER (i = n // 2) p50_ms, max(ms) FILTER (i = least(n - 1, CAST(floor(n * 0.99) AS BIGINT))) p99_ms, round(1000 / avg(ms), 3) fps FROM r GROUP BY 1"""


@query("r21_latency_summary", LATENCY)
def r21(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("event"), F.col("value").alias("duration_us"))
    return measure.latency_summary(log).withColumns({"mean_ms": F.round("mean_ms", 9), "fps": F.round("fps", 3)})


@query("r22_rollup_report", MEAS + " SELECT source_file, m, segmentation_channel, count(*) n_objects, round(avg(area_px), 6) mean_area FROM meas GROUP BY ROLLUP (source_file, m, segmentation_channel)")
def r22(spark, sf):
    return measurements(spark, sf).rollup("source_file", "m", "segmentation_channel").agg(F.count("*").alias("n_objects"), F.round(F.avg("area_px"), 6).alias("mean_area"))


@query("w1_object_deltas", MEAS + " SELECT event_id, area_px, area_px - lag(area_px) OVER (PARTITION BY source_file, m, segmentation_channel, label_id ORDER BY frame) delta_area_px FROM meas")
def w1(spark, sf):
    return measure.deltas(measurements(spark, sf)).select("event_id", "area_px", "delta_area_px")


@query("o1_sort_nulls_last", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice END price FROM orders")
def o1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr("if(o_custkey % 4 = 0, null, o_totalprice)").alias("price")).orderBy(F.col("price").asc_nulls_last())


@query("o2_canonical_order", MEAS + " SELECT segmentation_channel, label_id, frame, area_px FROM meas")
def o2(spark, sf):
    return measurements(spark, sf).select("segmentation_channel", "label_id", "frame", "area_px").orderBy("segmentation_channel", "label_id", "frame")


@query("o3_even_frames", PX + f", k AS (SELECT DISTINCT i * (SELECT max(t) FROM px) // 2 t FROM range(3) r(i)) SELECT {PIX}, v FROM px JOIN k USING (t)")
def o3(spark, sf):
    return select.even_frames(frames(spark, sf), 3)


@query("u1_append_rows", "SELECT 'a' source_file, s_suppkey k, s_acctbal a, NULL::INT b FROM supplier UNION ALL SELECT 'b', n_nationkey, NULL, n_regionkey FROM nation")
def u1(spark, sf):
    a = table(spark, sf, "supplier").select(F.lit("a").alias("source_file"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("a"))
    b = table(spark, sf, "nation").select(F.lit("b").alias("source_file"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").alias("b"))
    return stacks.union_rows([a, b])


@query("u2_mask_algebra", PX + " SELECT 'and' op, t, y, x FROM px WHERE v >= 600 AND x < 32 UNION ALL SELECT 'or', t, y, x FROM px WHERE v >= 600 OR x < 32 UNION ALL SELECT 'not', t, y, x FROM px WHERE NOT v >= 600")
def u2(spark, sf):
    px = frames(spark, sf).select("t", "y", "x", "v")
    a, b = px.where("v >= 600").drop("v"), px.where("x < 32").drop("v")
    parts = {"and": a.intersect(b), "or": a.union(b).distinct(), "not": px.drop("v").join(a, ["t", "y", "x"], "left_anti")}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("op"), "t", "y", "x")
        out = rows if out is None else out.union(rows)
    return out


@query("u3_column_difference", "SELECT 'removed' side, p_type || '/' || p_brand AS name FROM (SELECT p_type, p_brand FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_type, p_brand FROM part WHERE p_partkey % 2 = 1) UNION ALL SELECT 'added', p_type || '/' || p_brand FROM (SELECT p_type, p_brand FROM part WHERE p_partkey % 2 = 1 EXCEPT ALL SELECT p_type, p_brand FROM part WHERE p_partkey % 2 = 0)")
def u3(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_type", "p_brand").alias("name"))
    a, b = p.where("p_partkey % 2 = 0").select("name"), p.where("p_partkey % 2 = 1").select("name")
    return a.exceptAll(b).select(F.lit("removed").alias("side"), "name").union(b.exceptAll(a).select(F.lit("added").alias("side"), "name"))


@query("x4_map_frames", PX + f" SELECT {KEYS}, count(*) n, max(v) - min(v) AS span FROM px GROUP BY ALL")
def x4(spark, sf):
    def span(pdf):
        out = pdf.iloc[:1][["source_file", "m", "t", "z", "c"]].copy()
        out["n"], out["span"] = len(pdf), int(pdf.v.max() - pdf.v.min())
        return out

    return map_frames(frames(spark, sf), span, "source_file string, m int, t int, z int, c string, n long, span int")


