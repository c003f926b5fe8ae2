"""Selections, point operators, thresholds, colour and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SQL_PX, SQL_PX2, SQL_PXZ, SQL_QTY, frames, frames_two_channels, frames_with_depth, quantities, table
from ..operators import hist, point, project, select
from ..registry import query

PX, PX2, PXZ = f"WITH {SQL_PX}", f"WITH {SQL_PX2}", f"WITH {SQL_PXZ}"
KEYS = "source_file, m, t, z, c"
PIX = KEYS + ", y, x"
ROWS = ["source_file", "m", "t", "z", "c", "y", "x", "v"]


@query("entry_bright_pixels", PX + """, h AS (SELECT t, v, count(*) n FROM px GROUP BY 1, 2),
 c AS (SELECT t, v, sum(n) OVER (PARTITION BY t ORDER BY v) / sum(n) OVER (PARTITION BY t) cdf FROM h), p AS (SELECT t, min(v) hi FROM c WHERE cdf >= 0.95 GROUP BY 1),
 b AS (SELECT px.* FROM px JOIN p USING (t) WHERE v >= hi)
 SELECT s.t, count(b.v) n_pixels, round(avg(b.v), 6) mean_v, round(avg(b.y), 6) centroid_y, round(avg(b.x), 6) centroid_x FROM (SELECT DISTINCT t FROM px) s LEFT JOIN b USING (t) GROUP BY 1""")
def entry_bright_pixels(spark, sf):
    px = frames(spark, sf)
    bright = point.percentile_threshold(px, "above", high=95)
    spine = px.select("t").distinct()
    return spine.join(bright, "t", "left").groupBy("t").agg(
        F.count("v").alias("n_pixels"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.avg("y"), 6).alias("centroid_y"), F.round(F.avg("x"), 6).alias("centroid_x")
    )


@query("s1_plane_scan", PX2 + f" SELECT {PIX}, v FROM px2 WHERE c = 'ch1' AND m = 0 AND t = 3 AND z = 0")
def s1(spark, sf):
    return select.plane(frames_two_channels(spark, sf), c="ch1", m=0, t=3, z=0)


@query("s2_channel_series", PXZ + f" SELECT source_file, m, CAST((t - 1) // 2 AS INT) t, 0 z, c, y, x, max(v) v FROM pxz WHERE c = 'ch0' AND t >= 1 AND t < 19 AND (t - 1) % 2 = 0 GROUP BY ALL")
def s2(spark, sf):
    return select.series(frames_with_depth(spark, sf), "ch0", t_start=1, t_end=19, t_stride=2)


@query("s3_all_channels", PX2 + f" SELECT source_file, m, t, 0 z, c, y, x, min(v) v FROM px2 WHERE m = 0 GROUP BY ALL")
def s3(spark, sf):
    return project.z_project(select.plane(frames_two_channels(spark, sf), m=0), "min")


@query("f1_time_range", PX + f" SELECT source_file, m, CAST((t - 2) // 3 AS INT) t, z, c, y, x, v FROM px WHERE t >= 2 AND t < 9 AND (t - 2) % 3 = 0")
def f1(spark, sf):
    return select.time_range(frames(spark, sf), 2, 9, 3)


@query("f2_depth_range", PXZ + f" SELECT {PIX}, v FROM pxz WHERE z >= 1 AND z < 5")
def f2(spark, sf):
    return select.depth_range(frames_with_depth(spark, sf), 1, 5)


@query("f3_subset", PX + f", k AS (SELECT t old, CAST(row_number() OVER (ORDER BY t) - 1 AS INT) t FROM (SELECT DISTINCT t FROM px WHERE t IN (7, 2, 4, 900))) SELECT source_file, m, k.t, z, c, y, x, v FROM px JOIN k ON px.t = k.old")
def f3(spark, sf):
    return select.subset(frames(spark, sf), "t", [7, 2, 2, 4, 900])


@query("f4_axis_crop", PX + f", k AS (SELECT t old, CAST(row_number() OVER (ORDER BY t) - 1 AS INT) t FROM (SELECT DISTINCT t FROM px WHERE t IN (3, 4, 5))) SELECT source_file, m, k.t, z, c, y, x, v FROM px JOIN k ON px.t = k.old")
def f4(spark, sf):
    return select.subset(frames(spark, sf), "t", range(3, 6))


@query("f5_spatial_crop", PX + " SELECT source_file, m, t, z, c, y - 5 y, x - 10 x, v FROM px WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 25")
def f5(spark, sf):
    return select.crop(frames(spark, sf), 10, 5, 20, 20)


@query("f6_channel_enable", PX2 + f" SELECT {PIX}, v FROM px2 WHERE c IN ('ch1')")
def f6(spark, sf):
    return select.channels(frames_two_channels(spark, sf), ["ch1"])


@query("f7_column_selection", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def f7(spark, sf):
    return select.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"], known=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"])


@query("f8_default_columns", "SELECT event_type segmentation_channel, event_id frame, user_id label_id, CAST(floor(value) AS BIGINT) area_px, props FROM events")
def f8(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("segmentation_channel"), F.col("event_id").alias("frame"), F.col("user_id").alias("label_id"), F.floor("value").alias("area_px"), F.col("value").alias("perimeter"), "props")
    return select.select_columns(e, select.DEFAULT_COLUMNS)


for _method, _sql in {"below": "v <= 500", "above": "v >= 700", "between": "v >= 500 AND v <= 700", "outside": "v < 500 OR v > 700"}.items():

    @query(f"p1_threshold_{_method}", PX + f" SELECT {PIX}, v FROM px WHERE {_sql}")
    def p1(spark, sf, method=_method):
        return point.threshold(frames(spark, sf), method, 500, 700)


CDF = PX + ", h AS (SELECT t, v, count(*) n FROM px GROUP BY 1, 2), c AS (SELECT t, v, sum(n) OVER (PARTITION BY t ORDER BY v) / sum(n) OVER (PARTITION BY t) cdf FROM h)"


@query("p2_percentile_threshold", CDF + f", p AS (SELECT t, least(min(v) FILTER (cdf >= 0.05), 450) lo, greatest(min(v) FILTER (cdf >= 0.9), 300) hi FROM c GROUP BY 1) SELECT px.source_file, m, t, z, c, y, x, v, lo low_value, hi high_value FROM px JOIN p USING (t) WHERE v < lo OR v > hi")
def p2(spark, sf):
    return point.percentile_threshold(frames(spark, sf), "outside", 5, 90, floor=450, ceiling=300)


@query("p3_relative_threshold", PX + f", p AS (SELECT t, CAST(round_even(quantile_cont(v, 0.5) * 0.8, 0) AS INT) value FROM px WHERE x < 32 GROUP BY 1) SELECT {PIX}, v, value FROM px JOIN p USING (t) WHERE v <= value")
def p3(spark, sf):
    px = frames(spark, sf)
    return point.relative_threshold(px, "below", 0.8, px.where("x < 32"))


@query("p4_resolved_thresholds", CDF + ", q AS (SELECT t, min(v) FILTER (cdf >= 0.05) percentile_value FROM c GROUP BY 1), r AS (SELECT t, CAST(round_even(quantile_cont(v, 0.5) * 0.5, 0) AS INT) relative_value FROM px GROUP BY 1) SELECT t, 500 absolute_value, percentile_value, relative_value FROM q JOIN r USING (t)")
def p4(spark, sf):
    px = frames(spark, sf)
    q = hist.hist_percentile(px, 5, name="percentile_value").select("t", "percentile_value")
    r = px.groupBy("t").agg(F.bround(F.percentile("v", F.lit(0.5)) * 0.5, 0).cast("int").alias("relative_value"))
    return q.join(r, "t").select("t", F.lit(500).alias("absolute_value"), "percentile_value", "relative_value")


@query("p6_bit_depth_status", PX + f" SELECT {KEYS}, max(v) max_value, CASE WHEN max(v) > 1023 THEN 'overflow' WHEN max(v) < 0.05 * 1023 THEN 'low_range' ELSE 'ok' END status FROM px GROUP BY ALL")
def p6(spark, sf):
    return point.bit_depth_status(frames(spark, sf), 10)


@query("p7_bit_depth_inference", PX2 + f" SELECT {KEYS}, max(v) max_value, CASE WHEN max(v) <= 255 THEN 8 WHEN max(v) <= 1023 THEN 10 WHEN max(v) <= 4095 THEN 12 WHEN max(v) <= 16383 THEN 14 WHEN max(v) <= 65535 THEN 16 END bit_depth FROM px2 GROUP BY ALL")
def p7(spark, sf):
    return point.infer_bit_depth(frames_two_channels(spark, sf))


BOUNDS = ", b AS (SELECT t, quantile_cont(v, {lo}) lo, quantile_cont(v, {hi}) hi FROM px GROUP BY 1)"


@query("p8_percentile_normalise", PX + BOUNDS.format(lo=0.01, hi=0.99) + f" SELECT {PIX}, CAST(floor(greatest(0, least(1, (v - lo) / (hi - lo + 1e-10))) * 65535) AS INT) v FROM px JOIN b USING (t)")
def p8(spark, sf):
    return point.percentile_normalise(frames(spark, sf))


@query("p9_unit_normalise", PX + BOUNDS.format(lo=0.01, hi=0.998) + f" SELECT {PIX}, round(greatest(0, least(1, (v - lo) / (CASE WHEN hi - lo < 1e-10 THEN 1 ELSE hi - lo END))), 6) v FROM px JOIN b USING (t)")
def p9(spark, sf):
    return point.unit_normalise(frames(spark, sf)).withColumn("v", F.round("v", 6))


@query("p10_gamma", PX + f" SELECT {PIX}, CAST(floor(pow(v / 4095, 0.5) * 4095) AS INT) v FROM px")
def p10(spark, sf):
    return point.gamma(frames(spark, sf), 0.5, 4095)


@query("p11_lut", PX + f" SELECT {PIX}, CAST(floor(pow(greatest(0, least(1, (v - 300.0::DOUBLE) / 600)), 1 / 0.8::DOUBLE) * 255) AS INT) v FROM px")
def p11(spark, sf):
    return point.apply_lut(frames(spark, sf), 300, 900, 0.8)


@query("p12_auto_stretch", PX + BOUNDS.format(lo=0.005, hi=0.995) + f" SELECT {PIX}, CAST(floor(greatest(0, least(1, (v - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))) * 255) AS INT) v FROM px JOIN b USING (t)")
def p12(spark, sf):
    return point.auto_stretch(frames(spark, sf))


@query("p13_export_rescale", PX2 + f", b AS (SELECT c, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi FROM px2 GROUP BY 1) SELECT {PIX}, CAST(floor(greatest(0, least(1, (v - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END))) * 65535) AS INT) v FROM px2 JOIN b USING (c)")
def p13(spark, sf):
    return point.export_rescale(frames_two_channels(spark, sf), 65535)


GRAY = PX2 + ", g AS (SELECT source_file, m, t, z, c, y, x, CAST(floor(greatest(0, least(1, v / 4095::DOUBLE)) * 255) AS INT) v FROM px2)"


@query("p14_composite", GRAY + " SELECT source_file, m, t, z, y, x, CAST(floor(least(255, sum(v * CASE c WHEN 'ch0' THEN 0 ELSE 255 END / 255))) AS INT) r, CAST(floor(least(255, sum(v * 255 / 255))) AS INT) g, CAST(floor(least(255, sum(v * CASE c WHEN 'ch0' THEN 0 ELSE 0 END / 255))) AS INT) b FROM g GROUP BY ALL")
def p14(spark, sf):
    return point.composite(point.apply_lut(frames_two_channels(spark, sf), 0, 4095), {"ch0": "green", "ch1": "yellow"})


@query("p15_brightness_gain", GRAY + " SELECT source_file, m, t, z, y, x, CAST(floor(least(255, sum(CASE c WHEN 'ch0' THEN 0 ELSE least(255, v * 1.5) END))) AS INT) r, CAST(floor(least(255, sum(CASE c WHEN 'ch0' THEN least(255, v * 0.5) ELSE 0 END))) AS INT) g, CAST(0 AS INT) b FROM g GROUP BY ALL")
def p15(spark, sf):
    return point.composite(point.apply_lut(frames_two_channels(spark, sf), 0, 4095), {"ch0": "green", "ch1": "red"}, {"ch0": -50, "ch1": 50})


@query("p16_image_adjustments", GRAY + """, p AS (SELECT source_file, m, t, z, y, x, max(v) FILTER (c = 'ch0') r, max(v) FILTER (c = 'ch1') b FROM g GROUP BY ALL),
 a AS (SELECT *, greatest(0, least(255, greatest(0, least(255, (r - 128) * 1.2::DOUBLE + 128)) * 0.9)) r1, greatest(0, least(255, greatest(0, least(255, (0 - 128) * 1.2::DOUBLE + 128)) * 0.9)) g1, greatest(0, least(255, greatest(0, least(255, (b - 128) * 1.2::DOUBLE + 128)) * 0.9)) b1 FROM p),
 q AS (SELECT *, greatest(r1, g1, b1) / 255 hi, least(r1, g1, b1) / 255 lo FROM a),
 h AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r1 / 255 THEN (((g1 - b1) / 255 / (hi - lo)) % 6 + 6) % 6 WHEN hi = g1 / 255 THEN (b1 - r1) / 255 / (hi - lo) + 2 ELSE (r1 - g1) / 255 / (hi - lo) + 4 END raw FROM q),
 k AS (SELECT *, ((raw * 60 + 30) % 360 + 360) % 360 hue, least(1, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END * 0.8) s FROM h),
 f AS (SELECT *, CAST(floor(hue / 60) AS INT) % 6 sec, hue / 60 - floor(hue / 60) f, hi * (1 - s) p, hi * (1 - (hue / 60 - floor(hue / 60)) * s) q, hi * (1 - (1 - (hue / 60 - floor(hue / 60))) * s) u FROM k)
 SELECT source_file, m, t, z, y, x, CAST(floor(least(255, round([hi, q, p, p, u, hi][sec + 1] * 255 * 0.9 + 25.5, 6))) AS INT) r, CAST(floor(least(255, round([u, hi, hi, q, p, p][sec + 1] * 255 * 0.9 + 25.5, 6))) AS INT) g, CAST(floor(least(255, round([p, p, u, hi, hi, q][sec + 1] * 255 * 0.9 + 25.5, 6))) AS INT) b FROM f""")
def p16(spark, sf):
    g = point.apply_lut(frames_two_channels(spark, sf), 0, 4095)
    rgb = g.groupBy("source_file", "m", "t", "z", "y", "x").agg(F.max(F.when(F.col("c") == "ch0", F.col("v"))).alias("r"), F.lit(0).alias("g"), F.max(F.when(F.col("c") == "ch1", F.col("v"))).alias("b"))
    return point.adjust(rgb, contrast=20, brightness=-10, hue=30, saturation=-20, fade=10)


#: The palette as SQL has it, apart from the operator's. Fixed values.
PAL = "[[240,60,60],[60,210,60],[60,100,240],[240,200,50],[200,60,200],[50,200,200],[240,130,50],[150,60,240],[60,240,150],[240,60,150],[110,200,60],[60,150,240]]"


@query("p17_label_overlay", PX + f", g AS (SELECT {PIX}, CAST(floor(greatest(0, least(1, v / 4095::DOUBLE)) * 255) AS INT) v, CASE WHEN v >= 800 THEN y // 10 + 1 END l FROM px) SELECT {PIX}, " + ", ".join(f"CAST(floor(least(255, round(CASE WHEN l IS NULL THEN v ELSE v * 0.6 + {PAL}[(l - 1) % 12 + 1][{i}] * 0.4 END, 6))) AS INT) {k}" for i, k in enumerate("rgb", 1)) + " FROM g")
def p17(spark, sf):
    px = frames(spark, sf)
    labels = px.where("v >= 800").withColumn("label_id", F.expr("y div 10 + 1"))
    return point.overlay(point.apply_lut(px, 0, 4095), labels)


@query("p18_track_highlight", PX + f", g AS (SELECT {PIX}, CAST(floor(greatest(0, least(1, v / 4095::DOUBLE)) * 255) AS INT) v, v >= 800 AND y // 10 = t % 5 hit FROM px) SELECT {PIX}, " + ", ".join(f"CAST(floor(least(255, round(CASE WHEN NOT hit THEN v ELSE v * 0.45 + {x} * 0.55 END, 6))) AS INT) {k}" for x, k in zip((255, 220, 0), "rgb")) + " FROM g")
def p18(spark, sf):
    px = frames(spark, sf)
    labels = px.where("v >= 800").withColumn("label_id", F.expr("cast(y div 10 as int)"))
    track = px.select("c", "t").distinct().withColumn("label_id", F.expr("t % 5"))
    return point.overlay(point.apply_lut(px, 0, 4095), labels.join(track, ["c", "t", "label_id"]), 0.55, (255, 220, 0))


@query("p19_unit_conversion", "SELECT s_suppkey, s_nationkey * 40 area_px, s_nationkey + 0.5::DOUBLE centroid_y_px, s_suppkey % 64 + 0.25::DOUBLE centroid_x_px, round_even(s_nationkey * 40 * 0.33::DOUBLE * 0.33, 4) area_um2, round_even((s_nationkey + 0.5::DOUBLE) * 0.33, 4) centroid_y_um, round_even((s_suppkey % 64 + 0.25::DOUBLE) * 0.33, 4) centroid_x_um, round_even(1000 + (s_suppkey % 64 + 0.25::DOUBLE - 32) * 0.33, 4) centroid_x_stage_um, round_even(-500 + (s_nationkey + 0.5::DOUBLE - 25) * 0.33, 4) centroid_y_stage_um FROM supplier")
def p19(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") * 40).alias("area_px"), (F.col("s_nationkey") + F.lit(0.5)).alias("centroid_y_px"), (F.col("s_suppkey") % 64 + F.lit(0.25)).alias("centroid_x_px"))
    return point.to_units(s, 0.33, 64, 50, (1000.0, -500.0))


@query("p20_circularity", "SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 0 ELSE 4 * pi() * p_size / ((p_size - 1) * (p_size - 1)) END, 6) circularity, round(least(1, CASE WHEN p_size = 1 THEN 0 ELSE 4 * pi() * p_size / ((p_size - 1) * (p_size - 1)) END), 6) clipped FROM part")
def p20(spark, sf):
    a, p = F.col("p_size"), F.col("p_size") - 1
    return table(spark, sf, "part").select("p_partkey", F.round(point.circularity(a, p), 6).alias("circularity"), F.round(point.circularity(a, p, clip=True), 6).alias("clipped"))


@query("p21_duration_format", "WITH e AS (SELECT event_id, value * 60 s FROM events) SELECT event_id, CASE WHEN floor(s) >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(s) AS BIGINT) // 3600, CAST(floor(s) AS BIGINT) % 3600 // 60, CAST(floor(s) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) END clock, printf('%02d', CAST(floor((s - floor(s)) * 100 + 1e-6) AS BIGINT)) hundredths FROM e")
def p21(spark, sf):
    s = F.col("value") * 60
    long = point.duration(s, hundredths=True)
    return table(spark, sf, "events").select("event_id", point.duration(s).alias("clock"), F.substring_index(long, ".", -1).alias("hundredths"))


@query("p22_axis_metadata", "WITH e AS (SELECT event_type source_file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 t, epoch_us(ts) / 1e6 ts FROM events) SELECT source_file, t, ts, ts - min(ts) OVER w elapsed, ts - lag(ts) OVER (PARTITION BY source_file ORDER BY t) step, max(ts) OVER w - min(ts) OVER w total FROM e WINDOW w AS (PARTITION BY source_file)")
def p22(spark, sf):
    from pyspark.sql.window import Window

    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("source_file"), (F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1).alias("t"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return point.axis_metadata(rows)


@query("p23_spot_scale", "WITH p AS (SELECT p_partkey, p_size * 0.5::DOUBLE d, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 100::DOUBLE END s FROM part) SELECT p_partkey, round(d / coalesce(s, 1), 6) diameter_px, round(d / coalesce(s, 1) / (2 * sqrt(2 * ln(2))), 6) sigma_in, round(d / coalesce(s, 1) / (2 * sqrt(2 * ln(2))) * 1.6, 6) sigma_out FROM p")
def p23(spark, sf):
    px, inner, outer = point.spot_scale(F.col("p_size") * 0.5, F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 100))
    return table(spark, sf, "part").select("p_partkey", F.round(px, 6).alias("diameter_px"), F.round(inner, 6).alias("sigma_in"), F.round(outer, 6).alias("sigma_out"))


@query("p24_area_limits", "SELECT p_partkey, greatest(1, CAST(floor(round(p_size / (0.5 * 0.5::DOUBLE), 9)) AS BIGINT)) min_px, CASE WHEN p_size % 5 = 0 THEN 0 ELSE greatest(1, CAST(floor(round(p_size * 10 / (0.5 * 0.5::DOUBLE), 9)) AS BIGINT)) END max_px FROM part")
def p24(spark, sf):
    lo, hi = point.area_limits_px(F.col("p_size"), F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size") * 10), 0.5)
    return table(spark, sf, "part").select("p_partkey", lo.alias("min_px"), hi.alias("max_px"))


@query("p25_pyramid_depth", "SELECT p_partkey, CAST(least(6, greatest(2, floor(log2(greatest(p_size * 100, 256) / 256)))) AS INT) levels FROM part")
def p25(spark, sf):
    levels = F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.log2(F.greatest(F.col("p_size") * 100, F.lit(256)) / 256)).cast("int")))
    return table(spark, sf, "part").select("p_partkey", levels.alias("levels"))


for _mode, _sql in {"max": "max(v)", "min": "min(v)", "mean": "CAST(floor(avg(v)) AS INT)"}.items():

    @query(f"r1_z_project_{_mode}", PXZ + f" SELECT source_file, m, t, 0 z, c, y, x, {_sql} v FROM pxz GROUP BY ALL")
    def r1(spark, sf, mode=_mode):
        return project.z_project(frames_with_depth(spark, sf), mode)


@query("r2_middle_slice", PXZ + " SELECT source_file, m, t, 0 z, c, y, x, v FROM pxz WHERE z = 1")
def r2(spark, sf):
    return project.z_project(frames_with_depth(spark, sf), "middle")


@query("r3_mean_pool", PX + " SELECT source_file, m, t, z, c, y // 3 y, x // 3 x, CAST(floor(avg(v)) AS INT) v FROM px WHERE y < 48 AND x < 63 GROUP BY ALL")
def r3(spark, sf):
    return project.mean_pool(frames(spark, sf), 3, 50, 64)


@query("r4_pyramid", PX + " SELECT source_file, m, t, z, c, l.level, y // l.k y, x // l.k x, CAST(floor(avg(v)) AS INT) v FROM px, (VALUES (1, 2), (2, 4)) l(level, k) WHERE y < 50 // k * k AND x < 64 // k * k GROUP BY ALL")
def r4(spark, sf):
    return project.pyramid(frames(spark, sf), 50, 64, 2, least=8)


@query("r5_level_projection", PXZ + ", l AS (SELECT source_file, m, t, z, c, y // 2 y, x // 2 x, CAST(floor(avg(v)) AS INT) v FROM pxz GROUP BY ALL) SELECT source_file, m, t, 0 z, c, y, x, max(v) v FROM l GROUP BY ALL")
def r5(spark, sf):
    level = project.pyramid(frames_with_depth(spark, sf), 50, 64, 1, least=8).where("level = 1").drop("level")
    return project.z_project(level)


@query("r6_frame_means", PX + f", f AS (SELECT {KEYS}, avg(v) mean FROM px GROUP BY ALL) SELECT {KEYS}, round(mean, 6) mean, round(avg(mean) OVER (), 6) grand_mean FROM f")
def r6(spark, sf):
    return project.frame_means(frames(spark, sf)).withColumns({"mean": F.round("mean", 6), "grand_mean": F.round("grand_mean", 6)})


QTY = f"WITH {SQL_QTY}"


@query("h1_histogram", QTY + ", h AS (SELECT t, v, count(*) n FROM qty GROUP BY ALL) SELECT t, v, n, total FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY t) AS BIGINT) total FROM h) WHERE v <= 40")
def h1(spark, sf):
    return hist.histogram(quantities(spark, sf), ["t"], 40)


@query("h2_cumulative", QTY + ", h AS (SELECT t, v, count(*) n FROM qty GROUP BY ALL) SELECT t, v, n, CAST(sum(n) OVER (PARTITION BY t) AS BIGINT) total, round(sum(n) OVER (PARTITION BY t ORDER BY v) / sum(n) OVER (PARTITION BY t), 6) cdf FROM h")
def h2(spark, sf):
    return hist.cumulative(hist.histogram(quantities(spark, sf), ["t"]), ["t"]).withColumn("cdf", F.round("cdf", 6))


@query("h3_hist_percentile", QTY + " SELECT t, quantile_disc(v, 0.9) value FROM qty GROUP BY 1")
def h3(spark, sf):
    return hist.hist_percentile(quantities(spark, sf), 90, ["t"])


STEPS = PX + ", h AS (SELECT t, v, count(*) n FROM px GROUP BY ALL), s AS (SELECT t, v, n, CAST(sum(n) OVER u AS DOUBLE) w0, CAST(sum(n * v) OVER u AS DOUBLE) s0, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) w, CAST(sum(n * v) OVER (PARTITION BY t) AS DOUBLE) s FROM h WINDOW u AS (PARTITION BY t ORDER BY v))"


@query("h4_otsu", STEPS + ", b AS (SELECT t, v, w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) k FROM s WHERE w > w0) SELECT t, v threshold FROM b QUALIFY row_number() OVER (PARTITION BY t ORDER BY k DESC, v) = 1")
def h4(spark, sf):
    return hist.otsu(frames(spark, sf)).select("t", "threshold")


@query("h5_triangle", PX + """, h AS (SELECT t, v // 16 v, count(*) n FROM px GROUP BY ALL), p AS (SELECT t, min(v) lo, max(v) hi, max(n) height FROM h GROUP BY 1),
 k AS (SELECT h.t, any_value(lo) lo, any_value(hi) hi, any_value(height) height, min(v) peak FROM h JOIN p ON h.t = p.t AND n = height GROUP BY 1),
 e AS (SELECT *, hi - peak >= peak - lo r, CASE WHEN hi - peak >= peak - lo THEN hi - peak ELSE peak - lo END w FROM k),
 d AS (SELECT h.t, v, CASE WHEN w > 0 THEN height::DOUBLE * (w - abs(v - peak)) / w - n ELSE 0 END d FROM h JOIN e ON h.t = e.t WHERE CASE WHEN r THEN v >= peak ELSE v <= peak END)
 SELECT t, v threshold FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY d DESC, v) = 1""")
def h5(spark, sf):
    return hist.triangle(frames(spark, sf).withColumn("v", F.expr("cast(v div 16 as int)"))).select("t", "threshold")


@query("h6_minimum")
def h6(spark, sf):
    return hist.minimum_threshold(frames(spark, sf).withColumn("v", F.expr("cast(v div 8 as int)"))).select("t", "threshold")


@query("h7_multi_otsu", PX + """, h AS (SELECT t, v // 32 v, count(*) n FROM px GROUP BY ALL),
 s AS (SELECT t, v, CAST(sum(n) OVER u AS DOUBLE) w, CAST(sum(n * v) OVER u AS DOUBLE) s, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) total, CAST(sum(n * v) OVER (PARTITION BY t) AS DOUBLE) a FROM h WINDOW u AS (PARTITION BY t ORDER BY v)),
 p AS (SELECT s.t, s.v low, q.v high, round(s.s * s.s / s.w + (q.s - s.s) * (q.s - s.s) / (q.w - s.w) + (s.a - q.s) * (s.a - q.s) / (s.total - q.w), 6) k FROM s JOIN s q ON s.t = q.t AND q.v > s.v AND q.w < s.total)
 SELECT t, low, high FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY k DESC, low, high) = 1""")
def h7(spark, sf):
    return hist.multi_otsu(frames(spark, sf).withColumn("v", F.expr("cast(v div 32 as int)"))).select("t", "low", "high")


@query("h7_multi_otsu_four", PX + """, h AS (SELECT t, v // 64 v, count(*) n FROM px GROUP BY ALL),
 s AS (SELECT t, v, CAST(sum(n) OVER u AS DOUBLE) w, CAST(sum(n * v) OVER u AS DOUBLE) s, CAST(sum(n) OVER (PARTITION BY t) AS DOUBLE) total, CAST(sum(n * v) OVER (PARTITION BY t) AS DOUBLE) a FROM h WINDOW u AS (PARTITION BY t ORDER BY v)),
 p AS (SELECT s.t, s.v a1, q.v a2, r.v a3, round(s.s * s.s / s.w + (q.s - s.s) * (q.s - s.s) / (q.w - s.w) + (r.s - q.s) * (r.s - q.s) / (r.w - q.w) + (s.a - r.s) * (s.a - r.s) / (s.total - r.w), 5) k FROM s JOIN s q ON s.t = q.t AND q.v > s.v JOIN s r ON r.t = q.t AND r.v > q.v AND r.w < s.total)
 SELECT t, a1, a2, a3 FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY k DESC, a1, a2, a3) = 1""")
def h7_four(spark, sf):
    four = hist.multi_otsu(frames(spark, sf).withColumn("v", F.expr("cast(v div 64 as int)")), classes=4)
    return four.select("t", *[F.col("thresholds")[i].alias(f"a{i + 1}") for i in range(3)])


@query("h8_display_histogram", PX2 + ", k AS (SELECT DISTINCT i * (SELECT max(t) FROM px2) // 3 t FROM range(4) r(i)), f AS (SELECT px2.* FROM px2 JOIN k USING (t)), m AS (SELECT c, max(v) top FROM f GROUP BY 1) SELECT c, least(CAST(floor(v * 256 / top) AS INT), 255) bin, count(*) n, round(ln(1 + count(*)), 6) log_n FROM f JOIN m USING (c) GROUP BY 1, 2")
def h8(spark, sf):
    return hist.display_histogram(frames_two_channels(spark, sf), 4).select("c", "bin", "n", F.round("log_n", 6).alias("log_n"))


@query("h9_auto_contrast", PX2 + ", m AS (SELECT c, max(v) top FROM px2 GROUP BY 1), b AS (SELECT c, least(CAST(floor(v * 256 / top) AS INT), 255) bin, count(*) n FROM px2 JOIN m USING (c) GROUP BY 1, 2), d AS (SELECT c, bin, sum(n) OVER (PARTITION BY c ORDER BY bin) / sum(n) OVER (PARTITION BY c) cdf FROM b) SELECT c, min(bin) FILTER (cdf >= 0.005) low_bin, min(bin) FILTER (cdf >= 0.995) high_bin FROM d GROUP BY 1")
def h9(spark, sf):
    return hist.auto_contrast(hist.display_histogram(frames_two_channels(spark, sf), None)).select("c", "low_bin", "high_bin")
