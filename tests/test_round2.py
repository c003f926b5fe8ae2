"""Cases of replay, of ids that restart in each file, and of fixed name patterns."""

import shutil

import pytest
from pyspark.sql import functions as F

from lumastack.operators import joins, point, select, track
from lumastack.streaming.events import append_results


def test_a_finished_batch_that_runs_again_keeps_its_rows(spark, tmp_path):
    src, out, ledger, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ledger", "cp"))
    spark.createDataFrame([("a", 0, 5), ("a", 1, 6)], "source_file string, m int, v int").write.parquet(src)

    def run():
        stream = spark.readStream.schema("source_file string, m int, v int").parquet(src)
        append_results(stream, lambda b: b.groupBy("source_file", "m").agg(F.max("v").alias("v")), out, ledger, ["source_file", "m"], checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.source_file, r.m, r.v) for r in spark.read.parquet(out).collect())

    want = [("a", 0, 5), ("a", 1, 6)]
    assert run() == want
    shutil.rmtree(f"{checkpoint}/commits")
    assert run() == want


def test_equal_track_ids_of_two_files_stay_apart(spark):
    rows = [(f, 0, "c", t, 1, 10 * i + t, 5, 10 * i + t + 4, 9) for i, f in enumerate("ab") for t in range(3)]
    tracked = spark.createDataFrame(rows, "source_file string, m int, c string, frame int, track_id int, y0 int, x0 int, y1 int, x1 int")
    assert sorted((r.source_file, r.track_id, r.n) for r in track.track_queue(tracked).collect()) == [("a", 1, 3), ("b", 1, 3)]
    boxes = track.crop_boxes(tracked, 50, 64)
    assert sorted((r.source_file, r.cy0, r.cy1) for r in boxes.collect()) == [("a", 0, 12), ("b", 4, 22)]
    assert sorted((r.source_file, r.page, r.place) for r in track.gallery_layout(boxes, 1).collect()) == [("a", 0, 0), ("b", 0, 0)]
    rgb = spark.createDataFrame([(f, 0, "c", 0, 11, 6, v, 0, 0) for f, v in (("a", 1), ("b", 2))], "source_file string, m int, c string, t int, y int, x int, r int, g int, b int")
    members = tracked.select("source_file", "m", "c", F.col("frame").alias("t"), "track_id").where("t = 0")
    assert sorted((r.source_file, r.y, r.r) for r in track.gallery(rgb, boxes, members).collect()) == [("a", 11, 1), ("b", 7, 2)]


@pytest.mark.parametrize(
    ("names", "axis"),
    [(["imgt01", "imgt02"], "T"), (["count01", "count2"], "T"), (["/d/channelA", "/d/channelB"], "C"), (["z1b", "z2c"], None), (["Pos1", "pos2"], "M"), (["t1", "z1"], None)],
)
def test_chain_axis_by_name(spark, names, axis):
    assert joins.suggest_axis(spark.createDataFrame([(n,) for n in names], "u string"), "u").first().axis == axis


def test_fixed_tables():
    assert point.COLOURS["blue"] == (0, 100, 255) and point.COLOURS["gray"] == (255, 255, 255)
    assert len(point.PALETTE) == 12 and point.PALETTE[-1] == (60, 150, 240)
    assert "bbox_min_row" in select.COLUMN_GROUPS["Bounding box"] and len(select.DEFAULT_COLUMNS) == 14
