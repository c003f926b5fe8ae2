"""What a task or the driver holds: files of a position, packed tiles of floods, joins of pixel tables."""

import glob

import numpy as np
from pyspark.sql import functions as F

from lumastack.functions.graph import written
from lumastack.operators import label
from lumastack.sources import stacks

from .test_operators import stack


def test_one_position_is_written_by_several_tasks_in_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        px = stack(spark, np.arange(640).reshape(40, 16)).unionAll(stack(spark, np.arange(640).reshape(40, 16), t=1))
        stacks.write_frames(px, str(tmp_path / "frames"))
        stacks.write_labels(px.withColumnRenamed("v", "label_id"), str(tmp_path / "labels"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for folder, at in (("frames/source_file=s/m=0", ("t", "z", "c", "y", "x")), ("labels/m=0", ("t", "y", "x"))):
        files = sorted(glob.glob(f"{tmp_path}/{folder}/*.parquet"))
        rows = [tuple(r) for f in files for r in spark.read.parquet(f).select(*at).coalesce(1).collect()]
        assert len(files) > 1 and len(rows) == 1280 and rows == sorted(rows)


def test_flood_tiles_are_packed_and_no_wider_than_the_plane(spark, monkeypatch):
    sizes = []

    def seen(df, name):
        out = written(df, name)
        if name == "settle":
            sizes.append(out.agg(F.max(F.octet_length("cells"))).first()[0])
        return out

    monkeypatch.setattr(label, "written", seen)
    px = stack(spark, np.add.outer(np.arange(20), np.arange(30)))
    got = label.watershed(px, px.where("v = 48").withColumn("label_id", F.lit(7)), px).collect()
    assert len(got) == 600 and {r.label_id for r in got} == {7}
    assert max(sizes) < 33 * 33 * 4 * 8


def test_pixel_tables_are_joined_by_key_however_small_their_files(spark):
    px = stack(spark, np.arange(300).reshape(15, 20))
    plane, mask = written(px, "plane"), written(px.where("v > 9"), "mask")
    rest = label.complement(mask, plane)
    assert "Broadcast" not in rest._jdf.queryExecution().executedPlan().toString()
    assert rest.count() == 10
