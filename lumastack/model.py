"""Data model: key columns, layouts, and bindings of the test tables to frame stacks.

A stack is a ``pixels`` table, one row per pixel: ``source_file, m, t, z, c, y,
x, v``. ``FRAME`` names the keys of one plane. Operators take and return such
tables; they only use the columns they name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = ["source_file", "m", "t", "z", "c"]
SERIES = ["source_file", "m", "z", "c"]
PIXEL = [*FRAME, "y", "x"]
#: Height and width of the planes that ``embeddings`` is read as.
HEIGHT, WIDTH = 50, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.lit("embeddings").alias("source_file"),
        F.lit(0).alias("m"),
        F.expr(f"cast(vec_id div {HEIGHT} as int)").alias("t"),
        F.expr(f"cast(vec_id % {HEIGHT} as int)").alias("y"),
        F.col("label"),
        F.posexplode("embedding").alias("x", "e"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one channel: 50 vectors a frame, one row of pixels each, 12-bit integers."""
    v = F.floor((F.col("e").cast("double") + 0.6) * 1000).cast("int")
    return _rows(spark, sf_dir).select("source_file", "m", "t", F.lit(0).alias("z"), F.lit("ch0").alias("c"), "y", "x", v.alias("v"))


def frames_two_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` and a second channel made of the label and the place."""
    v = F.floor((F.col("e").cast("double") + 0.6) * 1000).cast("int")
    second = F.expr("cast((label * 97 + x * 3 + y) % 4096 as int)")
    both = F.explode(F.array(F.struct(F.lit("ch0").alias("c"), v.alias("v")), F.struct(F.lit("ch1").alias("c"), second.alias("v")))).alias("p")
    rows = _rows(spark, sf_dir).select("source_file", "m", "t", F.lit(0).alias("z"), "y", "x", both)
    return rows.select("source_file", "m", "t", "z", "p.c", "y", "x", "p.v")


def frames_with_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` with every two frames as the two depths of one time."""
    return frames(spark, sf_dir).withColumns({"z": F.expr("t % 2"), "t": F.expr("cast(t div 2 as int)")})


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem.l_quantity`` as integer intensities of one frame per ship month."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("t"), F.col("l_quantity").cast("int").alias("v"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as object rows: the user is the label, the rank of its event the frame, the value the area."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.lit("events").alias("source_file"), F.lit(0).alias("m"), F.col("event_type").alias("segmentation_channel"), (rank - 1).alias("frame"),
        F.col("user_id").alias("label_id"), F.floor(F.col("value") * 100).cast("long").alias("area_px"), "event_id",
    )


#: The same bindings in DuckDB SQL, as common table expressions.
SQL_ROWS = f"""er AS (SELECT CAST(vec_id // {HEIGHT} AS INT) t, CAST(vec_id % {HEIGHT} AS INT) y, CAST(p - 1 AS INT) x, label, CAST(e AS DOUBLE) e
 FROM (SELECT vec_id, label, unnest(embedding) e, generate_subscripts(embedding, 1) p FROM embeddings))"""
SQL_PX = SQL_ROWS + ", px AS (SELECT 'embeddings' source_file, 0 m, t, 0 z, 'ch0' c, y, x, CAST(floor((e + 0.6) * 1000) AS INT) v FROM er)"
SQL_PX2 = SQL_PX + ", px2 AS (SELECT * FROM px UNION ALL SELECT 'embeddings', 0, t, 0, 'ch1', y, x, CAST((label * 97 + x * 3 + y) % 4096 AS INT) FROM er)"
SQL_PXZ = SQL_PX + ", pxz AS (SELECT source_file, m, t // 2 t, t % 2 z, c, y, x, v FROM px)"
SQL_QTY = "qty AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) - 1 t, CAST(l_quantity AS INT) v FROM lineitem)"
SQL_MEAS = """meas AS (SELECT 'events' source_file, 0 m, event_type segmentation_channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 frame,
 user_id label_id, CAST(floor(value * 100) AS BIGINT) area_px, event_id FROM events)"""
