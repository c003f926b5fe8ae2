"""Connected components of an edge list, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without one gets a new local folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def reread(table: DataFrame) -> DataFrame:
    """A table that ``written`` made as a DataFrame of its own, to be joined with the first."""
    again = table.sparkSession.read.schema(table.schema).parquet(table.scratch_path)
    again.scratch_path = table.scratch_path
    return again


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def least_reachable(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the least node that each end of an undirected edge reaches.

    A round takes the least label of the neighbours (a grouped minimum) and then
    the label's own label; it ends when nothing changes.
    """
    half = edges.select(F.col(a).alias("node"), F.col(b).alias("peer")).where("node <> peer")
    both = written(half.union(half.select("peer", "node")).distinct(), "graph-edges")
    labels = written(both.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("label")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("peer"), "label"), "peer").groupBy("node").agg(F.min("label").alias("near"))
        lower = written(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "graph-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "graph-labels")
        if not labels.where("label <> was").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
