"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without blanks (space, tab, line feed, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local session without one gets a new local folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: With it Spark removes a statement's shuffle files when the statement has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage and survives lost executors.

    The write's shuffle files go when it has ended, so that a job of several
    steps holds one step's at a time. ``discard`` removes the table itself. ``level``
    is zstandard's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def integral(df: DataFrame, column: str) -> None:
    """Raise if ``column`` is no whole number: a cast would turn other ids into nulls silently."""
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{column} must be a whole number, not {df.schema[column].dataType.simpleString()}")


def carried(docs: DataFrame, *but: str) -> Column:
    """All columns of ``docs`` except ``but`` as one struct, by position: no name can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns) if c not in but], F.lit(0).alias("_"))


def restored(rows: DataFrame, docs: DataFrame, row: str = "row", **others: Column) -> DataFrame:
    """The columns of ``docs`` again from the struct ``row``; ``others`` replaces some."""
    return rows.select(*[others.get(c, F.col(row)[f"_{i}"]).alias(c) for i, c in enumerate(docs.columns)])


def spread(key: Column | str, buckets: int) -> Column:
    """An even, repeatable bucket number of a key."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(buckets))


def bucket_count(rows: int) -> int:
    """Buckets for a two-level running sum: about the root of the rows, so that neither a bucket nor the list of buckets grows as the rows do."""
    return max(1, math.isqrt(max(rows, 1)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
