"""Sources and sinks of frame stacks: addressing, catalogs, fingerprints, exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FRAME
from ..operators.ranks import running


def page_keys(page: Column, n_z: int, n_c: int) -> tuple[Column, Column, Column]:
    """(t, z, c) of a page of an interleaved stack: page = t n_z n_c + z n_c + c."""
    at = page.cast("int")
    return F.floor(at / (n_z * n_c)).cast("int"), (F.floor(at / n_c) % n_z).cast("int"), (at % n_c).cast("int")


def assign_dimensions(values: DataFrame, order: str, sizes: dict[str, int], flat: str = "i", value: str = "v", open_end: bool = False) -> DataFrame:
    """Keys of a flat array in C order: the axes of ``order`` (e.g. ``TZCYX``), the last the fastest.

    The array must fill the sizes exactly; with ``open_end`` it may end within
    the last entry of the first axis.
    """
    if set(order) != set(sizes) or len(set(order)) != len(order):
        raise ValueError(f"dimension order {order!r} does not fit sizes {sorted(sizes)}")
    out, stride = {}, 1
    for axis in reversed(order):
        out[axis.lower()] = (F.floor(F.col(flat) / stride) % sizes[axis]).cast("int")
        stride *= sizes[axis]
    n, least, most = values.agg(F.count(flat), F.min(flat), F.max(flat)).first()
    short = stride - n
    if not 0 <= short < (stride // max(sizes[order[0]], 1) if open_end else 1) or (n and (least < 0 or most >= stride)):
        raise ValueError(f"{n} values from {least} to {most} do not fit sizes {sizes} of product {stride}")
    return values.select(*[out[a.lower()].alias(a.lower()) for a in order], F.col(value).alias("v"))


def colour_channels(rgb: DataFrame) -> DataFrame:
    """A colour stack as three channels red, green, blue."""
    keys = [c for c in rgb.columns if c not in ("r", "g", "b")]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(k).alias("v")) for n, k in (("red", "r"), ("green", "g"), ("blue", "b"))])).alias("p")
    return rgb.select(*keys, parts).select(*keys, "p.c", "p.v")


def scan_folder(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Files of a folder by ending, whatever case, with size and time; their content isn't read."""
    globs = ",".join("*" + "".join(f"[{a.lower()}{a.upper()}]" if a.isalpha() else a for a in s) for s in suffixes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + globs + "}" if len(suffixes) > 1 else globs).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), "modificationTime")


def metadata_record(rows: DataFrame) -> DataFrame:
    """Catalog rows with all keys present: pixel size 1.0, depth step 1.0, channel names Ch0, Ch1, ... where missing."""
    default = F.transform(F.sequence(F.lit(0), F.greatest("n_c", F.lit(1)) - 1), lambda i: F.concat(F.lit("Ch"), i.cast("string")))
    return rows.select(
        "source_file",
        F.coalesce("n_c", F.lit(1)).alias("n_c"),
        F.coalesce("pixel_size_um", F.lit(1.0)).alias("pixel_size_um"),
        F.coalesce("z_step_um", F.lit(1.0)).alias("z_step_um"),
        F.coalesce(F.when(F.size("channel_names") > 0, F.col("channel_names")), default).alias("channel_names"),
    )


def flat_index(coords: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Index of coordinates over the sequence dimensions, the last the fastest."""
    at = F.lit(0)
    for c, n in zip(coords, sizes, strict=True):
        at = at * n + c
    return at


def stage_positions(planned: DataFrame, readback: DataFrame, expected: DataFrame) -> DataFrame:
    """Position of each file: planned, else the frames' readback, else none; ``source`` tells which and how many. All have ``source_file``."""
    p = planned.groupBy("source_file").agg(F.count("*").alias("n_planned"), F.sort_array(F.collect_list(F.struct("m", "x", "y"))).alias("planned"))
    r = readback.groupBy("source_file").agg(F.count("*").alias("n_back"), F.sort_array(F.collect_list(F.struct("m", "x", "y"))).alias("back"))
    both = expected.join(p, "source_file", "left").join(r, "source_file", "left")
    tag = (
        F.when(F.col("n_planned") >= F.col("n_m"), F.lit("stage_xy:planned"))
        .when(F.col("n_back") >= F.col("n_m"), F.lit("stage_xy:readback"))
        .when(F.col("n_back") > 0, F.concat(F.lit("partial:"), F.col("n_back").cast("string"), F.lit("/"), F.col("n_m").cast("string"), F.lit(":readback")))
        .otherwise("missing")
    )
    chosen = F.when(F.col("n_planned") >= F.col("n_m"), F.col("planned")).otherwise(F.col("back"))
    return both.select("source_file", tag.alias("source"), F.coalesce(F.size(chosen), F.lit(0)).alias("n_positions"))


def refresh_catalog(sources: DataFrame, cached: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(still fresh, to read again): cached rows are fresh if as new as their source and of this version."""
    ok = cached.where(F.col("version") == version).join(sources.select("path", F.col("mtime").alias("mtime_")), "path").where("mtime >= mtime_").drop("mtime_")
    return ok, sources.join(ok.select("path"), "path", "left_anti")


def source_fingerprint(size: Column, mtime: Column, head: Column, tail: Column) -> Column:
    """16 hex digits of the SHA-256 of size, time, first and last bytes."""
    return F.substring(F.sha2(F.concat_ws("|", size.cast("string"), mtime.cast("string"), head, tail), 256), 1, 16)


def probe_fingerprint(pixels: DataFrame, probes: int = 3, length: int = 256) -> DataFrame:
    """16 hex digits per frame of its extent and ``probes`` runs of ``length`` pixels, spread over the frame.

    Pixels are counted by line; only the lines that a run lies in are read for
    their order.
    """
    lines = running(pixels.groupBy(*FRAME, "y").agg(F.count("*").alias("n_")), FRAME, [["y"]], "n_")
    starts = [F.expr(f"(total - least(total, {length})) * {k} div {max(probes - 1, 1)}") for k in range(probes)]

    def within(low, high):
        hit = F.lit(False)
        for s in starts:
            hit = hit | ((low < s + length) & (high > s))
        return hit

    met = lines.where(within(F.col("before"), F.col("before") + F.col("n_"))).select(*FRAME, "y", "before", "total")
    line = Window.partitionBy(*FRAME, "y").orderBy("x")
    rows = pixels.join(met, [*FRAME, "y"]).withColumn("i", F.col("before") + F.row_number().over(line) - 1)
    rows = rows.where(within(F.col("i"), F.col("i") + 1))
    shape = pixels.groupBy(*FRAME).agg(F.concat_ws("x", F.max("y") + 1, F.max("x") + 1).alias("shape"))
    listed = rows.groupBy(*FRAME).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"].cast("string"))).alias("listed"))
    return listed.join(shape, FRAME).select(*FRAME, F.substring(F.sha2(F.concat("shape", F.lit(":"), "listed"), 256), 1, 16).alias("fingerprint"))


def full_fingerprint(pixels: DataFrame) -> DataFrame:
    """SHA-256 per frame of all its values in raster order. Lines are made text side by side, then each frame's are hashed as they stream by."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda p: p["v"].cast("string"))
    lines = pixels.groupBy(*FRAME, "y").agg(F.concat_ws(",", listed).alias("line"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kinds = None, None, None
        for batch in batches:
            kinds = [batch.schema.field(k) for k in FRAME]
            out = []
            for *own, line in zip(*(batch.column(k).to_pylist() for k in [*FRAME, "line"]), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append([*key, state.hexdigest()])
                    key, state = own, hashlib.sha256()
                state.update(line.encode())
            if out:
                yield _records(out, kinds)
        if state is not None:
            yield _records([[*key, state.hexdigest()]], kinds)

    form = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in FRAME) + ", fingerprint string"
    return lines.repartition(*FRAME).sortWithinPartitions(*FRAME, "y").mapInArrow(digest, form)


def _records(rows: list[list], kinds: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*[k.name for k in kinds], "fingerprint"])


def frame_name(prefix: Column, axes: dict[str, tuple[Column, Column]]) -> Column:
    """Name of an exported frame: each axis of more than one frame, counted from 1, padded to the axis' width."""
    parts = [F.when(n > 1, F.concat(F.lit(k), F.lpad((i + 1).cast("string"), F.length(n.cast("string")), F.lit("0")))) for k, (i, n) in axes.items()]
    return F.concat_ws("_", prefix, *parts)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_batch_csv(parts: Sequence[DataFrame], path: str) -> None:
    """Rows of several files under one header: the union of their columns, one folder per source file."""
    union_rows(parts).write.mode("overwrite").option("header", True).partitionBy("source_file").csv(path)


def union_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Append tables whose columns differ; what a table lacks is null. ``source_file`` first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select("source_file", *[c for c in out.columns if c != "source_file"]) if "source_file" in out.columns else out


def write_labels(labels: DataFrame, path: str, by: Sequence[str] = ("m",)) -> None:
    """Labels as Parquet by position (or channel), sorted by frame and row within and over a position's files, whose names follow that order."""
    labels.repartitionByRange(*by, "t", "y").sortWithinPartitions(*by, "t", "y", "x").write.mode("overwrite").partitionBy(*by).parquet(path)


def write_frames(pixels: DataFrame, path: str, by: Sequence[str] = ("source_file", "m")) -> None:
    """Frames as Parquet partitioned by source and position, in T, Z, C order within; plane shapes must agree over channels.

    Lines are dealt by range, so that a position is spread over tasks; the
    names of its files follow the order.
    """
    shapes = pixels.groupBy("c").agg(F.max("y").alias("h"), F.max("x").alias("w")).select("h", "w").distinct().limit(2).count()
    if shapes > 1:
        raise ValueError("channels differ in plane shape")
    pixels.repartitionByRange(*by, "t", "z", "c", "y").sortWithinPartitions(*by, "t", "z", "c", "y", "x").write.mode("overwrite").partitionBy(*by).parquet(path)
