"""Recipes and batch jobs: steps in order, files by positions, a ledger of what is done."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbour  # noqa: F401  registers its steps
from ..operators.joins import pending
from ..registry import ANALYSES, STEPS


def apply_recipe(pixels: DataFrame, steps: Sequence[tuple[str, dict]], normalise: bool = False, skip_unknown: bool = False) -> DataFrame:
    """Apply named steps in order, after frame-mean normalisation if asked. Unknown steps raise, or are skipped if so wanted."""
    if normalise:
        pixels = STEPS["frame_mean_normalise"](pixels)
    for name, params in steps:
        if name not in STEPS:
            if skip_unknown:
                continue
            raise KeyError(f"unknown step {name!r}; known: {sorted(STEPS)}")
        pixels = STEPS[name](pixels, **params)
    return pixels


def job_key(steps: Sequence[tuple[str, dict]], analysis: str, params: dict) -> str:
    """Names a configuration: 16 hex digits of its JSON."""
    return hashlib.sha256(json.dumps([list(map(list, steps)), analysis, params], sort_keys=True, default=str).encode()).hexdigest()[:16]


LEDGER = "source_file string, m int, job string, status string"
POSITION = ["source_file", "m"]
#: Positions that are run in one plan. If it fails, it is halved until the positions that fail stand alone.
GROUP = 64


def run_batch(
    spark: SparkSession, pixels: DataFrame, steps: Sequence[tuple[str, dict]], analysis: str, params: dict, out: str, ledger: DataFrame | None = None, depth: int = 12, group: int = GROUP
) -> dict[str, DataFrame]:
    """Recipe, analysis and regions over all files and positions; what fails doesn't stop the rest.

    Positions (source_file, m) are run in order, ``group`` in one plan, whose
    scan is narrowed to their files. Regions replace the positions' partitions
    in a folder of this configuration, then the positions are entered in the
    ledger beside them. So a run that stops anywhere and is repeated goes on
    behind the last entry and doubles no region. A plan that raises is halved
    until the failing positions are found; their error is entered, the others
    are run. Positions whose pixels are null or beyond ``depth`` bits fail
    beforehand. Positions that the folder's ledger or ``ledger`` has as done
    for this configuration are left out; failed ones are tried again.

    Gives ``regions`` (all of this configuration), ``errors``
    (``source_file, m, error``) and ``ledger`` (``LEDGER``) of this run.
    """
    if unknown := [n for n, _ in steps if n not in STEPS]:
        raise KeyError(f"unknown steps {unknown}; known: {sorted(STEPS)}")
    if analysis not in ANALYSES:
        raise KeyError(f"unknown analysis {analysis!r}; known: {sorted(ANALYSES)}")
    job = job_key(steps, analysis, params)
    place, book = f"{out}/job={job}", f"{out}/_ledger-{job}"
    entries = f"{LEDGER}, error string, run string"
    run = uuid.uuid4().hex
    earlier = spark.read.schema(entries).parquet(book) if _exists(spark, book) else None
    for known in (ledger, earlier):
        if known is not None:
            pixels = pending(pixels, known.where((F.col("job") == job) & (F.col("status") == "done")), POSITION)

    def enter(rows: list[tuple]) -> None:
        if rows:
            spark.createDataFrame([(*r[:2], job, *r[2:], run) for r in rows], entries).coalesce(1).write.mode("append").parquet(book)

    # one row a position, in order: which positions there are, and which can't be measured
    units = pixels.where("source_file IS NOT NULL AND m IS NOT NULL").groupBy(*POSITION).agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.max("v").alias("top")).orderBy(*POSITION)
    schema = None

    def attempt(keys: list[tuple]) -> None:
        nonlocal schema
        # plain conditions reach the scan, and rows of other positions never reach the analysis
        by_file = {f: [m for _, m in group_] for f, group_ in itertools.groupby(keys, lambda k: k[0])}
        part = pixels.where(functools.reduce(lambda a, b: a | b, [(F.col("source_file") == f) & F.col("m").isin(ms) for f, ms in by_file.items()]))
        try:
            regions = ANALYSES[analysis](apply_recipe(part, steps), **params)["regions"]
            regions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*POSITION).parquet(place)
            schema = regions.schema
        except Exception as e:  # whatever the analysis raises belongs to its positions
            if len(keys) == 1:
                enter([(*keys[0], "failed", f"{type(e).__name__}: {e}"[:2000])])
                return
            attempt(keys[: len(keys) // 2])
            attempt(keys[len(keys) // 2 :])
            return
        enter([(*k, "done", None) for k in keys])

    for chunk in itertools.batched(units.toLocalIterator(), group):
        bad = {r for r in chunk if r.nulls or r.top >= 2**depth}
        enter([(r.source_file, r.m, "failed", "null intensities" if r.nulls else "intensities beyond the bit depth") for r in bad])
        if good := [(r.source_file, r.m) for r in chunk if r not in bad]:
            attempt(good)

    told = spark.read.schema(entries).parquet(book).where(F.col("run") == run) if _exists(spark, book) else spark.createDataFrame([], entries)
    if _exists(spark, place):
        regions = spark.read.schema(schema).parquet(place) if schema else spark.read.parquet(place)
    else:
        regions = spark.createDataFrame([], "source_file string, m int")
    return {"regions": regions, "errors": told.where("status = 'failed'").select(*POSITION, "error"), "ledger": told.select(*POSITION, "job", "status")}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
