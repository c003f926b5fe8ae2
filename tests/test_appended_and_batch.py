"""Results appended as positions finish, and batch jobs that go on past what fails."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack import registry
from lumastack.functions.graph import written
from lumastack.plans import analyses, jobs
from lumastack.streaming import events

from .test_operators import SCHEMA, stack

RNG = np.random.default_rng(12)
H = W = 12


def frames(spark, positions, times=3):
    """Random planes: positions of one file, ``times`` frames each."""
    rows = [("s", m, t, 0, "c", y, x, int(v)) for m in positions for t in range(times) for (y, x), v in np.ndenumerate(RNG.integers(0, 4000, (H, W)))]
    return spark.createDataFrame(rows, SCHEMA)


def measured(px):
    """A1, then A6: the job of the appended results."""
    found = registry.ANALYSES["histogram_threshold"](px, high=85, height=H, width=W)
    return analyses.full_measurements(found["labels"], px, ["c"])


def table(df):
    columns = sorted(df.columns)
    return sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in columns]) for r in df.collect())


class Stream:
    """Frames put down batch by batch, landed and measured after each."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.options, self.dirs = spark, options, {k: str(tmp_path / k) for k in ("in", "landed", "out", "cp1", "cp2")}

    def put(self, df):
        df.coalesce(1).write.mode("append").parquet(self.dirs["in"])
        self.go()

    def go(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.dirs["in"])
        events.land(stream, self.dirs["landed"], self.dirs["cp1"]).trigger(availableNow=True).start().awaitTermination()
        events.append_finished(self.spark, self.dirs["landed"], SCHEMA, measured, self.dirs["out"], self.dirs["cp2"], **self.options).awaitTermination()

    def result(self):
        return self.spark.read.parquet(self.dirs["out"])


def test_positions_are_measured_once_complete_and_again_when_late(spark, tmp_path):
    px = written(frames(spark, [0, 1]), "px")
    wanted = px.groupBy("source_file", "m").agg(F.count_distinct("t").alias("want_planes")).withColumn("want_pixels", F.lit(H * W))
    s = Stream(spark, tmp_path, planes=wanted)
    half = (F.col("y") < 5) & (F.col("t") == 1)
    s.put(px.where("m = 1 OR t = 0"))  # position 1 is complete, 0 has a frame
    assert {r.m for r in s.result().select("m").distinct().collect()} == {1}
    first = table(s.result())
    s.put(px.where((F.col("m") == 0) & half))  # part of a frame only
    assert table(s.result()) == first
    s.put(px.where((F.col("m") == 0) & (F.col("t") > 0) & ~half))
    assert table(s.result()) == table(measured(px))
    # a batch that runs again leaves the same rows
    shutil.rmtree(f"{s.dirs['cp2']}/commits")
    s.go()
    assert table(s.result()) == table(measured(px))
    # a late frame of a finished position
    late = written(frames(spark, [0], 4).where("t = 3"), "late")
    s.put(late)
    assert table(s.result()) == table(measured(px.unionByName(late)))


def test_positions_without_a_plan_finish_when_idle(spark, tmp_path):
    px = written(frames(spark, [0, 1]), "px")
    s = Stream(spark, tmp_path, idle_ms=1, delay="0 seconds")
    s.put(px.where("m = 0"))
    s.put(px.where("m = 1 AND t < 2"))
    s.put(px.where("m = 1 AND t = 2"))
    s.put(frames(spark, [7], 1))  # moves the watermark on
    assert table(s.result().where("m < 2")) == table(measured(px))
    with pytest.raises(ValueError):
        events.finished(px.withColumn("arrived", F.current_timestamp()))


def test_appended_results_keep_frames_of_later_batches(spark, tmp_path):
    rows = [("a", 0, t, t * 3) for t in range(6)] + [("b", 1, 0, 50)]
    src, out, ledger, cp = (str(tmp_path / n) for n in ("in", "out", "ledger", "cp"))
    form = "source_file string, m int, t int, v int"
    job = lambda d: d.groupBy("source_file", "m").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    for part in (rows[:1], rows[1:4], rows[4:]):
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").parquet(src)
        events.append_results(spark.readStream.schema(form).parquet(src), job, out, ledger, ["source_file", "m"], cp).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.source_file, r.m, r.n, r.s) for r in spark.read.parquet(out).collect()) == [("a", 0, 6, 45), ("b", 1, 1, 50)]


# --- batch


@pytest.fixture
def touchy(monkeypatch):
    """An analysis that fails while it runs, for one position, and counts its runs."""
    calls = []

    def run(px, **params):
        calls.append(sorted({(r.source_file, r.m) for r in px.select("source_file", "m").distinct().collect()}))
        checked = px.withColumn("v", F.when((F.col("source_file") == "b") & (F.col("m") == 1), F.raise_error(F.lit("no signal"))).otherwise(F.col("v")).cast("int"))
        return registry.ANALYSES["histogram_threshold"](checked, **params)

    monkeypatch.setitem(registry.ANALYSES, "touchy", run)
    return calls


def files(spark):
    a = stack(spark, np.arange(64).reshape(8, 8))
    parts = [a.withColumns({"source_file": F.lit(f), "m": F.lit(m)}) for f in "abc" for m in (0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PARAMS = {"high": 90, "height": 8, "width": 8}


def ids(regions):
    return sorted((r.source_file, r.m, r.t, r.c, r.label_id) for r in regions.collect())


def test_a_file_whose_analysis_fails_leaves_the_others_whole(spark, tmp_path, touchy):
    px = written(files(spark), "files")
    got = jobs.run_batch(spark, px, [], "touchy", PARAMS, str(tmp_path / "out"))
    assert [(r.source_file, r.m) for r in got["errors"].collect()] == [("b", 1)] and "no signal" in got["errors"].first().error
    rest = px.where("NOT (source_file = 'b' AND m = 1)")
    assert ids(got["regions"]) == ids(registry.ANALYSES["histogram_threshold"](rest, **PARAMS)["regions"])
    states = {(r.source_file, r.m): r.status for r in got["ledger"].collect()}
    assert len(states) == 6 and [k for k, v in states.items() if v == "failed"] == [("b", 1)]
    # only the failed position is tried again
    del touchy[:]
    again = jobs.run_batch(spark, px, [], "touchy", PARAMS, str(tmp_path / "out"))
    assert touchy == [[("b", 1)]] and ids(again["regions"]) == ids(got["regions"])


@pytest.mark.parametrize("group", [1, 4])
def test_a_run_stopped_before_its_ledger_doubles_nothing(spark, tmp_path, group):
    px = written(files(spark), "files")
    out = str(tmp_path / "out")
    first = ids(jobs.run_batch(spark, px, [], "histogram_threshold", PARAMS, out, group=group)["regions"])
    for ledger in (tmp_path / "out").glob("_ledger*"):
        shutil.rmtree(ledger)  # as if it had been stopped between the regions and the ledger
    again = jobs.run_batch(spark, px, [], "histogram_threshold", PARAMS, out, group=group)
    assert ids(again["regions"]) == first and len(first) == len(set(first)) == 6


def test_batch_errors_that_concern_all_are_raised(spark, tmp_path):
    with pytest.raises(KeyError):
        jobs.run_batch(spark, files(spark), [("nothing", {})], "histogram_threshold", PARAMS, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        jobs.run_batch(spark, files(spark), [], "nothing", PARAMS, str(tmp_path / "out"))
    empty = jobs.run_batch(spark, files(spark).where("m > 9"), [], "histogram_threshold", PARAMS, str(tmp_path / "out"))
    assert all(empty[k].count() == 0 for k in ("regions", "errors", "ledger"))
