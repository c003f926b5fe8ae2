"""Operators over event logs, as batch and as Structured Streaming: debounce, upgrade, latency, appended results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window


def debounce(events: DataFrame, key: str, gap_ms: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last event of each burst: none of its key follows within the gap."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    return events.where(F.col(ts).isNotNull()).withColumn("next_", nxt).where(
        F.col("next_").isNull() | (F.unix_micros(F.col("next_").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) >= gap_ms * 1000)
    ).drop("next_")


def debounce_stream(events: DataFrame, key: str, gap_ms: int, delay: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same over a stream: session windows per key; a burst is given out when the watermark has passed it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    last = timed.groupBy(F.session_window(ts, f"{gap_ms} milliseconds").alias("burst"), key).agg(F.max(F.struct(ts, tie)).alias("last_"))
    return last.select(key, F.col(f"last_.{ts}").alias(ts), F.col(f"last_.{tie}").alias(tie))


def upgrade(events: DataFrame, key: str, generic: str, rich: str, within_ms: int, ts: str = "ts", kind: str = "event_type", tie: str = "event_id") -> DataFrame:
    """Drop a generic event that a rich one of its key follows at once, less than the limit later."""
    line = Window.partitionBy(key).orderBy(ts, tie)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    marked = events.withColumns({"k_": F.lead(kind).over(line), "t_": F.lead(ts).over(line)})
    gone = (F.col(kind) == generic) & (F.col("k_") == rich) & (micros(F.col("t_")) - micros(F.col(ts)) < within_ms * 1000)
    return marked.where(~F.coalesce(gone, F.lit(False))).drop("k_", "t_")


def upgrade_stream(events: DataFrame, key: str, generic: str, rich: str, within_ms: int, delay: str, ts: str = "ts", kind: str = "event_type", tie: str = "event_id") -> DataFrame:
    """The same over a stream: one pending generic event per key waits until the next event, or until the watermark is past its time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [key, ts, kind, tie]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in timed.schema)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get if state.exists else None
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((group[0], pd.Timestamp(waiting[0], unit="us"), generic, waiting[1]))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values([ts, tie])
            for at, what, who in zip(rows[ts], rows[kind], rows[tie]):
                us = int(at.value // 1000) if at.unit == "ns" else int(at.timestamp() * 1e6)
                if waiting is not None and not (what == rich and us - waiting[0] < within_ms * 1000):
                    out.append((group[0], pd.Timestamp(waiting[0], unit="us"), generic, waiting[1]))
                waiting = None
                if what == generic:
                    waiting = (us, int(who))
                else:
                    out.append((group[0], at, what, who))
            if waiting is None:
                if state.exists:
                    state.remove()
            else:
                state.update(waiting)
                state.setTimeoutTimestamp(max(waiting[0] // 1000 + within_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    return timed.groupBy(key).applyInPandasWithState(run, schema, "us long, who long", "append", GroupStateTimeout.EventTimeTimeout)


def latency_counts(log: DataFrame, window: str, delay: str | None = None, ts: str = "ts", event: str = "event_type", value: str = "value") -> DataFrame:
    """How often each value occurs per event and tumbling window: ``window_start, event, value, n``. With ``delay``, over a stream: a window comes out once, when the watermark has passed it."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay:
        timed = timed.withWatermark(ts, delay)
    counts = timed.where(F.col(value).isNotNull()).groupBy(F.window(ts, window).alias("w"), F.col(event).alias("event"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event", "value", "n")


def latency_of_counts(counts: DataFrame) -> DataFrame:
    """``window_start, event, n, mean, p50, p99`` (nearest ranks, exact) from ``latency_counts``; no window's values meet in one task."""
    from ..operators.ranks import median_rank, nearest_ranks, p99_rank

    by = ["window_start", "event"]
    picked = nearest_ranks(counts, by, "value", count=F.col("n"), p50=median_rank, p99=p99_rank)
    mean = counts.groupBy(*by).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return picked.join(mean, by).select(*by, "n", "mean", "p50", "p99")


def latency_windows(log: DataFrame, window: str, ts: str = "ts", event: str = "event_type", value: str = "value") -> DataFrame:
    """Per event and tumbling window: n, mean, and the nearest-rank p50 and p99 of all values in it."""
    return latency_of_counts(latency_counts(log, window, None, ts, event, value))


def latency_stream(log: DataFrame, window: str, delay: str, out: str, checkpoint: str, **columns: str) -> DataStreamWriter:
    """The same over a stream: the state is a count for each value; the summary of each closed window is written to ``out``, once."""

    def run(closed: DataFrame, number: int) -> None:
        latency_of_counts(closed).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return latency_counts(log, window, delay, **columns).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows partitioned by ``keys``, replacing what the path has of these keys and nothing else; to write them again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_results(frames: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, ledger: str, keys: list[str], checkpoint: str) -> DataStreamWriter:
    """A stream of frames whose positions (``keys``) are measured whenever frames of theirs arrive.

    Each batch is kept under ``ledger``; then ``job`` runs over all frames so
    far of the positions that the batch touches, and its rows replace those
    positions' rows in ``out``. So frames of a position may come in any number
    of batches, in any order, and a batch that runs again leaves the same
    rows. ``append_finished`` measures a position once it is complete instead.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("ledger_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ledger_batch").parquet(ledger)
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in batch.schema)}, ledger_batch int"
        kept = spark.read.schema(schema).parquet(ledger).where(F.col("ledger_batch") <= number)
        touched = kept.where(F.col("ledger_batch") == number).select(*keys).distinct()
        upsert(job(kept.drop("ledger_batch").join(touched, keys, "left_semi")), out, keys)

    return frames.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


POSITION = ["source_file", "m"]
_PLANE = ["t", "z", "c"]
#: The state store that operators with timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(frames: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Write a stream of pixel rows to ``path``, each row once, partitioned by position."""
    return frames.writeStream.format("parquet").partitionBy(*POSITION).option("path", path).option("checkpointLocation", checkpoint)


def _count_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by([*POSITION, *_PLANE]).aggregate([([], "count_all"), ("arrived", "max")])
        counts = counts.select([*POSITION, *_PLANE, "count_all", "arrived_max"]).rename_columns([*POSITION, *_PLANE, "n", "arrived"])
        yield from counts.cast(pa.schema([*[batch.schema.field(k) for k in [*POSITION, *_PLANE]], ("n", pa.int64()), batch.schema.field("arrived")])).to_batches()


class _Progress(StatefulProcessor):
    """State of a position: pixels seen of each plane, and how many had been seen when it was last given out."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.planes = handle.getMapState("planes", "t int, z int, c string", "n long")
        self.told = handle.getValueState("told", "n long")

    def _give(self, key: tuple, seen: int, reason: str) -> Iterator[pd.DataFrame]:
        self.told.update((seen,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield pd.DataFrame([(*key, sum(1 for _ in self.planes.keys()), seen, reason)], columns=[*POSITION, "planes", "pixels", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, wanted, each = 0, None, None
        for pdf in rows:
            for t, z, c, n, w, e in zip(pdf.t, pdf.z, pdf.c, pdf.n, pdf.want_planes, pdf.want_pixels):
                plane = (int(t), int(z), c)
                before = self.planes.getValue(plane)
                self.planes.updateValue(plane, ((before[0] if before else 0) + int(n),))
                if not pd.isna(w):
                    wanted, each = int(w), int(e)
            last = max(last, int(pdf.arrived.max().timestamp() * 1000))
        counts = [n for (n,) in self.planes.values()]
        seen = sum(counts)
        if wanted is not None and sum(n >= each for n in counts) >= wanted:
            yield from self._give(key, seen, "late" if self.told.exists() else "complete")
        elif self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = sum(n for (n,) in self.planes.values())
        if not self.told.exists() or self.told.get()[0] != seen:
            yield from self._give(key, seen, "idle")

    def close(self) -> None:
        pass


def finished(frames: DataFrame, planes: DataFrame | None = None, idle_ms: int | None = None, delay: str = "1 minute") -> DataFrame:
    """The positions of a stream of pixel rows that are ready to be measured: ``source_file, m, planes, pixels, reason``.

    ``frames`` has ``arrived``, the time a row came in. A position is ready
    when all of its planes are whole (``complete``), again whenever more rows
    of it come after that (``late``), and, with ``idle_ms``, when nothing of
    it has come for that long by the watermark (``idle``). ``planes`` tells
    how much there is to come: ``source_file, m, want_planes, want_pixels``
    (pixels of a plane); positions it doesn't have are only ever idle. The
    state of a position is a count for each plane; pixels are counted before
    they are shuffled.
    """
    if planes is None and idle_ms is None:
        raise ValueError("give the planes to expect, or a time after which a position counts as finished")
    counted = frames.select(*POSITION, *_PLANE, "arrived").mapInArrow(_count_planes, _schema(frames, [*POSITION, *_PLANE]) + ", n long, arrived timestamp")
    if planes is None:
        counted = counted.withColumns({"want_planes": F.lit(None).cast("long"), "want_pixels": F.lit(None).cast("long")})
    else:
        counted = counted.join(planes.select(*POSITION, F.col("want_planes").cast("long"), F.col("want_pixels").cast("long")), POSITION, "left")
    timed = counted.withWatermark("arrived", delay)
    form = _schema(frames, POSITION) + ", planes long, pixels long, reason string"
    return timed.groupBy(*POSITION).transformWithStateInPandas(_Progress(idle_ms), form, "append", "eventTime")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def append_finished(
    spark: SparkSession, landed: str, schema: str, job: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, planes: DataFrame | None = None, idle_ms: int | None = None, delay: str = "1 minute", **options
) -> StreamingQuery:
    """Measure the positions of landed frames (``land``) as they become ready, and start doing so.

    Each time ``finished`` names a position, ``job`` runs over all of its
    landed frames and its rows replace the position's rows in ``out``. A
    batch that runs again replaces them by the same. ``options`` go to the
    stream's reader.
    """

    def run(ready: DataFrame, number: int) -> None:
        named = ready.select(*POSITION).distinct()
        upsert(job(spark.read.schema(schema).parquet(landed).join(named, POSITION, "left_semi")), out, POSITION)

    stream = spark.readStream.schema(schema).options(**options).parquet(landed).withColumn("arrived", F.col("_metadata.file_modification_time"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        return finished(stream, planes, idle_ms, delay).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
