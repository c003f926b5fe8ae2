"""Grouped numpy work on many small groups at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def group_numbers(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """0, 1, ... for the runs of equal keys; nulls are equal."""
    fresh = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        fresh |= differ.to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.cumsum(fresh)]) if table.num_rows else np.zeros(0, dtype=np.int64)


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``fn`` over the rows of whole groups, many small groups in one call: it gets the rows, in order within their groups, and each row's group number.

    Rows are dealt and sorted by ``keys``; a task holds a batch of rows and
    the group that the batch ends in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            number = group_numbers(table, keys)
            whole = int(np.searchsorted(number, number[-1]))
            held = table.slice(whole)
            if whole:
                yield from fn(table.slice(0, whole), number[:whole]).to_batches()
        if held is not None:
            yield from fn(held, np.zeros(held.num_rows, dtype=np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
