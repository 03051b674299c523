"""The most frequent values of a column, by external sort and run-length counting.

  1. Every task cuts its rows into runs of at most ``RUN`` rows, sorts each and counts its repeats; a value that a third
     of all rows hold becomes one row a run. The runs are stored in the shared folder.
  2. The runs are range-partitioned by value and sorted, so that equal values of all runs lie side by side.
  3. Each range merges its runs by adding the counts of neighbours, and keeps a heap of at most ``HEAP`` values.

The counts are exact; a task's memory is one run, one batch or one heap, whatever the number of distinct values.
A value on at least a share s of the rows is never lost if HEAP >= 1 / s, as there are at most 1 / s such values.

Defined cases: nulls aren't counted; ties are ordered by value; an empty column gives no rows. Only the named column is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.sources.shared import cut

#: Rows of a run, and values of a range's heap.
RUN, HEAP = 1_000_000, 2000
COUNTS = "value string, n long"


def _counted(values: pa.ChunkedArray | pa.Array) -> pa.RecordBatch:
    """One run: its distinct values in order, with counts."""
    c = pc.value_counts(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
    t = pa.table({"value": c.field(0), "n": c.field(1)}).sort_by("value").combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pydict({"value": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    rows = 0
    for b in batches:
        held.append(b.column(0))
        rows += b.num_rows
        if rows >= RUN:
            yield _counted(pa.chunked_array(held))
            held, rows = [], 0
    if rows:
        yield _counted(pa.chunked_array(held))


def merged_heap(heap_size: int):
    """A function of a sorted range: adds the counts of equal neighbours and keeps the most frequent values."""

    def order(x: tuple[str, int]) -> tuple[int, str]:
        return -x[1], x[0]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[tuple[str, int]] = []
        least = 0
        last: tuple[str, int] | None = None

        def offer(found: list[tuple[str, int]]) -> None:
            nonlocal top, least
            top = heapq.nsmallest(heap_size, top + found, key=order)
            least = top[-1][1] if len(top) == heap_size else 0

        for b in batches:
            if not b.num_rows:
                continue
            value, n = b.column(0), b.column(1).to_numpy()
            new = np.concatenate([[True], pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)]) if b.num_rows > 1 else np.array([True])
            start = np.flatnonzero(new)
            total = np.add.reduceat(n, start)
            if last is not None and value[0].as_py() == last[0]:
                total[0] += last[1]
            elif last is not None:
                offer([last] if last[1] >= least else [])
            last = value[int(start[-1])].as_py(), int(total[-1])  # may go on in the next batch
            good = np.flatnonzero(total[:-1] >= max(least, 1))
            if len(good) > heap_size:
                good = good[np.argsort(-total[good], kind="stable")[:heap_size]]  # values are in order, so ties are kept by value
            if len(good):
                offer(list(zip(value.take(pa.array(start[good])).to_pylist(), total[good].tolist())))
        if last is not None:
            offer([last])
        if top:
            yield pa.RecordBatch.from_pydict({"value": pa.array([x for x, _ in top], pa.string()), "n": pa.array([x for _, x in top], pa.int64())})

    return merge


def most_frequent(df: DataFrame, value: Column, heap_size: int = HEAP) -> DataFrame:
    """(value, n): of each range of values the at most ``heap_size`` most frequent ones with their rows."""
    rows = df.select(value.cast("string").alias("value")).filter(F.col("value").isNotNull())
    runs = cut(rows.mapInArrow(sorted_runs, COUNTS), "runs")
    return runs.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(merged_heap(heap_size), COUNTS)


def at_least(df: DataFrame, value: Column, share: float) -> DataFrame:
    """(value, n) of the values on at least ``share`` of the rows where it isn't null."""
    if HEAP * share < 1:
        raise ValueError("the heap is too small for this share")
    rows = df.select(value.alias("value")).filter(F.col("value").isNotNull()).count()
    return most_frequent(df, value).filter(F.col("n") >= F.lit(share) * F.lit(rows))


def top(df: DataFrame, value: Column, k: int) -> DataFrame:
    """(value, n) of the k most frequent values, ties by value."""
    return most_frequent(df, value, k).orderBy(F.desc("n"), "value").limit(k)
