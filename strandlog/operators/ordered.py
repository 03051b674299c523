"""Computations in one global order without one global task.

A window without partitions moves all rows to a single task. Here rows are shuffled once, into ranges of the order, sorted and
numbered inside their range by the task that writes them, and shifted by the totals of the ranges before, of which there are as many as
shuffle partitions, so that their table may be broadcast whatever the size of the data. Windows over a bounded number of
preceding rows then run in blocks of consecutive rows, each with copies of the last rows of the block before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.sources.shared import cut

#: Rows of a block of a window over preceding rows.
BLOCK = 50_000
#: Bits of a row's place inside its partition in monotonically_increasing_id.
PLACE_BITS = 33


def _with_running(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds for each name the sum of _size_<name> over the rows of the partition so far, as _run_<name>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for b in batches:
            sums = [np.cumsum(b.column(f"_size_{n}").to_numpy()) + so_far[n] for n in names]
            if b.num_rows:
                so_far = {n: int(s[-1]) for n, s in zip(names, sums)}
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums)], names=[*b.schema.names, *(f"_run_{n}" for n in names)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema + "".join(f", `_run_{n}` long" for n in names))


def numbered(df: DataFrame, order: list[str], sizes: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``rn`` (from 0) and, for each name in ``sizes``, the sum of that size over all earlier rows.

    The order must be total; equal rows are numbered in any order. Null sizes count as 0.
    """
    sizes = sizes or {}
    with_sizes = df.withColumns({f"_size_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sizes.items()}) if sizes else df
    ranged = with_sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = cut(_with_running(ranged, list(sizes)) if sizes else ranged, "ordered").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    totals = stored.groupBy("_part").agg(F.count("*").alias("_rows"), *(F.sum(f"_size_{n}").alias(f"_sum_{n}") for n in sizes))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    shift = totals.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sizes))
    out = stored.join(F.broadcast(shift), "_part").withColumn("rn", F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.col("_before"))
    for n in sizes:
        out = out.withColumn(n, F.col(f"_run_{n}") - F.col(f"_size_{n}") + F.col(f"_before_{n}"))
    return out.drop("_part", "_at", "_before", *(f"_{x}_{n}" for n in sizes for x in ("size", "run", "before")))


def over_preceding(df: DataFrame, rows: int, block: int = BLOCK):
    """(blocks, window): of a numbered table, blocks with the ``rows`` rows before each, and the window inside a block.

    Filter the result of the window by ``_own`` to drop the copies.
    """
    at = F.floor(F.col("rn") / F.lit(block))
    places = F.when(F.col("rn") % F.lit(block) >= F.lit(block - rows), F.array(at, at + 1)).otherwise(F.array(at))
    blocks = df.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == F.floor(F.col("rn") / F.lit(block)))
    return blocks, Window.partitionBy("_block").orderBy("rn")
