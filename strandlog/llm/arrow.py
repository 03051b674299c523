"""Bounded Arrow batches for functions over whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch; a batch of long texts ends at the bytes.
BATCH_ROWS, BATCH_BYTES = 4000, 32 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of the session, so that a worker never holds a whole partition of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
