"""Putting requests into a log: indexes, the schema of entries, and the response of a put."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.operators.ordered import numbered

#: The fields of an entry, and what file_version says before and after a compaction has begun.
ENTRY = "idx long, term long, op string, key string, value string, client_id long, seq_id long, file_version long"
OLD_FILE, NEW_FILE = -1, 1


def assign_index(requests: DataFrame, order: list[str], term: int = 1, first: int = 1, compacting: bool = False) -> DataFrame:
    """Requests as entries in the given total order, indexed from ``first``."""
    return numbered(requests, order).select(
        (F.col("rn") + first).alias("idx"), F.lit(term).alias("term"), "op", pad_key("key").alias("key"), "value", "client_id", "seq_id",
        F.lit(NEW_FILE if compacting else OLD_FILE).alias("file_version"))


def by_file(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, old): the entries written since a compaction has begun, and those before; a null version is old."""
    new = F.coalesce(F.col("file_version") == NEW_FILE, F.lit(False))
    return log.filter(new), log.filter(~new)
