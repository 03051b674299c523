"""The table that a put log describes: newest value per key, lookups, scans, and segments read by priority.

A log has columns key (padded), idx (unique, later wins), value. Segments are tables (key, value) with unique keys.
Defined cases: null keys name no key and are left out; a null or empty value is a value, except where a function says
that it counts as missing; with equal idx the greatest value is taken; an empty log is an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.keys import clean_op, pad_key
from strandlog.functions.scalars import ERR_NO_KEY, NO_KEY, OK, TERM_LOG


def latest(log: DataFrame, *columns: str) -> DataFrame:
    """Per key the row of the greatest idx: key, idx, columns. A partial aggregate combines a hot key before the shuffle."""
    picked = F.max(F.struct("idx", *columns)).alias("m")
    return log.filter(F.col("key").isNotNull()).groupBy("key").agg(picked).select("key", "m.idx", *(F.col(f"m.{c}").alias(c) for c in columns))


def without_noops(log: DataFrame, op: str = "op") -> DataFrame:
    """Drops the entries that a new leader writes to mark its term."""
    return log.filter(clean_op(op) != TERM_LOG.lower())


def get(live: DataFrame, keys: DataFrame, value: str = "value", miss_value: str = NO_KEY, empty_is_missing: bool = False) -> DataFrame:
    """key, err, value for each of ``keys`` (column key, in any padding). Misses answer ``ErrNoKey`` and ``miss_value``."""
    asked = keys.select(F.col("key").alias("asked"), pad_key("key").alias("key"))
    found = asked.join(live.select("key", F.col(value).cast("string").alias("_v"), F.lit(True).alias("_hit")), "key", "left")
    hit = F.col("_hit").isNotNull()
    if empty_is_missing:
        hit = hit & (F.coalesce(F.length("_v"), F.lit(0)) > 0)
    return found.select(F.col("asked").alias("key"), F.when(hit, OK).otherwise(ERR_NO_KEY).alias("err"), F.when(hit, F.col("_v")).otherwise(miss_value).alias("value"))


def between(key: Column | str, start: str, end: str) -> Column:
    """Inclusive range of padded keys; literal bounds reach the Parquet scan. start > end selects nothing."""
    c = F.col(key) if isinstance(key, str) else key
    return c.between(pad_literal(start), pad_literal(end))


def number_between(number: str, start: str, end: str) -> Column:
    """``between`` for the padded form of a whole number, with the bounds as numbers beside it, which reach the Parquet scan.

    Only numbers that are negative or have more than 10 digits may have a padded form in the range without lying in it.
    """
    padded = between(pad_key(number), start, end)
    if not (start.isdigit() and end.isdigit() and len(start) <= 10 and len(end) <= 10):
        return padded
    n = F.col(number)
    return ((n >= int(start)) & (n <= int(end)) | (n < 0) | (n >= 10**10)) & padded


def pad_literal(key: str, width: int = 10) -> str:
    return key[:width].rjust(width, "0")


def merge(newer: DataFrame, older: DataFrame) -> DataFrame:
    """All rows of ``newer``, and those of ``older`` whose key it lacks (column segment: 'new' or 'old')."""
    rest = older.join(newer.select("key"), "key", "left_anti")
    return newer.withColumn("segment", F.lit("new")).unionByName(rest.withColumn("segment", F.lit("old")))


def as_map(rows: DataFrame) -> DataFrame:
    """A scan's answer as one map; for answers that fit into a message only."""
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("pairs"))


def range_lookup(live: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Rows of ``live`` (numeric column k) in each of many ranges (columns range_id, lo, hi with hi - lo <= width).

    An equi-join on buckets of ``width``, two per range at most, instead of a comparison of every pair.
    """
    w = F.lit(width)
    bucketed = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / w), F.floor(F.col("hi") / w))))
    return live.withColumn("_b", F.floor(F.col("k") / w)).join(bucketed, "_b").filter(F.col("k").between(F.col("lo"), F.col("hi"))).drop("_b")
