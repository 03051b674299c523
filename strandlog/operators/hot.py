"""Joins that keep working when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one in so many rows; hence there are at most so many hot keys,
#: which bounds what is broadcast whatever the size of the table. With more shuffle partitions there are
#: ``PER_TASK`` for each of them, so that no other key fills a task, up to ``MOST``.
HOT_PARTS, PER_TASK, MOST = 1000, 4, 200_000


def hot_parts(df: DataFrame, parts: int | None = None) -> int:
    return parts or min(MOST, max(HOT_PARTS, PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def hot_rows(counts: DataFrame, n: str, total: int, parts: int | None = None) -> DataFrame:
    """Of a table with one row per key and its row count ``n``, the at most ``parts`` hot keys."""
    parts = hot_parts(counts, parts)
    return counts.filter(F.col(n) * F.lit(parts) >= F.lit(max(total, 1)))


def join_on_keys(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int,
                 extra: Column | None = None, parts: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which has one row per key and a row count ``n``.

    Rows of hot keys meet the hot part of ``per_key`` by broadcast and are never shuffled; all others are
    shuffled, and no key among them holds more than one in ``parts`` of the rows. Columns of ``per_key``
    other than the keys must not occur in ``rows``. Null keys match nothing.
    """
    parts = hot_parts(rows, parts)
    hot = F.broadcast(hot_rows(per_key, n, total, parts))
    cold = per_key.filter(F.col(n) * F.lit(parts) < F.lit(max(total, 1)))
    left = rows.join(hot, keys, "inner")
    right = rows.join(F.broadcast(hot_rows(per_key, n, total, parts).select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    both = left.unionByName(right)
    return both.filter(extra) if extra is not None else both
