"""Per-key results where a few keys hold most of the rows.

Value-frequency compression: rows are first counted by (key, value), which spreads a hot key over its values
and combines repeats before the shuffle, and only then by key. Exact row counts, distinct counts, modes and
percentiles follow from the weighted values. Percentiles descend a tree of value ranges, ``STEP`` bits a level,
from the bits of the greatest value on, so that no task ever holds more than 2**(STEP + 1) entries of one key however many values it has.

Defined cases
    null key: such rows are left out (they belong to no key).
    null value: counts as a row, but not as a distinct value, mode or percentile.
    ties of modes: the least value. percentile p of n values: the value of rank ceil(p * n), 1 at least.
    key without values: null mode and percentile, distinct count 0. Empty table: empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.sources.shared import cut

#: Bits of a level of the percentile search.
STEP = 12


def compress(df: DataFrame, key: Column, value: Column, ts: Column | None = None) -> DataFrame:
    """(k, v, w): the rows of each key and value; with ``ts`` also its least and greatest, first_ts and last_ts."""
    rows = df.select(key.alias("k"), value.alias("v"), *([ts.alias("t")] if ts is not None else [])).filter(F.col("k").isNotNull())
    times = [F.min("t").alias("first_ts"), F.max("t").alias("last_ts")] if ts is not None else []
    return rows.groupBy("k", "v").agg(F.count("*").alias("w"), *times)


def modes(c: DataFrame, name: str) -> DataFrame:
    """The most frequent value per key, by one aggregate that combines before the shuffle."""
    best = F.min(F.struct((-F.col("w")).alias("order"), "v"))
    return c.filter(F.col("v").isNotNull()).groupBy("k").agg(best["v"].alias(name))


def percentiles(c: DataFrame, names: dict[str, float]) -> DataFrame:
    """Exact percentiles of integer values per key, one column per name. The compressed values are stored, as every level reads them."""
    c = cut(c.filter(F.col("v").isNotNull()).select("k", F.col("v").cast("long").alias("v"), "w"), "weights")
    least, greatest = c.agg(F.min("v"), F.max("v")).first()
    bits = max((x if x >= 0 else ~x).bit_length() for x in (least or 0, greatest or 0))
    shifts = list(range((max(bits, 1) - 1) // STEP * STEP, -1, -STEP))
    n = c.groupBy("k").agg(F.sum("w").alias("n"))
    want = n.select("k", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p))).cast("long").alias("rank")) for name, p in names.items()))).alias("x")).select("k", "x.name", "x.rank")
    at = want.select("k", "name", "rank", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("b"))
    for i, shift in enumerate(shifts):
        level = c.groupBy("k", F.shiftright("v", shift).alias("b")).agg(F.sum("w").alias("w"))
        parent = F.shiftright("b", STEP) if i else F.lit(0).cast("long")  # the first level has the sign, too
        level = level.withColumn("up", parent)
        w = Window.partitionBy("k", "up").orderBy("b")
        level = level.withColumn("cum", F.sum("w").over(w))
        near = at.select("k", F.col("b").alias("up"), "name", "rank", "below")
        hit = (F.col("below") + F.col("cum") >= F.col("rank")) & (F.col("below") + F.col("cum") - F.col("w") < F.col("rank"))
        at = level.join(near, ["k", "up"]).filter(hit).select("k", "name", "rank", (F.col("below") + F.col("cum") - F.col("w")).alias("below"), "b")
    return at.groupBy("k").agg(*(F.max(F.when(F.col("name") == name, F.col("b"))).alias(name) for name in names))


def key_rows(df: DataFrame, value: Column, key: str = "key") -> DataFrame:
    """(key, n): the rows of each padded key, summed from the weights of its values."""
    return compress(df, pad_key(key), value).groupBy(F.col("k").alias("key")).agg(F.sum("w").alias("n"))


def busy_keys(df: DataFrame, value: Column, share: float, key: str = "key") -> DataFrame:
    """Padded keys on at least ``share`` of the rows with a key: (key, n)."""
    rows = df.filter(F.col(key).isNotNull()).count()
    return key_rows(df, value, key).filter(F.col("n") >= F.lit(share) * F.lit(rows))


def key_profile(df: DataFrame, ts: Column, counted: Column, typical: Column, measured: Column, probs: dict[str, float], key: str = "key") -> DataFrame:
    """Per padded key: n, first_ts, last_ts, n_distinct of ``counted`` (by which the rows are compressed for these four), mode of
    ``typical``, percentiles of ``measured``."""
    k = pad_key(key)
    rows = compress(df, k, counted, ts).groupBy("k").agg(F.sum("w").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("v").alias("n_distinct"))
    parts = [rows, modes(compress(df, k, typical), "mode"), percentiles(compress(df, k, measured), probs)]
    out = reduce(lambda a, b: a.join(b, "k", "left"), parts)
    return out.withColumnRenamed("k", "key")
