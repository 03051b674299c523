"""Workloads as tables, generated from row numbers and a seed, so that every engine and run makes the same ones.

Nothing is drawn at random: digests of (seed, row number) take the place of generators, and a shuffle is an order by digest.
Sizes are parameters and may be as large as a long; 0 rows give empty tables.
"""

from __future__ import annotations

from math import log1p

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.scalars import digest, random_key
from strandlog.operators.live import latest
from strandlog.operators.ordered import numbered
from strandlog.sources.shared import cut

#: Skew of the Zipf reads, and keys of the scanned ranges.
ZIPF_S, ZIPF_V = 1.01, 1.0
#: Zipf weights are whole parts of one in ZIPF_UNIT, where the least rank has LEAST_WEIGHT of them at least; else the least rank gets ZIPF_UNIT.
ZIPF_UNIT, LEAST_WEIGHT = 1e6, 100
SCAN_WIDTH = 100


def random_writes(spark: SparkSession, n: int, digits: int = 5) -> DataFrame:
    """op_id, key of digits from 1 to 9."""
    return spark.range(n).select(F.col("id").alias("op_id"), random_key(digits, F.col("id")).alias("key"))


def shuffled_slices(spark: SparkSession, keys: int, clients: int) -> DataFrame:
    """A shuffled permutation of [0, keys), cut into equal consecutive slices: pos, key, client."""
    order = spark.range(keys).select(F.col("id").alias("key"), digest("shuffle", F.col("id")).alias("h"))
    each = max(1, -(-keys // clients))
    return numbered(order, ["h", "key"]).select(F.col("rn").alias("pos"), "key", F.floor(F.col("rn") / F.lit(each)).cast("long").alias("client"))


def sequential_writes(spark: SparkSession, clients: int, base: int) -> DataFrame:
    """client, j, key = client * base + j."""
    return spark.range(clients * base).select(F.floor(F.col("id") / base).cast("long").alias("client"), (F.col("id") % base).alias("j"), F.col("id").alias("key"))


def uniform_reads(spark: SparkSession, n: int, keys: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("op_id"), (digest("uniform", F.col("id")) % F.lit(keys)).alias("key"))


def zipf_weight(k: Column) -> Column:
    return F.pow(F.lit(ZIPF_V) + k, F.lit(-ZIPF_S))


def zipf_mass(ranks: DataFrame, k: str) -> DataFrame:
    """k and its share of the reads."""
    total = ranks.agg(F.sum(zipf_weight(F.col(k)))).first()[0]
    return ranks.select(F.col(k).alias("k"), F.round(zipf_weight(F.col(k)) / F.lit(total), 12).alias("p"))


def zipf_scale(keys: int) -> float:
    """Factor of the weights of ranks [0, keys): no rank is rounded away, and the sum stays below 2^61."""
    least = (ZIPF_V + keys) ** -ZIPF_S
    return ZIPF_UNIT if ZIPF_UNIT * least >= LEAST_WEIGHT else min(ZIPF_UNIT / least, 2**61 / (1 + log1p(keys)))


def zipf_reads(spark: SparkSession, n: int, keys: int, buckets: int | None = None) -> DataFrame:
    """n reads of ranks [0, keys) by inverse distribution over whole-numbered weights.

    Draws and ranks meet in buckets of the weight range, as many as bound the ranks a draw meets; a heavy rank spans many
    buckets and so many tasks. Draws have 32 bits where the weights' sum is far below that, else 62.
    """
    scale = zipf_scale(keys)
    ranks = spark.range(keys).select(F.col("id").alias("rank"), F.floor(zipf_weight(F.col("id")) * scale).cast("long").alias("w"))
    cum = cut(numbered(ranks, ["rank"], {"lo": F.col("w")}).select("rank", "lo", (F.col("lo") + F.col("w")).alias("hi")), "zipf")
    total = cum.agg(F.max("hi")).first()[0] or 1
    width = max(1, -(-total // (buckets or max(4096, keys // 64))))
    spans = cum.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    drawn = digest("zipf", F.col("id"))
    if scale != ZIPF_UNIT:
        drawn = F.shiftleft(digest("zipf-high", F.col("id")).bitwiseAND(F.lit((1 << 30) - 1)), 32).bitwiseOR(drawn)
    draws = spark.range(n).select(F.col("id").alias("op_id"), (drawn % F.lit(total)).alias("u"))
    met = draws.withColumn("b", F.floor(F.col("u") / width)).join(spans, "b").filter("u >= lo and u < hi")
    return met.select("op_id", F.col("rank").alias("key"))


def scan_ranges(spark: SparkSession, n: int, starts: int, width: int = SCAN_WIDTH) -> DataFrame:
    """range_id, lo, hi: ``width`` + 1 keys each; where the bounds are out of order as unpadded text the range is empty."""
    start = digest("scan", F.col("id")) % F.lit(starts)
    r = spark.range(n).select(F.col("id").alias("range_id"), start.alias("lo")).withColumn("hi", F.col("lo") + width)
    return r.withColumn("reversed", F.col("lo").cast("string") > F.col("hi").cast("string"))


def scan_mix(spark: SparkSession, n: int, write_share: float, last_key: int, width: int = SCAN_WIDTH) -> DataFrame:
    """op_id, is_write, lo, hi: writes of one key, and scans of ``width`` + 1 keys of which none lies behind ``last_key``."""
    mixed = operation_mix(spark, n, write_share, last_key + 1)
    return mixed.select("op_id", "is_write", F.col("key").alias("lo"), F.when(F.col("is_write"), F.col("key")).otherwise(F.least(F.col("key") + width, F.lit(last_key))).alias("hi"))


def operation_mix(spark: SparkSession, n: int, write_share: float, keys: int) -> DataFrame:
    """op_id, is_write, key: exactly round(share * n) writes in shuffled places; writes permute the keys, reads redraw."""
    writes = round(write_share * n)
    order = spark.range(n).select(F.col("id").alias("op_id"), digest("mix", F.col("id")).alias("h"))
    placed = numbered(order, ["h", "op_id"])
    is_write = F.col("rn") < writes
    key = F.when(is_write, F.col("rn") % F.lit(keys)).otherwise(digest("mix-read", F.col("op_id")) % F.lit(keys))
    return placed.select("op_id", is_write.alias("is_write"), key.alias("key"))


def load_inserts(spark: SparkSession, n: int, write_share: float, read_keys: int, first_key: int) -> DataFrame:
    """op_id, is_write, key: writes take the keys from ``first_key`` on, one each, reads draw below ``read_keys``."""
    mixed = operation_mix(spark, n, write_share, max(1, n))
    read = digest("load-read", F.col("op_id")) % F.lit(read_keys)
    return mixed.select("op_id", "is_write", F.when(F.col("is_write"), F.col("key") + first_key).otherwise(read).alias("key"))


def every_nth(df: DataFrame, ident: str, n: int) -> DataFrame:
    """Adds is_write: one row in n by its id."""
    return df.withColumn("is_write", F.col(ident) % n == 0)


def read_modify_write(log: DataFrame, keys: DataFrame, step: int) -> DataFrame:
    """The log's newest record of each key in ``keys`` written again as a version with idx + step; missing keys fail and write nothing."""
    return latest(log, "value").join(keys.select("key").distinct(), "key", "left_semi").withColumn("idx", F.col("idx") + step)
