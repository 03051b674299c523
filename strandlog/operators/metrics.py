"""Throughput and latency roll-ups, one named variant per way of measuring. MB are 1,000,000 bytes.

Input: one row per operation with client, ok (boolean), is_read, latency_ns, size, items (what a scan found). Two levels: per client, then
over clients. Defined cases: null or negative latencies, sizes and items count as 0; null ok is a failure; a group whose longest
client took no time has null throughput; a client without successes has no mean latency. Scans that failed or found nothing don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that two of the tools assume for each reply and each scanned item.
REPLY_BYTES, ITEM_BYTES = 1000, 4000
DIGITS = 6


def per_client(ops: DataFrame, groups: list[str]) -> DataFrame:
    positive = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0)
    lat, size = positive("latency_ns"), positive("size")
    ok, read = F.coalesce("ok", F.lit(False)), F.coalesce("is_read", F.lit(False))
    items = F.when(ok & read, positive("items")).otherwise(0)
    return ops.groupBy(*groups, "client").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("good"), F.sum(lat).alias("elapsed"), F.max(size).alias("size"), F.sum(items).alias("items"), F.count_if(items > 0).alias("scans"),
        F.sum(F.when(items > 0, lat).otherwise(0)).alias("scan_elapsed"), F.sum(items * size).alias("scanned"), F.sum(F.when(ok & ~read, size).otherwise(0)).alias("put"))


def rate(nbytes: Column, nanos: Column) -> Column:
    """MB per second; null if no time passed."""
    return F.when(nanos > 0, nbytes.cast("double") / 1e6 / (nanos.cast("double") / 1e9))


def variants() -> dict[str, tuple[Column, Column]]:
    """Throughput and mean latency (ns) of each way of measuring, as aggregates over ``per_client``."""
    c = F.col
    longest, clients = F.max("elapsed"), F.count("*")
    mean_good = F.avg(F.when(c("good") > 0, F.floor(c("elapsed") / c("good"))))
    mean_scan = F.sum(F.when(c("scans") > 0, F.floor(c("scan_elapsed") / c("scans"))).otherwise(0)) / clients
    nothing = F.lit(None).cast("double")
    return {
        "wall_clock": (rate(F.sum("good") * F.max("size"), longest), nothing),
        "mean_of_clients": (F.avg(rate(c("good") * c("size"), c("elapsed"))), mean_good),
        "longest_client": (rate(F.sum(c("good") * c("size")), longest), mean_good),
        "fixed_reply": (rate(F.sum("good") * REPLY_BYTES, longest), nothing),
        "fixed_item": (rate(F.sum("items") * ITEM_BYTES, longest), nothing),
        "scan_clients": (rate(F.sum("scanned"), F.max("scan_elapsed")), mean_scan),
        "mixed": (rate(F.sum("good") * F.max("size"), longest), F.sum(F.when(c("good") > 0, c("elapsed") / c("good")).otherwise(0)) / clients),
        "load_all_operations": (rate(F.sum("n") * F.max("size"), longest), F.sum("elapsed") / F.sum("n")),
        "scan_mix": (rate(F.sum("put") + F.sum("scanned"), F.max("scan_elapsed")), mean_scan),
    }


def rollup(ops: DataFrame, groups: list[str]) -> DataFrame:
    """(groups..., variant, mb_per_s, latency_ns) in one pass over the operations."""
    v = variants()
    wide = per_client(ops, groups).groupBy(*groups).agg(*(x.alias(f"{name}_{i}") for name, pair in v.items() for i, x in enumerate(pair)))
    rows = F.array(*(F.struct(F.lit(name).alias("variant"), F.round(f"{name}_0", DIGITS).alias("mb_per_s"), F.round(f"{name}_1", DIGITS).alias("latency_ns")) for name in v))
    return wide.select(*groups, F.inline(rows))


def repeated(ops: DataFrame, groups: list[str], run: str) -> DataFrame:
    """Mean over runs of each run's throughput by its longest client."""
    each = per_client(ops, [*groups, run]).groupBy(*groups, run).agg(rate(F.sum(F.col("good") * F.col("size")), F.max("elapsed")).alias("_r"))
    return each.groupBy(*groups).agg(F.round(F.avg("_r"), DIGITS).alias("mb_per_s"), F.count("*").alias("runs"))


def measured_means(ops: DataFrame, groups: list[str], least: int = 100) -> DataFrame:
    """Mean latency where more than ``least`` measurements exist."""
    return ops.filter("latency_ns >= 0").groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg("latency_ns"), DIGITS).alias("mean_ns")).filter(F.col("n") > least)


def client_throughput(ops: DataFrame) -> DataFrame:
    """Of ops (client, t in microseconds, size): all bytes over the longest client's span."""
    per = ops.groupBy("client").agg(F.sum("size").alias("b"), (F.max("t") - F.min("t")).alias("e"))
    return per.agg(F.sum("b").alias("total_bytes"), F.max("e").alias("max_elapsed_us")).withColumn("mb_per_s", F.round(F.col("total_bytes").cast("double") / F.col("max_elapsed_us"), DIGITS))


def wall_clock(ops: DataFrame, groups: list[str]) -> DataFrame:
    """Of ops (groups..., ok, size, started, ended in microseconds): operations that succeeded, wall time, and MB per second if each moved the largest size.

    The clock runs from the first start to the last end; operations without either, or that end before they start, don't move it.
    """
    timed = F.col("ended") >= F.col("started")
    per = ops.groupBy(*groups).agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("good"), F.max(F.when(F.col("size") > 0, F.col("size")).otherwise(0)).alias("size"),
                                   (F.max(F.when(timed, F.col("ended"))) - F.min(F.when(timed, F.col("started")))).alias("wall_us"))
    return per.select(*groups, "good", "wall_us", F.round(rate(F.col("good") * F.col("size"), F.col("wall_us") * 1000), DIGITS).alias("mb_per_s"))


def mean_of_means(df: DataFrame, client: str, value: str) -> DataFrame:
    per = df.groupBy(client).agg(F.avg(value).alias("m"))
    return per.agg(F.round(F.avg("m"), DIGITS).alias("avg_of_avgs"), F.count("*").alias("clients"))
