"""Compaction of a log and the indexes over it.

A log has columns key (padded), idx (unique), value (payload). Defined cases: null keys are no records; a null payload
takes no bytes; empty logs give empty results, or zeros where a total is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions.scalars import MISSING_OFFSET, record_bytes
from strandlog.operators.hot import join_on_keys
from strandlog.operators.live import latest
from strandlog.operators.ordered import numbered, over_preceding
from strandlog.sources.shared import cut


def log_offsets(log: DataFrame) -> DataFrame:
    """Each record, without its payload, with the byte at which it begins in the log (``offset``) and its length (``size``)."""
    return numbered(log.withColumn("size", record_bytes(F.col("value"))).drop("value"), ["idx"], {"offset": F.col("size")}).drop("rn")


def compact(log: DataFrame, payload: bool = True) -> DataFrame:
    """The newest record per key in key order, with its position and byte offset in the compacted segment."""
    if payload:
        live = latest(log, "value").withColumn("size", record_bytes(F.col("value")))
    else:
        live = latest(log.withColumn("size", record_bytes(F.col("value"))), "size")
    return numbered(live, ["key"], {"offset": F.col("size")}).withColumnRenamed("rn", "position")


def key_index(records: DataFrame) -> DataFrame:
    """key -> offset of its newest record and the number ``n`` of its records, of records with offsets."""
    return records.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max_by("offset", "idx").alias("offset"), F.count("*").alias("n"))


def index_get(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Offset per asked key, -1 if the index lacks it."""
    return keys.join(index, "key", "left").select("key", F.coalesce("offset", F.lit(MISSING_OFFSET)).alias("offset"))


def liveness(records: DataFrame, index: DataFrame) -> DataFrame:
    """Each record with ``valid``: whether the index, which has all of its keys, points to it. Hot keys meet the index by broadcast."""
    stored = cut(index.select("key", F.col("offset").alias("_at"), "n"), "index")  # read for its hot and its other keys
    found = join_on_keys(records, stored, ["key"], "n", stored.agg(F.sum("n")).first()[0] or 0)
    return found.withColumn("valid", F.col("_at") == F.col("offset")).drop("_at", "n")


def rewrite_live(log: DataFrame) -> DataFrame:
    """Compaction by index agreement: the records to which the index points, rewritten in key order, with their new offsets.

    Liveness is decided on the records without their payload; only the live ones meet it, by idx.
    """
    records = log_offsets(log)
    live = liveness(records, key_index(records)).filter("valid").select("idx", F.col("offset").alias("old_offset"))
    kept = log.join(live, "idx").withColumn("size", record_bytes(F.col("value")))
    return numbered(kept, ["key"], {"offset": F.col("size")}).withColumnRenamed("rn", "position")


def garbage(log: DataFrame) -> DataFrame:
    """records, live_records, total_bytes, reclaimable_bytes."""
    sized = log.filter(F.col("key").isNotNull()).withColumn("size", record_bytes(F.col("value")))
    per = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max(F.struct("idx", "size"))["size"].alias("kept"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("live_records"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.col("total") - F.col("kept")), F.lit(0)).alias("reclaimable_bytes"))


def order_violations(segment: DataFrame, position: str = "position") -> DataFrame:
    """How often a key isn't greater than the one before it in the segment."""
    blocks, w = over_preceding(segment.withColumn("rn", F.col(position)), 1)
    bad = blocks.withColumn("_prev", F.lag("key").over(w)).filter(F.col("_own") & (F.col("key") <= F.col("_prev")))
    return bad.agg(F.count("*").alias("violations"))


def merged_runs(log: DataFrame, run: int) -> DataFrame:
    """Runs of ``run`` consecutive indexes, each with the newest record per key, merged without looking across runs."""
    r = F.floor(F.col("idx") / F.lit(run)).cast("long")
    return log.filter(F.col("key").isNotNull()).withColumn("run", r).groupBy("key", "run").agg(F.max(F.struct("idx", "value")).alias("m")).select("key", "run", "m.idx")


def map_bytes(live: DataFrame) -> DataFrame:
    """Estimate of an in-memory map of the records: 12 bytes, the key twice and the value for each."""
    return live.agg(F.count("*").alias("entries"), F.coalesce(F.sum(12 + 2 * F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).cast("long").alias("bytes"))


def needs_compaction(log: DataFrame, threshold: int) -> DataFrame:
    """total_bytes and whether they exceed the threshold."""
    return log.agg(F.coalesce(F.sum(record_bytes(F.col("value"))), F.lit(0)).alias("total_bytes")).withColumn("due", F.col("total_bytes") > F.lit(threshold))


def idle_gaps(log: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Records that come more than ``seconds`` after the one before: idx and gap in microseconds."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    blocks, w = over_preceding(numbered(log.select("idx", t.alias("t")), ["idx"]), 1)
    gap = F.col("t") - F.lag("t").over(w)
    return blocks.withColumn("gap_us", gap).filter(F.col("_own") & (F.col("gap_us") > seconds * 1_000_000)).select("idx", "gap_us")


def trimmed(log: DataFrame, applied: int) -> DataFrame:
    """Payloads of applied records replaced by the marker 'NULL'."""
    return log.withColumn("value", F.when(F.col("idx") <= applied, F.lit("NULL")).otherwise(F.col("value")))


def index_mismatches(records: DataFrame, segment: DataFrame) -> DataFrame:
    """Live records in log order against a copy of them by position: rows whose keys differ."""
    a = numbered(records.select("key", "idx"), ["idx"]).select("rn", F.col("key").alias("log_key"))
    b = numbered(segment.select("key", "idx"), ["idx"]).select("rn", F.col("key").alias("segment_key"))
    return a.join(b, "rn", "full").filter(~F.col("log_key").eqNullSafe(F.col("segment_key"))).agg(F.count("*").alias("mismatches"))


def schedule(activity: DataFrame, ts: str, every_minutes: int = 30, idle_seconds: int = 300, full: Column | None = None) -> DataFrame:
    """When a scheduler would start a compaction: slot (microseconds of its interval's start) and reason.

    One run per interval at most: the first reason of 'full' (a row where ``full`` holds), 'idle' (a gap of more than
    ``idle_seconds`` ends in the interval) and 'interval' (there was any activity). Rows without a time are left out.
    """
    rows = activity.filter(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), (F.coalesce(full, F.lit(False)) if full is not None else F.lit(False)).alias("full"))
    blocks, w = over_preceding(numbered(rows, ["t"]), 1)
    gap = F.col("t") - F.lag("t").over(w)
    step = every_minutes * 60_000_000
    marked = blocks.withColumn("idle", F.coalesce(gap > idle_seconds * 1_000_000, F.lit(False))).filter("_own").withColumn("slot", F.col("t") - F.pmod("t", F.lit(step)))
    per = marked.groupBy("slot").agg(F.max("full").alias("full"), F.max("idle").alias("idle"))
    return per.select("slot", F.when(F.col("full"), "full").when(F.col("idle"), "idle").otherwise("interval").alias("reason"))
