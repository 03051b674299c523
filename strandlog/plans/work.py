"""Queries of metrics, workloads, the binary log, generations and streams, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.functions.scalars import clock_start, random_value, request_id
from strandlog.operators import compact, consensus, features, live, metrics, workload
from strandlog.plans import feeds
from strandlog.plans.kv import SEQUENCE, THRESHOLD, WINDOW, log, series
from strandlog.sources import vlog
from strandlog.sources.generations import Generations
from strandlog.sources.shared import age_files, new_path
from strandlog.sources.tables import table
from strandlog.streaming import latest as streams

#: Seconds after which a request counts as unanswered.
TIMEOUT = 3
#: Sizes of the generated workloads.
OPS, KEYS, CLIENTS = 20_000, 5_000, 16
#: Width of large scans, and the last key of mixed ones.
WIDE, LAST_KEY = 256_000, 38_062


def operations(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "workload_stats")
    return w.select("workload", "run_id", "client", F.col("success").alias("ok"), (~F.col("is_write")).alias("is_read"),
                    F.greatest("read_latency_ns", "write_latency_ns").alias("latency_ns"), F.col("value_size").cast("long").alias("size"),
                    (F.col("value_size") % 101).cast("long").alias("items"))  # the table has no number of items; this stands for it


def client_throughput(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return metrics.client_throughput(e.select(F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.octet_length("props").cast("long").alias("size")))


def wall_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Of each node's deliveries the throughput by the clock, from the first that was sent to the last received."""
    p = table(spark, d, "put_request")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return metrics.wall_clock(p.select("node_id", F.col("value").isNotNull().alias("ok"), F.octet_length("value").cast("long").alias("size"), us("send_ts").alias("started"), us("recv_ts").alias("ended")), ["node_id"])


def avg_of_avgs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_of_means(table(spark, d, "events"), "user_id", "value")


def metric_rollups(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rollup(operations(spark, d), ["workload"])


def repeated_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeated(operations(spark, d), ["workload"], "run_id")


def measured_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.measured_means(operations(spark, d), ["workload", "client"])


def op_mix(spark: SparkSession, d: str) -> DataFrame:
    return workload.every_nth(table(spark, d, "events"), "event_id", 20).groupBy("is_write").agg(F.count("*").alias("n"))


def rmw_last(spark: SparkSession, d: str) -> DataFrame:
    """Every key of the log read and written again."""
    rows = log(spark, d)
    return workload.read_modify_write(rows, rows, 1_000_000).select("key", "idx", "value")


def zipf_mass(spark: SparkSession, d: str) -> DataFrame:
    return workload.zipf_mass(table(spark, d, "part"), "p_partkey")


def gen_random_writes(spark: SparkSession, d: str) -> DataFrame:
    return workload.random_writes(spark, OPS)


def gen_shuffled_slices(spark: SparkSession, d: str) -> DataFrame:
    return workload.shuffled_slices(spark, KEYS, CLIENTS)


def gen_sequential_writes(spark: SparkSession, d: str) -> DataFrame:
    return workload.sequential_writes(spark, CLIENTS, 500)


def gen_uniform_reads(spark: SparkSession, d: str) -> DataFrame:
    return workload.uniform_reads(spark, OPS, KEYS)


def gen_zipf_reads(spark: SparkSession, d: str) -> DataFrame:
    return workload.zipf_reads(spark, OPS, KEYS)


def gen_scan_ranges(spark: SparkSession, d: str) -> DataFrame:
    return workload.scan_ranges(spark, 500, 10_000)


def scan_workload(spark: SparkSession, d: str) -> DataFrame:
    """Rows and value of the orders in generated ranges over all of their keys, one for every 20 orders; reversed ranges find nothing."""
    orders = table(spark, d, "orders")
    n = orders.count()
    ranges = workload.scan_ranges(spark, n // 20, max(1, n)).filter("not reversed")
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    found = live.range_lookup(o, ranges, workload.SCAN_WIDTH)
    return found.groupBy("range_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def gen_wide_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of 256,000 keys, as large scans take them."""
    return workload.scan_ranges(spark, 400, 6_300_000, WIDE).drop("reversed")


def wide_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows and value of the line items in ranges of 256,000 keys that begin below 20,000."""
    ranges = workload.scan_ranges(spark, 8, 20_000, WIDE).select("range_id", "lo", "hi")
    # Items are summed by key first, so that a range meets one row a key.
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    found = live.range_lookup(per, ranges, WIDE)
    return found.groupBy("range_id").agg(F.sum("n").alias("n"), F.sum("q").cast("double").alias("quantity"))


def gen_scan_mix(spark: SparkSession, d: str) -> DataFrame:
    return workload.scan_mix(spark, OPS, 0.05, LAST_KEY)


def scan_mix_items(spark: SparkSession, d: str) -> DataFrame:
    """Of mixed scans and writes over the orders, how many scans found how many items."""
    ops = workload.scan_mix(spark, OPS, 0.05, LAST_KEY)
    scans = ops.filter("not is_write").select(F.col("op_id").alias("range_id"), "lo", "hi")
    found = live.range_lookup(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), scans, workload.SCAN_WIDTH).groupBy("range_id").agg(F.count("*").alias("items"))
    each = ops.join(found, ops["op_id"] == found["range_id"], "left").select("is_write", F.coalesce("items", F.lit(0)).alias("items"))
    return each.groupBy("is_write", "items").agg(F.count("*").alias("n"))


def gen_operation_mix(spark: SparkSession, d: str) -> DataFrame:
    return workload.operation_mix(spark, OPS, 0.05, KEYS)


def gen_load_inserts(spark: SparkSession, d: str) -> DataFrame:
    return workload.load_inserts(spark, OPS, 0.5, 2_000_000, 2_000_001)


def gen_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(OPS).select("id", random_value(40, F.col("id")).alias("value"), request_id(F.col("id")).alias("req"))


def clock_starts(spark: SparkSession, d: str) -> DataFrame:
    c = clock_start(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.map_keys(c)[0].alias("node"), F.map_values(c)[0].alias("at"))


def vlog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """value_log written as binary files and read again: rows, bytes and a checksum of the payload."""
    vlog.register(spark)
    path = new_path(spark, "vlog")
    rows = table(spark, d, "value_log").select("idx", "term", "voted_for", "key", "value")
    rows.write.format("vlog").mode("append").save(path)
    back = spark.read.format("vlog").option("splitBytes", 1 << 20).load(path)
    return back.groupBy("key").agg(F.count("*").alias("n"), F.sum("value_size").alias("value_bytes"), F.sum(F.length("value")).alias("chars"), F.max("idx").alias("last_idx"))


def vlog_demo(spark: SparkSession, d: str) -> DataFrame:
    """The same in the layout of keys and values only, whose files are given split places afterwards."""
    vlog.register(spark)
    path = new_path(spark, "vlog")
    table(spark, d, "value_log").select("key", "value").write.format("vlog").option("layout", "demo").mode("append").save(path)
    vlog.index_splits(spark, path, True)
    back = spark.read.format("vlog").option("layout", "demo").option("splitBytes", 1 << 20).load(path)
    return back.groupBy("key").agg(F.count("*").alias("n"), F.sum("value_size").alias("value_bytes"), F.sum(F.length("value")).alias("chars"))


def value_deref(spark: SparkSession, d: str) -> DataFrame:
    """Values of a range of keys, fetched from the log by the offsets that the index of newest records has; one asked key is missing."""
    vlog.register(spark)
    path = new_path(spark, "vlog")
    log(spark, d).write.format("vlog").mode("append").save(path)
    heads = spark.read.format("vlog").load(path).drop("value")
    index = heads.groupBy("key").agg(F.max_by(F.struct("file", "file_offset"), "idx").alias("at"))
    asked = spark.createDataFrame([(str(k),) for k in (*range(10, 21), 999_999)], "key string").select(pad_key("key").alias("key"))
    found = asked.join(index, "key", "left").select("key", "at.file", F.coalesce("at.file_offset", F.lit(-1)).alias("file_offset"))
    return vlog.dereferenced(found, path).select("key", F.col("stored_key").isNotNull().alias("found"), F.col("stored_value").alias("value"))


def generations_view(spark: SparkSession, d: str) -> DataFrame:
    """Three generations appended, read merged, compacted, and one more on top."""
    g = Generations(spark, new_path(spark, "generations"))
    rows = log(spark, d)
    for part in (rows.filter("idx < 3000"), rows.filter("idx >= 3000 and idx < 6000")):
        g.append(part)
    g.compact()
    g.append(rows.filter("idx >= 6000"))
    return g.read()


def range_scan_stored(spark: SparkSession, d: str) -> DataFrame:
    """A range of keys of the compacted segment, whose order lets the scan skip most of it."""
    g = Generations(spark, new_path(spark, "generations"))
    g.append(log(spark, d))
    g.compact()
    return g.read().filter(live.between("key", "10", "20"))


def compaction_schedule(spark: SparkSession, d: str) -> DataFrame:
    return compact.schedule(table(spark, d, "events"), "ts", full=F.col("value") > 99.9)


def committed_reads(spark: SparkSession, d: str) -> DataFrame:
    """The newest value per key among the entries that a quorum of three streams has reached."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "error"))
    progress = e.groupBy("event_type").agg(F.max("event_id").alias("match"))
    commit = progress.agg(consensus.quorum_index(F.collect_list("match"))).first()[0]
    return live.latest(consensus.to_apply(log(spark, d), F.lit(-1), F.lit(commit)))


def _spooled(spark: SparkSession, src: DataFrame, order: str, files: int = 16) -> DataFrame:
    """A stream that reads a table in the order of a column, one of ``files`` files a micro-batch."""
    path = new_path(spark, "spool")
    src.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    age_files(spark, path)
    return streams.log_stream(spark, path, src.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1)


def stream_apply(spark: SparkSession, d: str) -> DataFrame:
    """The put log applied in order of arrival as a stream of micro-batches to a merge-on-read table."""
    stream = _spooled(spark, table(spark, d, "put_log"), "arrived_ts")
    target = new_path(spark, "applied")
    streams.apply_stream(stream, target, new_path(spark, "applied-checkpoint")).awaitTermination()
    return streams.read_applied(spark, target).select("group_id", "key", "idx")


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns all rows that it put out, with the number of their ``batch``."""
    out = new_path(spark, "drained")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", new_path(spark, "drained-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """Present keys and the index of their newest change, as the streaming aggregate put them out last."""
    rows = _drained(spark, streams.latest_stream(_spooled(spark, table(spark, d, "put_log"), "arrived_ts")), "update")
    last = rows.groupBy("group_id", "key").agg(F.max_by(F.struct("idx", "kind"), "batch").alias("m"))
    return last.filter("m.kind = 'set'").select("group_id", "key", "m.idx")


def stream_spells(spark: SparkSession, d: str) -> DataFrame:
    """Busy spells per group, without a gap of five minutes in arrivals, whose end the watermark has passed."""
    stream = _spooled(spark, table(spark, d, "put_log").filter("arrived_ts is not null"), "arrived_ts")
    return _drained(spark, streams.busy_spells(stream.withColumn("at", F.col("arrived_ts").cast("timestamp")), "at"), "append").select("group_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The requests (client, number) that a stream of deliveries lets through once each."""
    src = table(spark, d, "put_request").filter("client_id is not null and seq_id is not null and recv_ts is not null")
    stream = _spooled(spark, src.select("client_id", "seq_id", F.col("recv_ts").cast("timestamp").alias("at")), "at", 4)
    return _drained(spark, streams.once_per_session(stream, "at", "36500 days"), "append").select("client_id", "seq_id")


def stream_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Reads by whether their answer was logged within the time; those near the end of the stream wait for the watermark."""
    src = table(spark, d, "get_request").filter("req_ts is not null").groupBy("req_id").agg(F.min("req_ts").cast("timestamp").alias("sent"), F.min("logged_ts").cast("timestamp").alias("answered"))
    rows = src.select(F.col("req_id").alias("client_id"), F.lit(0).cast("long").alias("seq_id"), "sent", "answered")
    asked, answers = rows.drop("answered"), rows.filter("answered is not null").drop("sent")
    joined = streams.timeouts(_spooled(spark, asked, "sent", 1), _spooled(spark, answers, "answered", 1), "sent", "answered", TIMEOUT)
    return _drained(spark, joined, "append").filter("status = 'OK'").agg(F.count("*").alias("in_time"), F.max(F.unix_micros("answered") - F.unix_micros("sent")).alias("longest_us"))


def lstm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of sequences of 32 row windows, each by its time and its period, by a small network with fixed weights."""
    import numpy as np

    h, k = 8, 2
    rng = np.random.default_rng(7)
    weights = {"wx": rng.normal(0, 0.3, (4 * h, k)), "wh": rng.normal(0, 0.3, (4 * h, h)), "b": np.zeros(4 * h), "out": rng.normal(0, 0.3, h), "bias": 0.1}
    w = features.with_period(features.row_windows(series(spark, d), WINDOW, THRESHOLD))
    e = w.select(F.col("win").alias("idx"), F.array(F.col("read_time") / 1e15, F.col("period") / 1e9).alias("v"))
    return features.lstm_scores(features.sequences(e, SEQUENCE), weights).withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        client_throughput, wall_throughput, avg_of_avgs, metric_rollups, repeated_runs, measured_means, op_mix, rmw_last, zipf_mass, gen_random_writes, gen_shuffled_slices,
        gen_sequential_writes, gen_uniform_reads, gen_zipf_reads, gen_scan_ranges, gen_wide_ranges, gen_scan_mix, scan_workload, scan_mix_items, wide_scan, gen_operation_mix, gen_load_inserts, gen_values, clock_starts, vlog_roundtrip, vlog_demo, value_deref,
        generations_view, range_scan_stored, compaction_schedule, committed_reads, stream_apply, stream_latest, stream_spells, stream_sessions, stream_timeouts, lstm_scores,
    )
}


def _digest(seed: str, col: str = "id") -> str:
    return f"cast('0x' || substr(md5('{seed}:' || {col}), 1, 8) as bigint)"


_OPS = """
with o as (select workload, run_id, client, coalesce(success, false) as ok, coalesce(not is_write, false) as rd,
  greatest(coalesce(greatest(read_latency_ns, write_latency_ns), 0), 0) as lat, greatest(coalesce(value_size, 0), 0) as size, greatest(coalesce(value_size % 101, 0), 0) as it from workload_stats)
"""
_CLIENTS = """, c as (select {g}, client, count(*) as n, count(*) filter (ok) as good, sum(lat) as elapsed, max(size) as size, sum(it) filter (ok and rd) as items,
  count(*) filter (ok and rd and it > 0) as scans, coalesce(sum(lat) filter (ok and rd and it > 0), 0) as scan_elapsed, coalesce(sum(it * size) filter (ok and rd), 0) as scanned,
  coalesce(sum(size) filter (ok and not rd), 0) as put from o group by {g}, client)
"""


def _rate(b: str, ns: str) -> str:
    return f"round(case when {ns} > 0 then cast({b} as double) / 1e6 / (cast({ns} as double) / 1e9) end, 6)"


_MEAN = "round(avg(case when good > 0 then cast(floor(cast(elapsed as double) / good) as double) end), 6)"
_SCAN_MEAN = "round(cast(sum(case when scans > 0 then floor(cast(scan_elapsed as double) / scans) else 0 end) as double) / count(*), 6)"
_VARIANTS = {
    "wall_clock": (_rate("sum(good) * max(size)", "max(elapsed)"), "cast(null as double)"),
    "mean_of_clients": ("round(avg(case when elapsed > 0 then cast(good * size as double) / 1e6 / (cast(elapsed as double) / 1e9) end), 6)", _MEAN),
    "longest_client": (_rate("sum(good * size)", "max(elapsed)"), _MEAN),
    "fixed_reply": (_rate("sum(good) * 1000", "max(elapsed)"), "cast(null as double)"),
    "fixed_item": (_rate("coalesce(sum(items), 0) * 4000", "max(elapsed)"), "cast(null as double)"),
    "scan_clients": (_rate("sum(scanned)", "max(scan_elapsed)"), _SCAN_MEAN),
    "mixed": (_rate("sum(good) * max(size)", "max(elapsed)"), "round(sum(case when good > 0 then cast(elapsed as double) / good else 0 end) / count(*), 6)"),
    "load_all_operations": (_rate("sum(n) * max(size)", "max(elapsed)"), "round(cast(sum(elapsed) as double) / cast(sum(n) as double), 6)"),
    "scan_mix": (_rate("sum(put) + sum(scanned)", "max(scan_elapsed)"), _SCAN_MEAN),
}
_SHUFFLE = _digest("shuffle")
_MIX = _digest("mix")
_SCAN = f", r as (select id as range_id, {_digest('scan')} % 10000 as lo from g), q as (select range_id, lo, lo + 100 as hi, cast(lo as varchar) > cast(lo + 100 as varchar) as reversed from r)"
_SCAN_MIX = f"""
with g as (select range as id from range({OPS})), o as (select id, row_number() over (order by {_MIX}, id) - 1 as rn from g),
k as (select id as op_id, rn < {round(0.05 * OPS)} as is_write, case when rn < {round(0.05 * OPS)} then rn % {LAST_KEY + 1} else {_digest('mix-read')} % {LAST_KEY + 1} end as lo from o),
m as (select op_id, is_write, lo, case when is_write then lo else least(lo + 100, {LAST_KEY}) end as hi from k)
"""
_G500 = "with g as (select range as id from range(500))"

ORACLE: dict[str, str] = {
    "client_throughput": "with p as (select user_id, sum(octet_length(encode(props))) as b, max(epoch_us(ts)) - min(epoch_us(ts)) as e from events group by 1) select cast(sum(b) as bigint) as total_bytes, max(e) as max_elapsed_us, round(cast(sum(b) as double) / max(e), 6) as mb_per_s from p",
    "avg_of_avgs": "select round(avg(m), 6) as avg_of_avgs, count(*) as clients from (select avg(value) as m from events group by user_id)",
    "metric_rollups": _OPS + _CLIENTS.format(g="workload") + " union all ".join(f"select workload, '{v}' as variant, {a} as mb_per_s, {b} as latency_ns from c group by workload" for v, (a, b) in _VARIANTS.items()),
    "repeated_runs": _OPS + _CLIENTS.format(g="workload, run_id") + ", e as (select workload, run_id, case when max(elapsed) > 0 then cast(sum(good * size) as double) / 1e6 / (cast(max(elapsed) as double) / 1e9) end as r from c group by all) select workload, round(avg(r), 6) as mb_per_s, count(*) as runs from e group by 1",
    "measured_means": "with o as (select workload, client, greatest(read_latency_ns, write_latency_ns) as lat from workload_stats) select workload, client, count(*) as n, round(cast(sum(lat) as double) / count(*), 6) as mean_ns from o where lat >= 0 group by all having count(*) > 100",
    "op_mix": "select event_id % 20 = 0 as is_write, count(*) as n from events group by 1",
    "rmw_last": "select lpad(cast(user_id as varchar), 10, '0') as key, event_id + 1000000 as idx, props as value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "zipf_mass": "select p_partkey as k, round(pow(1.0 + p_partkey, -1.01) / (select sum(pow(1.0 + p_partkey, -1.01)) from part), 12) as p from part",
    "gen_random_writes": f"select range as op_id, {' || '.join(f"({_digest(f'key{i}', 'range')} % 9 + 1)" for i in range(5))} as key from range({OPS})",
    "gen_shuffled_slices": f"with g as (select range as id from range({KEYS})), o as (select id, row_number() over (order by {_SHUFFLE}, id) - 1 as pos from g) select pos, id as key, cast(pos // {-(-KEYS // CLIENTS)} as bigint) as client from o",
    "gen_sequential_writes": f"select cast(range // 500 as bigint) as client, range % 500 as j, range as key from range({CLIENTS * 500})",
    "gen_uniform_reads": f"select range as op_id, {_digest('uniform', 'range')} % {KEYS} as key from range({OPS})",
    "gen_zipf_reads": f"""
with k as (select range as rank, cast(floor(pow(1.0 + range, -1.01) * 1e6) as bigint) as w from range({KEYS})),
c as (select rank, sum(w) over (order by rank) - w as lo, sum(w) over (order by rank) as hi from k),
u as (select range as op_id, {_digest('zipf', 'range')} % (select sum(w) from k) as u from range({OPS}))
select op_id, rank as key from u join c on u.u >= c.lo and u.u < c.hi""",
    "gen_scan_ranges": _G500 + _SCAN + " select * from q",
    "scan_workload": "with g as (select unnest(range(0, (select count(*) // 20 from orders))) as id)" + _SCAN.replace("% 10000", "% (select count(*) from orders)") + " select range_id, count(*) as n, cast(round(sum(cast(o_totalprice as decimal(18, 2))), 2) as double) as total from q join orders on o_orderkey between lo and hi where not reversed group by 1",
    "gen_wide_ranges": f"with r as (select range as range_id, {_digest('scan', 'range')} % 6300000 as lo from range(400)) select range_id, lo, lo + {WIDE} as hi from r",
    "wide_scan": f"with r as (select range as range_id, {_digest('scan', 'range')} % 20000 as lo from range(8)) select range_id, cast(count(*) as bigint) as n, cast(sum(cast(l_quantity as decimal(18, 2))) as double) as quantity from r join lineitem on l_orderkey between lo and lo + {WIDE} group by 1",
    "gen_scan_mix": _SCAN_MIX + "select op_id, is_write, lo, hi from m",
    "scan_mix_items": _SCAN_MIX + ", f as (select op_id, count(*) as items from m join orders on o_orderkey between lo and hi where not is_write group by 1) select is_write, coalesce(items, 0) as items, count(*) as n from m left join f using (op_id) group by all",
    "wall_throughput": """
with t as (select node_id, value is not null as ok, octet_length(encode(value)) as size, epoch_us(send_ts) as a, epoch_us(recv_ts) as z from put_request),
p as (select node_id, count(*) filter (ok) as good, coalesce(max(size) filter (size > 0), 0) as size, max(z) filter (z >= a) - min(a) filter (z >= a) as wall_us from t group by 1)
select node_id, good, wall_us, round(case when wall_us > 0 then cast(good * size as double) / 1e6 / (cast(wall_us * 1000 as double) / 1e9) end, 6) as mb_per_s from p""",
    "gen_operation_mix": f"with g as (select range as id from range({OPS})), o as (select id, row_number() over (order by {_MIX}, id) - 1 as rn from g) select id as op_id, rn < {round(0.05 * OPS)} as is_write, case when rn < {round(0.05 * OPS)} then rn % {KEYS} else {_digest('mix-read')} % {KEYS} end as key from o",
    "gen_load_inserts": f"with g as (select range as id from range({OPS})), o as (select id, row_number() over (order by {_MIX}, id) - 1 as rn from g) select id as op_id, rn < {OPS // 2} as is_write, case when rn < {OPS // 2} then rn + 2000001 else {_digest('load-read')} % 2000000 end as key from o",
    "range_scan_stored": "select lpad(cast(user_id as varchar), 10, '0') as key, event_id as idx, props as value from events where user_id between 10 and 20 qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "compaction_schedule": """
with s as (select epoch_us(ts) as t, value > 99.9 as f, epoch_us(ts) - lag(epoch_us(ts)) over (order by event_id) > 300000000 as idle from events)
select t - t % 1800000000 as slot, case when bool_or(coalesce(f, false)) then 'full' when bool_or(coalesce(idle, false)) then 'idle' else 'interval' end as reason from s group by 1""",
    "committed_reads": """
with c as (select list_sort(list(m))[2] as commit from (select max(event_id) as m from events where event_type in ('click', 'view', 'error') group by event_type))
select lpad(cast(user_id as varchar), 10, '0') as key, max(event_id) as idx from events, c where event_id <= commit group by 1""",
    "gen_values": f"select range as id, substr(translate(md5('value0:' || range), '0123456789', 'ghijklmnop') || translate(md5('value1:' || range), '0123456789', 'ghijklmnop'), 1, 40) as value, (({_digest('id-high', 'range')} & 1073741823) << 32) | {_digest('id-low', 'range')} as req from range({OPS})",
    "clock_starts": "select n_nationkey, n_name || '1' as node, cast(0 as bigint) as at from nation",
    "vlog_roundtrip": "select lpad(coalesce(key, ''), 10, '0') as key, count(*) as n, cast(sum(coalesce(octet_length(encode(value)), 0)) as bigint) as value_bytes, cast(sum(coalesce(length(value), 0)) as bigint) as chars, max(coalesce(idx, 0)) as last_idx from value_log group by 1",
    "vlog_demo": "select lpad(coalesce(key, ''), 10, '0') as key, count(*) as n, cast(sum(coalesce(octet_length(encode(value)), 0)) as bigint) as value_bytes, cast(sum(coalesce(length(value), 0)) as bigint) as chars from value_log group by 1",
    "value_deref": """
with a as (select unnest(list_concat(range(10, 21), [999999])) as u), l as (select user_id, max_by(props, event_id) as value from events group by 1)
select lpad(cast(u as varchar), 10, '0') as key, user_id is not null as found, value from a left join l on u = user_id""",
    "generations_view": "select lpad(cast(user_id as varchar), 10, '0') as key, event_id as idx, props as value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "stream_apply": feeds.ORACLE["p1_found"],
    "stream_latest": """
with e as (select group_id, idx, lpad(key, 10, '0') as key, lower(regexp_replace(op, '\\s+', '', 'g')) as op from put_log where idx is not null and key is not null)
select group_id, key, idx from (select distinct on (group_id, key) group_id, key, idx, op from e where op in ('put', 'insert', 'update', 'delete') order by group_id, key, idx desc, op = 'delete') where op <> 'delete'""",
    "stream_spells": """
with a as (select group_id, epoch_us(arrived_ts) as t from put_log where arrived_ts is not null),
b as (select *, coalesce(t - lag(t) over w > 300000000, true) as opens from a window w as (partition by group_id order by t)),
c as (select *, sum(opens::int) over (partition by group_id order by t rows unbounded preceding) as spell from b)
select group_id, min(t) as started_us, max(t) + 300000000 as ended_us, count(*) as n from c group by group_id, spell having max(t) + 300000000 <= (select max(t) from a) - 600000000""",
    "stream_sessions": "select distinct client_id, seq_id from put_request where client_id is not null and seq_id is not null and recv_ts is not null",
    "stream_timeouts": f"""
with r as (select req_id, min(req_ts) as sent, min(logged_ts) as answered from get_request where req_ts is not null group by 1)
select count(*) as in_time, max(epoch_us(answered) - epoch_us(sent)) as longest_us from r where answered between sent and sent + interval {TIMEOUT} second""",
}
