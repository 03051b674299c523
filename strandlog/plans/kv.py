"""Queries of the key-value semantics over the test tables, with the SQL they are checked against.

``events`` serves as put log: idx is event_id, key the padded user_id, value the JSON in props. ``put_log`` serves
as replicated log, ``orders`` as a static keyed table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import scalars
from strandlog.functions.keys import clean_op, pad_key, unpad_key
from strandlog.operators import compact, consensus, features, live, putlog
from strandlog.sources import csvio
from strandlog.sources.shared import cut, new_path
from strandlog.sources.tables import table

#: Parameters of the queries.
SPLIT, STRETCH, RUN, APPLIED, BATCH_CAP, WINDOW, THRESHOLD, SEQUENCE, IDLE = 9800, 50, 2500, 7000, 3_000_000, 10, 0.1, 32, 300
ASKED = ("0", "42", "149", "150", "999")


def log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("idx"), pad_key("user_id").alias("key"), F.col("props").alias("value"))


def numbers(spark: SparkSession, d: str, keys: tuple[str, str] | None = None) -> DataFrame:
    e = table(spark, d, "events")
    if keys:
        e = e.filter(live.number_between("user_id", *keys))
    return e.select(F.col("event_id").alias("idx"), pad_key("user_id").alias("key"), F.col("value"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ASKED], "key string")


def point_get(spark: SparkSession, d: str) -> DataFrame:
    return live.latest(numbers(spark, d, ("42", "42")), "value")


def multi_get_nokey(spark: SparkSession, d: str) -> DataFrame:
    found = live.get(live.latest(log(spark, d), "value"), asked(spark))
    index = compact.key_index(compact.log_offsets(log(spark, d)))
    offsets = compact.index_get(index, asked(spark).select(F.col("key").alias("asked"), pad_key("key").alias("key")).select("key"))
    return found.withColumn("padded", pad_key("key")).join(offsets.withColumnRenamed("key", "padded"), "padded").select("key", "err", "value", "offset")


def multi_get_inline(spark: SparkSession, d: str) -> DataFrame:
    return live.get(live.latest(log(spark, d), "value"), asked(spark), miss_value=scalars.ERR_NO_KEY, empty_is_missing=True)


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter(live.number_between("o_orderkey", "100", "199"))
    return o.select(pad_key("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))


def range_scan_live(spark: SparkSession, d: str) -> DataFrame:
    return live.latest(numbers(spark, d, ("10", "20")), "value")


def scan_reversed_empty(spark: SparkSession, d: str) -> DataFrame:
    return live.latest(numbers(spark, d, ("10050", "9950")), "value")


def scan_as_map(spark: SparkSession, d: str) -> DataFrame:
    m = live.as_map(range_scan_live(spark, d))
    return m.select(F.size("pairs").cast("long").alias("pairs"), F.element_at("pairs", live.pad_literal("15")).alias("value_of_15"))


def merge_on_read(spark: SparkSession, d: str) -> DataFrame:
    n = numbers(spark, d)
    return live.merge(live.latest(n.filter(F.col("idx") >= SPLIT), "value"), live.latest(n.filter(F.col("idx") < SPLIT), "value"))


def skip_noops(spark: SparkSession, d: str) -> DataFrame:
    return live.without_noops(table(spark, d, "put_log")).groupBy(clean_op("op").alias("op")).agg(F.count("*").alias("n"))


def keys_only(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("key").distinct()


def by_file_version(spark: SparkSession, d: str) -> DataFrame:
    new, old = putlog.by_file(table(spark, d, "put_log"))
    return new.agg(F.count("*").alias("n")).withColumn("file", F.lit("new")).unionByName(old.agg(F.count("*").alias("n")).withColumn("file", F.lit("old")))


def log_append(spark: SparkSession, d: str) -> DataFrame:
    return putlog.assign_index(table(spark, d, "put_request"), ["recv_id"]).select("idx", "key", "client_id", "seq_id", "file_version")


def compact_sorted(spark: SparkSession, d: str) -> DataFrame:
    return compact.compact(log(spark, d), payload=False).select("key", "idx", "position")


def sorted_index(spark: SparkSession, d: str) -> DataFrame:
    return compact.compact(log(spark, d), payload=False).select("key", "offset")


def log_offsets(spark: SparkSession, d: str) -> DataFrame:
    return compact.log_offsets(log(spark, d)).select("idx", "key", "offset", "size")


def index_build(spark: SparkSession, d: str) -> DataFrame:
    return compact.key_index(compact.log_offsets(log(spark, d))).select("key", "offset")


def index_scan(spark: SparkSession, d: str) -> DataFrame:
    return index_build(spark, d).filter(live.between("key", "10", "20"))


def liveness(spark: SparkSession, d: str) -> DataFrame:
    records = compact.log_offsets(log(spark, d))
    return compact.liveness(records, compact.key_index(records)).select("idx", "key", "valid")


def garbage_bytes(spark: SparkSession, d: str) -> DataFrame:
    return compact.garbage(log(spark, d))


def verify_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Violations in the compacted segment, and in a copy where every seventh key was overwritten by the least one."""
    segment = cut(compact.compact(log(spark, d), payload=False), "segment")
    damaged = segment.withColumn("key", F.when(F.col("position") % 7 == 6, live.pad_literal("0")).otherwise(F.col("key")))
    parts = [compact.order_violations(x).select(F.lit(name).alias("segment"), "violations") for name, x in (("whole", segment), ("damaged", damaged))]
    return parts[0].unionByName(parts[1])


def run_merge_dups(spark: SparkSession, d: str) -> DataFrame:
    return compact.merged_runs(log(spark, d), RUN)


def entry_count(spark: SparkSession, d: str) -> DataFrame:
    return live.latest(log(spark, d)).agg(F.count("*").alias("entries"))


def map_size(spark: SparkSession, d: str) -> DataFrame:
    return compact.map_bytes(live.latest(log(spark, d), "value"))


def compaction_due(spark: SparkSession, d: str) -> DataFrame:
    return compact.needs_compaction(log(spark, d), 100_000)


def index_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Live records against the compacted segment by place in the log, and against a copy that lost the first of them."""
    newest = live.latest(log(spark, d).drop("value"))
    segment = cut(compact.compact(log(spark, d), payload=False), "segment")
    damaged = segment.join(segment.agg(F.min("idx").alias("_least")), F.col("idx") > F.col("_least"))
    parts = [compact.index_mismatches(newest, x).select(F.lit(name).alias("segment"), "mismatches") for name, x in (("whole", segment), ("damaged", damaged))]
    return parts[0].unionByName(parts[1])


def index_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """The records to which the index points, rewritten in key order: a digest of each and its new place."""
    return compact.rewrite_live(log(spark, d)).select("key", "idx", F.md5("value").alias("digest"), "position", "offset", "old_offset")


def payload_trim(spark: SparkSession, d: str) -> DataFrame:
    return compact.trimmed(log(spark, d), APPLIED).select("idx", "value")


def idle_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("idx"), "ts")
    return compact.idle_gaps(e, "ts", IDLE)


def quorum_commit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "error"))
    progress = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("match"))
    return consensus.commit_index(progress, "user_id", "match", 3)


def replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two replicas of many logs from the entries received: one holds the oldest term of each entry, the other the newest. A log is a stretch of ``STRETCH`` entries of a group."""
    p = table(spark, d, "put_log").filter("idx is not null").groupBy("group_id", "idx").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    p = p.select((F.col("group_id").cast("long") * 1_000_000 + F.floor(F.col("idx") / STRETCH)).alias("grp"), (F.col("idx") % STRETCH + 1).alias("idx"), "lo", "hi")
    return p.select("grp", "idx", F.col("lo").alias("term")), p.select("grp", "idx", F.col("hi").alias("term"))


def prefix_conflict(spark: SparkSession, d: str) -> DataFrame:
    return consensus.first_conflict(*replicas(spark, d))


def append_entries(spark: SparkSession, d: str) -> DataFrame:
    follower, leader = replicas(spark, d)
    return consensus.received(follower, leader).groupBy("grp", "term").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def append_requests(leader: DataFrame) -> DataFrame:
    """A request per log: entries after its middle, after index 0 (one log in five), or after a place beyond the end (another one)."""
    last = leader.groupBy("grp").agg(F.max("idx").alias("last"))
    middle = leader.join(last, "grp").filter(F.col("idx") <= F.floor(F.col("last") / 2)).groupBy("grp").agg(F.max(F.struct("idx", "term")).alias("m"))
    kind = F.col("grp") % 5
    prev = F.when(kind == 0, F.col("last") + 5).when(kind == 1, F.lit(0)).otherwise(F.coalesce("m.idx", F.lit(0)))
    term = F.when(kind == 0, F.lit(1)).when(kind == 1, F.lit(0)).otherwise(F.coalesce("m.term", F.lit(0)))
    return last.join(middle, "grp", "left").select("grp", prev.alias("prev_idx"), term.alias("prev_term"), (F.col("last") - 3).alias("leader_commit"), F.lit(2).alias("own_commit"))


def append_replies(spark: SparkSession, d: str) -> DataFrame:
    follower, leader = replicas(spark, d)
    return consensus.append_replies(follower, leader, append_requests(leader)).select("grp", "prev_idx", "success", "conflict_term", "conflict_idx", "last_idx", "commit_idx")


def next_index_backoff(spark: SparkSession, d: str) -> DataFrame:
    follower, leader = replicas(spark, d)
    refused = consensus.append_replies(follower, leader, append_requests(leader)).filter("not success")
    return consensus.backoff(leader, refused)


def vote_uptodate(spark: SparkSession, d: str) -> DataFrame:
    _, leader = replicas(spark, d)
    last = consensus.last_entries(leader)
    voter = last.select((F.col("grp") - 1).alias("grp"), F.col("last_term").alias("own_term"), F.col("last_idx").alias("own_idx"))
    return last.join(voter, "grp").select("grp", consensus.up_to_date(F.col("last_term"), F.col("last_idx"), F.col("own_term"), F.col("own_idx")).alias("granted"))


def vote_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a request for the vote of its user, in terms that mostly rise; a third of the users has voted before."""
    e = table(spark, d, "events")
    requests = e.select(F.col("user_id").alias("voter"), F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 400) + F.col("event_id") % 3).alias("term"), F.col("event_type").alias("candidate"),
                        F.floor(F.col("value") / 10).cast("long").alias("last_term"), (F.col("event_id") % 500).alias("last_idx"))
    voters = e.select(F.col("user_id").alias("voter")).distinct().select("voter", (F.col("voter") % 4).alias("own_term"), F.when(F.col("voter") % 3 == 0, "click").alias("voted_for"), F.lit(2).alias("own_last_term"), F.lit(250).alias("own_last_idx"))
    return consensus.votes(requests, voters).select("seq", "granted")


def log_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each entry stands in a log of which the first 1000 entries were cut off."""
    return log(spark, d).select("idx", scalars.log_place(F.col("idx")).alias("whole"), scalars.log_place(F.col("idx"), F.lit(1000)).alias("cut"))


def vote_majority(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("granted"), (F.count("*") + 1).alias("nodes"))
    return e.withColumn("elected", consensus.majority(F.col("granted"), F.col("nodes")))


def max_term(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "put_log").groupBy("group_id").agg(F.max("term").alias("term"))


def apply_window(spark: SparkSession, d: str) -> DataFrame:
    return consensus.to_apply(log(spark, d), F.lit(100), F.lit(APPLIED)).select("idx", "key")


def append_batches(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sent_batch(log(spark, d), scalars.record_bytes(F.col("value")), BATCH_CAP).agg(F.count("*").alias("entries"), F.max("counter").alias("counter"))


def dedupe_seq(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    return consensus.rising_only(e, "user_id", "event_id", "event_id")


def rising_requests(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rising_only(table(spark, d, "put_request").select("recv_id", "client_id", "seq_id"), "client_id", "seq_id", "recv_id")


def session_table(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sessions(table(spark, d, "put_request"), "client_id", "seq_id", "recv_id")


def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Per user the greatest event of each type as a clock, and the same of the events before 5000 as the other."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("own"), F.max(F.when(F.col("event_id") < 5000, F.col("event_id"))).alias("other"))
    own, other = F.collect_list(F.struct("event_type", "own")), F.collect_list(F.when(F.col("other").isNotNull(), F.struct("event_type", "other")))
    return per.groupBy("user_id").agg(F.map_from_entries(own).alias("own"), F.map_from_entries(other).alias("other"))


def clock_dominates(spark: SparkSession, d: str) -> DataFrame:
    return clocks(spark, d).select("user_id", scalars.clock_dominated(F.col("own"), F.col("other")).alias("dominated"), scalars.clock_dominated(F.col("other"), F.col("own")).alias("dominates"),
                                   scalars.clock_length(F.col("own")).alias("entries"), scalars.clock_load(F.col("other"), F.lit("click")).alias("click"))


def series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))


def threshold_changes(spark: SparkSession, d: str) -> DataFrame:
    return features.changes(series(spark, d), THRESHOLD).filter("changed").select("idx")


def row_windows(spark: SparkSession, d: str) -> DataFrame:
    return features.row_windows(series(spark, d), WINDOW, THRESHOLD)


def row_windows_period(spark: SparkSession, d: str) -> DataFrame:
    return features.with_period(features.row_windows(series(spark, d), WINDOW, THRESHOLD)).select("win", "read_time", "write_counts", "period")


def seq_windows(spark: SparkSession, d: str) -> DataFrame:
    s = features.sequences(series(spark, d), SEQUENCE)
    return s.select("idx", F.element_at("seq", 1).alias("first"), F.size("seq").cast("long").alias("length"), "target")


def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.agg(F.round(features.accuracy(F.col("value") / 100, F.col("value") / 100 + 0.2), 6).alias("accuracy"))


def pad_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k,) for k in ("7", "007", "0", "42", "12345678901", "0000000000")], "raw string")
    return rows.select("raw", pad_key("raw").alias("padded"), unpad_key(pad_key("raw")).alias("unpadded"))


def offset_codec(spark: SparkSession, d: str) -> DataFrame:
    le = scalars.to_little_endian(F.col("o_orderkey") * 7919 * 1000003)
    return table(spark, d, "orders").select("o_orderkey", le.alias("digits"), scalars.from_little_endian(le).alias("offset"))


def size_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.size_label(F.octet_length("text")).alias("label"))


def request_times(spark: SparkSession, d: str) -> DataFrame:
    """Lines of request times, appended to a CSV file in two turns and read again."""
    p = table(spark, d, "put_request").filter("key is not null and send_ts is not null")
    us = F.unix_micros(F.col("recv_ts").cast("timestamp")) - F.unix_micros(F.col("send_ts").cast("timestamp"))
    lines = lambda x: csvio.request_times(x, F.col("node_id"), F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(0)), us)
    path = new_path(spark, "request-times")
    for part in (p.filter("node_id <= 1"), p.filter("node_id > 1 or node_id is null")):
        csvio.append(lines(part), path)
    return spark.read.csv(path, schema="label string, duration string").groupBy("label").agg(F.count("*").alias("n"), F.min("duration").alias("duration"))


def csv_head(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    return csvio.first_in_order(table(spark, d, "lineitem"), order, F.col("l_extendedprice"))


def _series_file(spark: SparkSession, d: str) -> str:
    path = new_path(spark, "series")
    csvio.write(series(spark, d).repartitionByRange(5, "idx").sortWithinPartitions("idx").select(F.col("t").alias("time"), F.lit("x").alias("open"), F.when(F.col("idx") % 50 != 3, F.col("v").cast("string")).otherwise("bad").alias("low")), path)
    return path


def csv_series(spark: SparkSession, d: str) -> DataFrame:
    """A series written as CSV files and read again in the order of files and lines; one low in fifty is no number."""
    return csvio.read_series(spark, _series_file(spark, d))


def csv_counts(spark: SparkSession, d: str) -> DataFrame:
    """The third column of the first lines of the same files."""
    return csvio.read_counts(spark, _series_file(spark, d), 2)


def position_in_array(spark: SparkSession, d: str) -> DataFrame:
    types = F.array(*(F.lit(x) for x in ("click", "view", "error")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", scalars.position_of(types, F.col("event_type")).alias("place"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        point_get, multi_get_nokey, multi_get_inline, range_scan, range_scan_live, scan_reversed_empty, scan_as_map, merge_on_read, skip_noops, keys_only, by_file_version,
        log_append, compact_sorted, sorted_index, log_offsets, index_build, index_scan, liveness, garbage_bytes, verify_sorted, run_merge_dups, entry_count, map_size,
        compaction_due, index_consistency, index_rewrite, payload_trim, idle_gaps, quorum_commit, prefix_conflict, append_entries, append_replies, next_index_backoff, vote_uptodate, vote_decisions, log_positions, vote_majority,
        max_term, apply_window, append_batches, dedupe_seq, rising_requests, session_table, clock_dominates, threshold_changes, row_windows, row_windows_period,
        seq_windows, eval_accuracy, pad_roundtrip, offset_codec, size_label, request_times, csv_head, csv_series, csv_counts, position_in_array,
    )
}

_LOG = """
with log as (select event_id as idx, lpad(cast(user_id as varchar), 10, '0') as key, props as value, value as v, event_type, ts from events),
sized as (select *, 30 + octet_length(encode(value)) as size from log),
off as (select *, cast(sum(size) over (order by idx) - size as bigint) as "offset" from sized),
live as (select * from off qualify row_number() over (partition by key order by idx desc) = 1)
"""
_ASKED = "asked as (select unnest(['0', '42', '149', '150', '999']) as k)"
_REPLICAS = f"""
with q as (select group_id, idx, min(term) as lo, max(term) as hi from put_log where idx is not null group by all),
r as (select cast(group_id as bigint) * 1000000 + idx // {STRETCH} as grp, idx % {STRETCH} + 1 as idx, lo, hi from q),
c as (select grp, min(idx) as conflict_idx from r where lo <> hi group by grp)
"""
_REPLIES = _REPLICAS + """,
n as (select grp, max(idx) as last from r group by grp),
mid as (select r.grp, max(r.idx) as idx, max_by(r.hi, r.idx) as term from r join n using (grp) where r.idx <= n.last // 2 group by r.grp),
req as (select n.grp, n.last, case n.grp % 5 when 0 then n.last + 5 when 1 then 0 else coalesce(mid.idx, 0) end as prev_idx,
               case n.grp % 5 when 0 then 1 when 1 then 0 else coalesce(mid.term, 0) end as prev_term from n left join mid using (grp)),
chk as (select req.*, prev_idx > last as short, not prev_idx > last and prev_idx <> 0 and f.lo is distinct from prev_term as other, f.lo as at_prev
        from req left join r f on f.grp = req.grp and f.idx = req.prev_idx),
rep as (select grp, prev_idx, last, not short and not other as success, case when other then at_prev else -1 end as conflict_term,
        case when short then last + 1 when other then (select min(idx) from r where r.grp = chk.grp and r.lo = at_prev and r.idx <= chk.prev_idx) end as conflict_idx from chk)
"""
_SERIES = """
with s as (select event_id as idx, epoch_us(ts) as t, value as v, row_number() over (order by event_id) - 1 as rn,
           coalesce(abs(value - lag(value) over (order by event_id)) > 0.1, false) as changed from events),
w as (select cast(rn // 10 as bigint) as win, max_by(t, rn) as read_time, cast(count(*) filter (changed) as bigint) as write_counts from s group by 1)
"""

ORACLE: dict[str, str] = {
    "point_get": _LOG + "select key, idx, v as value from live where key = '0000000042'",
    "multi_get_nokey": _LOG + f", {_ASKED} select k as key, case when l.key is null then 'ErrNoKey' else 'OK' end as err, case when l.key is null then 'NOKEY' else l.value end as value, coalesce(\"offset\", -1) as \"offset\" from asked left join live l on l.key = lpad(k, 10, '0')",
    "multi_get_inline": _LOG + f", {_ASKED} select k as key, case when coalesce(length(l.value), 0) = 0 then 'ErrNoKey' else 'OK' end as err, case when coalesce(length(l.value), 0) = 0 then 'ErrNoKey' else l.value end as value from asked left join live l on l.key = lpad(k, 10, '0')",
    "range_scan": "select lpad(cast(o_orderkey as varchar), 10, '0') as key, o_totalprice as value from orders where o_orderkey between 100 and 199",
    "range_scan_live": _LOG + "select key, idx, v as value from live where key between '0000000010' and '0000000020'",
    "scan_reversed_empty": _LOG + "select key, idx, v as value from live where key between '0000010050' and '0000009950'",
    "scan_as_map": _LOG + "select count(*) as pairs, max(v) filter (key = '0000000015') as value_of_15 from live where key between '0000000010' and '0000000020'",
    "merge_on_read": _LOG + f", newer as (select key, idx, v as value from log where idx >= {SPLIT} qualify row_number() over (partition by key order by idx desc) = 1), older as (select key, idx, v as value from log where idx < {SPLIT} qualify row_number() over (partition by key order by idx desc) = 1) select *, 'new' as segment from newer union all select *, 'old' from older where key not in (select key from newer)",
    "skip_noops": "select lower(regexp_replace(op, '\\s+', '', 'g')) as op, count(*) as n from put_log where lower(regexp_replace(op, '\\s+', '', 'g')) <> 'termlog' group by 1",
    "keys_only": _LOG + "select distinct key from log",
    "by_file_version": "select 'new' as file, count(*) filter (file_version = 1) as n from put_log union all select 'old', count(*) filter (file_version is null or file_version <> 1) from put_log",
    "log_append": "select row_number() over (order by recv_id) as idx, lpad(key, 10, '0') as key, client_id, seq_id, -1 as file_version from put_request",
    "compact_sorted": _LOG + "select key, idx, row_number() over (order by key) - 1 as position from live",
    "sorted_index": _LOG + 'select key, cast(sum(size) over (order by key) - size as bigint) as "offset" from live',
    "log_offsets": _LOG + 'select idx, key, "offset", size from off',
    "index_build": _LOG + 'select key, "offset" from live',
    "index_scan": _LOG + "select key, \"offset\" from live where key between '0000000010' and '0000000020'",
    "liveness": _LOG + "select idx, key, idx = max(idx) over (partition by key) as valid from log",
    "garbage_bytes": _LOG + "select (select count(*) from sized) as records, (select count(*) from live) as live_records, cast((select sum(size) from sized) as bigint) as total_bytes, cast((select sum(size) from sized) - (select sum(size) from live) as bigint) as reclaimable_bytes",
    "verify_sorted": _LOG + "select 'whole' as segment, count(*) as violations from (select key, lag(key) over (order by key) as p from live) where key <= p union all select 'damaged', count(*) from (select k, lag(k) over (order by pos) as p from (select row_number() over (order by key) - 1 as pos, case when (row_number() over (order by key) - 1) % 7 = 6 then '0000000000' else key end as k from live)) where k <= p",
    "run_merge_dups": _LOG + f"select key, cast(idx // {RUN} as bigint) as run, max(idx) as idx from log group by 1, 2",
    "entry_count": _LOG + "select count(*) as entries from live",
    "map_size": _LOG + "select count(*) as entries, cast(sum(12 + 20 + octet_length(encode(value))) as bigint) as bytes from live",
    "compaction_due": _LOG + "select cast(sum(size) as bigint) as total_bytes, sum(size) > 100000 as due from sized",
    "index_consistency": _LOG + "select 'whole' as segment, cast(0 as bigint) as mismatches union all select 'damaged', count(*) from (select key, row_number() over (order by idx) as rn from live) a full join (select key, row_number() over (order by idx) as rn from live where idx > (select min(idx) from live)) b using (rn) where a.key is distinct from b.key",
    "index_rewrite": _LOG + 'select key, idx, md5(value) as digest, row_number() over (order by key) - 1 as position, cast(sum(size) over (order by key) - size as bigint) as "offset", "offset" as old_offset from live',
    "payload_trim": _LOG + f"select idx, case when idx <= {APPLIED} then 'NULL' else value end as value from log",
    "idle_gaps": _LOG + f"select * from (select idx, epoch_us(ts) - lag(epoch_us(ts)) over (order by idx) as gap_us from log) where gap_us > {IDLE * 1_000_000}",
    "quorum_commit": "with p as (select user_id, event_type, max(event_id) as m from events where event_type in ('click', 'view', 'error') group by all) select user_id, list_sort(list(m))[2] as commit_idx from p group by user_id having count(*) = 3",
    "prefix_conflict": _REPLICAS + "select * from c",
    "append_entries": _REPLICAS + "select r.grp, case when r.idx < c.conflict_idx then lo else hi end as term, count(*) as n, max(idx) as last_idx from r left join c using (grp) group by 1, 2",
    "append_replies": _REPLIES + "select grp, prev_idx, success, cast(conflict_term as bigint) as conflict_term, conflict_idx, last as last_idx, case when success and last - 3 > 2 then least(last - 3, last) else 2 end as commit_idx from rep",
    "next_index_backoff": _REPLIES + "select grp, coalesce((select max(idx) + 1 from r where r.grp = rep.grp and r.idx <= rep.prev_idx and r.hi <> rep.conflict_term and rep.conflict_term <> -1), conflict_idx) as next_idx from rep where not success",
    "vote_decisions": """
with q as (select user_id as voter, event_id as seq, event_id // 400 + event_id % 3 as term, event_type as candidate, cast(floor(value / 10) as bigint) as last_term, event_id % 500 as last_idx,
                  user_id % 4 as own_term, case when user_id % 3 = 0 then 'click' end as voted_for from events),
s as (select *, term >= greatest(own_term, coalesce(max(term) over (partition by voter order by seq rows between unbounded preceding and 1 preceding), 0))
        and (last_term > 2 or last_term = 2 and last_idx >= 250) as fit from q),
w as (select voter, term, arg_min(candidate, seq) as winner from s where fit group by 1, 2)
select seq, coalesce(fit and candidate = case when s.term = own_term and voted_for is not null then voted_for else winner end, false) as granted from s left join w using (voter, term)""",
    "log_positions": "select event_id as idx, case when event_id >= 1 then event_id - 1 end as whole, case when event_id >= 1000 then event_id - 1000 end as \"cut\" from events",
    "vote_uptodate": _REPLICAS + ", l as (select grp, max_by(hi, idx) as t, max(idx) as i from r group by grp) select a.grp, a.t > b.t or a.t = b.t and a.i >= b.i as granted from l a join l b on b.grp = a.grp + 1",
    "vote_majority": "select user_id, granted, nodes, granted + 1 > nodes // 2 as elected from (select user_id, count(*) filter (value > 50) as granted, count(*) + 1 as nodes from events group by 1)",
    "max_term": "select group_id, max(term) as term from put_log group by 1",
    "apply_window": _LOG + f"select idx, key from log where idx > 100 and idx <= {APPLIED}",
    "append_batches": _LOG + f", b as (select idx, sum(size) over (order by idx) as buffer from sized), k as (select idx, sum(buffer) over (order by idx) as counter from b) select count(*) as entries, cast(max(counter) as bigint) as counter from k where counter <= {BATCH_CAP}",
    "dedupe_seq": "select user_id, event_id from events qualify event_id > coalesce(max(event_id) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1)",
    "rising_requests": "select recv_id, client_id, seq_id from put_request where client_id is not null and seq_id is not null qualify seq_id > coalesce(max(seq_id) over (partition by client_id order by recv_id rows between unbounded preceding and 1 preceding), -9223372036854775808)",
    "session_table": "select client_id, seq_id as last_seq from put_request where client_id is not null qualify row_number() over (partition by client_id order by recv_id desc) = 1",
    "clock_dominates": """
with p as (select user_id, event_type, max(event_id) as own, max(event_id) filter (event_id < 5000) as other from events group by all)
select user_id, count(other) = 0 or (count(other) >= count(own) and bool_and(coalesce(other >= own, false))) as dominated,
       count(own) >= count(other) and bool_and(other is null or own >= other) as dominates, count(own) as entries,
       coalesce(max(other) filter (event_type = 'click'), 0) as click from p group by user_id""",
    "threshold_changes": _SERIES + "select idx from s where changed",
    "row_windows": _SERIES + "select * from w",
    "row_windows_period": _SERIES + "select *, coalesce(read_time - lag(read_time) over (order by win), 0) as period from w",
    "seq_windows": _SERIES + "select idx, lag(v, 32) over (order by rn) as first, cast(32 as bigint) as length, v as target from s qualify rn >= 32",
    "eval_accuracy": "select round(100.0 * count(*) filter (round_even(value / 100, 0) = round_even(value / 100 + 0.2, 0)) / count(*), 6) as accuracy from events",
    "pad_roundtrip": "select raw, lpad(raw, 10, '0') as padded, ltrim(lpad(raw, 10, '0'), '0') as unpadded from (select unnest(['7', '007', '0', '42', '12345678901', '0000000000']) as raw)",
    "offset_codec": "with h as (select o_orderkey, o_orderkey * 7919 * 1000003 as o, lpad(printf('%X', o_orderkey * 7919 * 1000003), 16, '0') as x from orders) select o_orderkey, substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) as digits, o as \"offset\" from h",
    "size_label": "select doc_id, case when n < 1024 then n || 'B' else (n // 1024) || 'KB' end as label from (select doc_id, octet_length(encode(text)) as n from documents)",
    "request_times": """
with p as (select node_id, octet_length(encode(key)) as k, coalesce(octet_length(encode(value)), 0) as n, epoch_us(recv_ts) - epoch_us(send_ts) as us from put_request where key is not null and send_ts is not null)
select concat_ws('-', node_id, k, case when n < 1024 then n || 'B' else (n // 1024) || 'KB' end) as label, count(*) as n, min(us || 'us') as duration from p group by 1""",
    "csv_series": "select cast(event_id as bigint) as idx, cast(epoch_us(ts) as double) as time, case when event_id % 50 <> 3 then value end as low from events where event_id < 300000",
    "csv_counts": "select event_id as idx, case when event_id % 50 <> 3 then value end as value from events where event_id < 999",
    "csv_head": "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn, l_extendedprice as value from lineitem qualify rn <= 999",
    "position_in_array": "select event_type, count(*) as n, cast(coalesce(list_position(['click', 'view', 'error'], event_type), 0) - 1 as bigint) as place from events group by 1",
}
