"""Queries for the change feed, repeated deliveries and busy keys, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import changefeed, redelivery, skew
from strandlog.sources.shared import new_path
from strandlog.sources.tables import table

#: Share of the rows that makes a key busy.
BUSY = 0.01


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "put_log")).select("group_id", "key", "idx")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "put_log"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same state from five batches that part the entries, and the rows of one entry, at random; one of them comes twice."""
    log = table(spark, d, "put_log").withColumn("_batch", F.pmod(F.xxhash64("arrived_ts", "op", "term", "value", "file_version"), F.lit(5)))
    state = changefeed.EqualityDeleteTable(spark, new_path(spark, "changes"))
    for i in (3, 0, 4, 1, 2, 0):
        state.append(changefeed.entries(log.filter(F.col("_batch") == i)))
    return state.read()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.copies(table(spark, d, "put_request"))


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    return redelivery.keep_one(table(spark, d, "put_request")).select("recv_id", "client_id", "seq_id", "key", "value", "op")


def p4_ranges(spark: SparkSession, d: str) -> DataFrame:
    _, state = redelivery.judge(table(spark, d, "put_request"))
    return redelivery.whole_ranges(state)


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """p4_found with the table taken in four batches, the ranges and messages of each kept for the next."""
    return redelivery.copies(table(spark, d, "put_request"), batches=4)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    get, put = table(spark, d, "get_request"), table(spark, d, "put_request")
    parts = [skew.busy_keys(df, F.col("client_id"), BUSY).select(F.lit(name).alias("tbl"), "key") for name, df in (("get_request", get), ("put_request", put))]
    return parts[0].unionByName(parts[1])


def _us(later: str, earlier: str):
    return F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))


def p5_get_profile(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "get_request")
    return skew.key_profile(df, F.col("req_ts"), F.col("client_id"), F.col("err"), _us("logged_ts", "req_ts"), {"p50": 0.5, "p99": 0.99})


def p5_put_profile(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "put_request")
    return skew.key_profile(df, F.col("recv_ts"), F.col("client_id"), F.col("node_id"), _us("recv_ts", "send_ts"), {"p50": 0.5, "p99": 0.99})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_state, p1_incremental, p4_found, p4_kept, p4_ranges, p4_batches, p5_found, p5_get_profile, p5_put_profile)
}

_P1 = """
with e as (
  select group_id, idx, coalesce(term, -1) as term, lpad(key, 10, '0') as key, value,
         case when lower(regexp_replace(op, '\\s+', '', 'g')) in ('put', 'insert', 'update') then 'set'
              when lower(regexp_replace(op, '\\s+', '', 'g')) = 'delete' then 'remove' else 'none' end as kind
  from put_log where idx is not null and group_id is not null),
held as (select * from (select *, max(term) over (partition by group_id, idx) as newest from e) where term = newest and kind <> 'none' and key is not null),
one as (select group_id, idx, key, kind, coalesce(max(value) filter (value <> 'NULL'), max(value)) as value from held group by all),
last as (select *, row_number() over (partition by group_id, key order by idx desc, kind desc) as rn from one)
"""

_DELIVERY = """
with v as (select *, lpad(key, 10, '0') as pkey from put_request),
r as (select *, client_id is not null and seq_id is not null and key is not null
        and recv_id > min(recv_id) over (partition by client_id, seq_id, pkey) as again from v)
"""


def _profile(tbl: str, ts: str, mode: str, us: str) -> str:
    return f"""
with t as (select lpad(key, 10, '0') as key, {ts} as ts, client_id, {mode} as m, {us} as us from {tbl} where key is not null),
base as (select key, cast(count(*) as bigint) as n, min(ts) as first_ts, max(ts) as last_ts, cast(count(distinct client_id) as bigint) as n_distinct from t group by key),
mc as (select key, m, row_number() over (partition by key order by count(*) desc, m) as rn from t where m is not null group by key, m),
q as (select key, us, row_number() over (partition by key order by us) as rn, count(*) over (partition by key) as c from t where us is not null),
p as (select key, max(us) filter (rn = greatest(1, cast(ceil(c * 0.5) as bigint))) as p50, max(us) filter (rn = greatest(1, cast(ceil(c * 0.99) as bigint))) as p99 from q group by key)
select base.key, n, first_ts, last_ts, n_distinct, mc.m as mode, p50, p99
from base left join mc on base.key = mc.key and mc.rn = 1 left join p on base.key = p.key"""


def _busy(tbl: str) -> str:
    return f"""select '{tbl}' as tbl, key from (select lpad(key, 10, '0') as key, count(*) as n from {tbl} where key is not null group by 1)
where n >= {BUSY} * (select count(*) from {tbl} where key is not null)"""


ORACLE: dict[str, str] = {
    "p1_found": _P1 + "select group_id, key, idx from last where rn = 1 and kind = 'set'",
    "p1_state": _P1 + "select group_id, key, idx, value from last where rn = 1 and kind = 'set'",
    "p1_incremental": _P1 + "select group_id, key, idx, value from last where rn = 1 and kind = 'set'",
    "p4_found": _DELIVERY + "select recv_id from r where again",
    "p4_batches": _DELIVERY + "select recv_id from r where again",
    "p4_kept": _DELIVERY + "select recv_id, client_id, seq_id, key, value, op from r where not again or again is null",
    "p4_ranges": """
with s as (select distinct client_id, seq_id from put_request where client_id is not null and seq_id is not null and key is not null and recv_id is not null),
g as (select *, seq_id - row_number() over (partition by client_id order by seq_id) as run from s)
select client_id, min(seq_id) as lo, max(seq_id) as hi, cast(count(*) as bigint) as numbers from g group by client_id, run""",
    "p5_found": _busy("get_request") + " union all " + _busy("put_request"),
    "p5_get_profile": _profile("get_request", "req_ts", "err", "epoch_us(logged_ts) - epoch_us(req_ts)"),
    "p5_put_profile": _profile("put_request", "recv_ts", "node_id", "epoch_us(recv_ts) - epoch_us(send_ts)"),
}
