"""Queries of the training-data operators, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.llm import bpe, frequent, packing, quantiles, seen, sentences
from strandlog.llm.arrow import bounded_batches
from strandlog.sources.shared import cut
from strandlog.sources.tables import table


#: Share of the rows that makes a key frequent, and the length of the top list.
FREQUENT, TOP = 0.005, 50


def _both(spark: SparkSession, d: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    parts = [f(table(spark, d, name)).select(F.lit(name).alias("tbl"), F.col("value").alias("key"), "n") for name in ("get_request", "put_log")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda df: frequent.at_least(df, pad_key("key"), FREQUENT)).select("tbl", "key")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda df: frequent.top(df, pad_key("key"), TOP))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(table(spark, d, "workload_stats"))


def p3_within(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "workload_stats")
    return quantiles.audit(df, quantiles.percentiles(df))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(table(spark, d, "put_request"), table(spark, d, "value_log"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return seen.rates(table(spark, d, "put_request"), table(spark, d, "value_log"))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per segment its keys, the keys it was asked about, those of them that it has and let through, and whether its wrong answers are
    as many as theory has it (with room for chance)."""
    r = p6_rates(spark, d)
    expected = F.col("theory") * (F.col("probes") - F.col("passed") + F.col("wrong"))
    return r.select("segment", "keys", "probes", (F.col("passed") - F.col("wrong")).alias("found"), (F.col("wrong") <= 2 * expected + 10).alias("as_expected"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the number of its bytes and a digest, of the text that its ids stand for."""
    back = bpe.decode_corpus(p7_ids(spark, d))
    return back.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("digest"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_corpus(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "container_sizes"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Capacity, completeness, cuts and fill of the packing, against the numbers of ids that problem 7 gives the texts."""
    packed = cut(p8_containers(spark, d), "packed")
    sizes = cut(p7_ids(spark, d).select("doc_id", F.size("ids").cast("long").alias("n_tokens")), "sizes")
    return packing.checks(packed, sizes, table(spark, d, "container_sizes"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_top, p3_percentiles, p3_within, p6_found, p6_rates, p6_audit, p7_ids, p7_decoded, p8_containers, p8_fill, p8_checks, p9_found)
}

_COUNTS = """
with k as (select 'get_request' as tbl, key from get_request union all select 'put_log', key from put_log),
c as (select tbl, lpad(key, 10, '0') as key, cast(count(*) as bigint) as n from k where key is not null group by all)
"""

ORACLE: dict[str, str] = {
    "p2_found": _COUNTS + f"select tbl, key from c where n >= {FREQUENT} * (select count(*) from k where k.tbl = c.tbl and k.key is not null)",
    "p2_top": _COUNTS + f"select tbl, key, n from c qualify row_number() over (partition by tbl order by n desc, key) <= {TOP}",
    "p3_within": """
with o as (select result_id, max(workload) as workload, max(run_day) as run_day, max(read_latency_ns) as r, max(write_latency_ns) as w, max(value_size) as s
           from workload_stats where result_id is not null group by 1
           union all select result_id, workload, run_day, read_latency_ns, write_latency_ns, value_size from workload_stats where result_id is null),
v as (select workload, run_day, 'read_latency_ns' as metric from o where r >= 0 union all
      select workload, run_day, 'write_latency_ns' from o where w >= 0 union all select workload, run_day, 'value_size' from o where s >= 0)
select 'day' as scope, workload, run_day, metric, cast(count(*) as bigint) as n, true as within from v group by all
union all select 'all', workload, cast(null as date), metric, cast(count(*) as bigint), true from v group by workload, metric""",
    "p6_audit": f"""
with p as (select recv_id, lpad(key, 10, '0') as key from put_request where key is not null and recv_id is not null),
s as (select min(recv_id) as lo, greatest(1, (max(recv_id) - min(recv_id) + {seen.WAVES}) // {seen.WAVES}) as step from p),
w as (select distinct cast((recv_id - lo) // step as int) as wave, key from p, s),
k as (select distinct lpad(key, 10, '0') as key, 0 as segment from value_log where key is not null),
f as (select key, min(wave) + 1 as segment from w where key not in (select key from k) group by 1 union all select key, segment from k)
select segment, count(distinct f.key) as keys, (select count(*) from w where wave >= segment) as probes, count(*) filter (wave >= segment) as found, true as as_expected
from f left join w using (key) group by segment having probes > 0""",
    "p7_decoded": "select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as bytes, md5(coalesce(text, '')) as digest from documents",
    "p8_checks": "select size_id, (select count(*) from documents) as items, cast(0 as bigint) as overfull, cast(0 as bigint) as incomplete, cast(0 as bigint) as cut_wrongly, true as near_bound from container_sizes where max_tokens >= 1",
    "p6_found": """
with p as (select recv_id, lpad(key, 10, '0') as pkey from put_request where key is not null and recv_id is not null),
r as (select *, min(recv_id) over (partition by pkey) as first from p)
select recv_id from r where recv_id > first or pkey in (select lpad(key, 10, '0') from value_log where key is not null)""",
}
