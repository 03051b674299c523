"""Streams end in the same state as batches."""

from pyspark.sql import functions as F

from strandlog.operators import changefeed
from strandlog.streaming import latest as streams
from strandlog.sources.shared import new_path

SCHEMA = "group_id int, idx int, term int, op string, key string, value string, client_id long, seq_id long, at timestamp"


def spool(spark, n=60, files=4):
    path = new_path(spark, "spool")
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("group_id"), F.col("id").cast("int").alias("idx"), F.lit(1).alias("term"), F.when(F.col("id") % 5 == 0, "Delete").otherwise("Put").alias("op"),
                               (F.col("id") % 7).cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.lit(1).cast("long").alias("client_id"), (F.col("id") % 50).alias("seq_id"),
                               F.timestamp_seconds(1_700_000_000 + F.col("id") * F.when(F.col("id") < 30, 1).otherwise(100)).alias("at"))
    df.repartition(files).write.parquet(path)
    return df, streams.log_stream(spark, path, SCHEMA, 1)


def test_stream_equals_batch(spark):
    df, stream = spool(spark)
    target = new_path(spark, "applied")
    streams.apply_stream(stream, target, new_path(spark, "c")).awaitTermination()
    assert sorted(map(tuple, streams.read_applied(spark, target).select("group_id", "key", "idx", "value").collect())) == sorted(map(tuple, changefeed.apply_feed(df).select("group_id", "key", "idx", "value").collect()))


def drain(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_latest_stream(spark):
    df, stream = spool(spark)
    got = {(r.group_id, r.key): (r.idx, r.kind) for r in drain(spark, streams.latest_stream(stream), "complete", "latest_rows")}
    last = df.groupBy("group_id", F.lpad("key", 10, "0").alias("key")).agg(F.max(F.struct("idx", "op")).alias("m"))
    want = {(r.group_id, r.key): (r.m.idx, "set" if r.m.op == "Put" else "remove") for r in last.collect()}
    assert got == want


def test_sessions_and_spells(spark):
    _, stream = spool(spark, files=1)
    once = drain(spark, streams.once_per_session(stream, "at"), "append", "once_rows")
    assert len(once) == 50
    _, stream = spool(spark, files=1)
    spells = drain(spark, streams.busy_spells(stream, "at", "1 minute", "1 second"), "append", "spell_rows")
    assert all(r.ended > r.started and r.n > 0 for r in spells)


def test_timeouts(spark):
    _, stream = spool(spark, files=1)
    _, answers = spool(spark, files=1)
    late = answers.withColumn("answered", F.col("at") + F.expr("interval 1 second")).filter("idx % 2 = 0")
    rows = drain(spark, streams.timeouts(stream.filter("idx < 50"), late.filter("idx < 50"), "at", "answered"), "append", "timeout_rows")
    assert sum(r.status == "OK" for r in rows) == 25
