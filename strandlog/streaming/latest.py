"""The put log as a stream.

Streams of entries (columns as ``operators.putlog.ENTRY``) in, tables or state out. Late and repeated entries are handled by
the operators themselves: the newest index wins whenever it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strandlog.functions.keys import clean_op, pad_key
from strandlog.operators.changefeed import REMOVING_OP, SETTING_OPS, EqualityDeleteTable, entries


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's changes to a merge-on-read table, under the number of the batch, so that a batch that is
    repeated after a failure counts once. Rows may arrive in any order, those of one entry in different batches too."""

    def put(batch: DataFrame, number: int) -> None:
        EqualityDeleteTable(batch.sparkSession, table).append(entries(batch), str(number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_applied(spark: SparkSession, table: str, like: StructType | None = None) -> DataFrame:
    """The state after all batches that were applied, of a stream of schema ``like``."""
    return EqualityDeleteTable(spark, table, like).read()


def latest_stream(stream: DataFrame) -> DataFrame:
    """Newest change per group and padded key, as a streaming aggregate with state in the store: group_id, key, idx, kind, value.

    For logs whose entries are final (of committed ones a (group, idx) has one term). A key whose ``kind`` is 'remove' is absent;
    the row stays, or an older set that arrives later would bring it back.
    """
    op = clean_op("op")
    kind = F.when(op.isin(*SETTING_OPS), "set").when(op == REMOVING_OP, "remove")
    changes = stream.withColumn("kind", kind).filter("kind is not null and key is not null and idx is not null")
    return changes.groupBy("group_id", pad_key("key").alias("key")).agg(F.max(F.struct("idx", "kind", "value")).alias("m")).select("group_id", "key", "m.idx", "m.kind", "m.value")


def once_per_session(stream: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """One entry per (client, seq) within the delay; the default elsewhere is to keep all of them."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["client_id", "seq_id"])


def busy_spells(stream: DataFrame, ts: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per group the spells without a gap of idle time: started, ended, n."""
    spells = stream.withWatermark(ts, delay).groupBy("group_id", F.session_window(ts, gap).alias("s"))
    return spells.agg(F.count("*").alias("n")).select("group_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def timeouts(requests: DataFrame, answers: DataFrame, sent: str, answered: str, seconds: int = 3) -> DataFrame:
    """Requests joined with answers that came within the time; unanswered ones have status 'defeat'."""
    q = requests.withWatermark(sent, "1 minute").select("client_id", "seq_id", F.col(sent).alias("sent"))
    a = answers.withWatermark(answered, "1 minute").select(F.col("client_id").alias("_c"), F.col("seq_id").alias("_s"), F.col(answered).alias("answered"))
    near = (F.col("client_id") == F.col("_c")) & (F.col("seq_id") == F.col("_s")) & (F.col("answered") >= F.col("sent")) & (F.col("answered") <= F.col("sent") + F.expr(f"interval {seconds} seconds"))
    return q.join(a, near, "leftOuter").select("client_id", "seq_id", "sent", "answered", F.when(F.col("answered").isNull(), "defeat").otherwise("OK").alias("status"))
