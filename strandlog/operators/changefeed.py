"""Current state of a table from a feed of inserts, updates and deletes.

The feed is stored as a merge-on-read table: every change appends an *equality delete* (key, sequence
number), and every change that sets a value also appends an *insert* (key, sequence number, value). The two
kinds go to separate files. A reader takes the inserts without those for whose key a later delete exists.
Nothing is rewritten on ingest, batches may arrive in any order, and applying a batch twice changes nothing.

A sequence number is (idx, term). Inside a batch only rows of the greatest term of a (group, idx) are appended. As a later
batch may bring a greater one, rows carry their term, and an entry that changes nothing appends a *term* (group, idx, term), too.
With more than one batch the reader takes the positions at which the terms differ and drops, of inserts and deletes, the rows of lesser ones.

Defined cases
    null idx or null group: the row is ignored (it has no place in the order).
    several terms for one (group, idx): only rows of the greatest term hold; a null term is the least.
    repeated rows: one entry; of differing values the one that isn't null and isn't the trimming
        marker 'NULL' is kept, the greatest of several.
    null key: changes nothing, but its term counts.
    unknown or null operation: changes nothing, but its term counts.
    null or empty value of a set: the key is present with that value.
    a set and a delete of one key at the same idx and term: the set holds.
    empty feed: empty state with the same schema. Columns besides those named are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlog.functions.keys import clean_op, pad_key
from strandlog.operators.hot import hot_rows
from strandlog.sources.shared import cut, list_names, new_path

#: Operations that set a value, and the one that removes a key.
SETTING_OPS = ("put", "insert", "update")
REMOVING_OP = "delete"
#: Fixed value: what a trimmed entry holds instead of its value.
TRIMMED = "NULL"


def real_value(value: Column) -> Column:
    """Of repeated entries the value to keep, as an aggregate."""
    return F.coalesce(F.max(F.when(value != TRIMMED, value)), F.max(value))


def entries(feed: DataFrame) -> DataFrame:
    """The entries that hold inside a batch: group_id, idx, term, kind ('set', 'remove', 'none'), key (padded), value.

    Rows that are alike in what counts collapse before the first shuffle, in a hash aggregate, so that an entry repeated in a third of all
    rows costs no more than one row per input partition; then the greatest term of each (group, idx) is chosen. Of an entry
    with several values all are kept here; the reader takes the real one.
    """
    op = clean_op("op")
    kind = F.when(F.col("key").isNull(), "none").when(op.isin(*SETTING_OPS), "set").when(op == REMOVING_OP, "remove").otherwise("none")
    rows = feed.filter(F.col("idx").isNotNull() & F.col("group_id").isNotNull()).select("group_id", "idx", F.coalesce("term", F.lit(-1).cast(feed.schema["term"].dataType)).alias("term"), kind.alias("kind"), pad_key("key").alias("key"), "value")
    once = rows.select("group_id", "idx", "term", "kind", F.when(F.col("kind") != "none", F.col("key")).alias("key"), F.when(F.col("kind") == "set", F.col("value")).alias("value")).distinct()
    newest = F.max("term").over(Window.partitionBy("group_id", "idx"))
    return once.withColumn("newest", newest).filter(F.col("term") == F.col("newest")).drop("newest")


def changes(held: DataFrame) -> DataFrame:
    """The rows to append for entries: content ('delete', 'insert' or 'term'), group_id, key, seq, term, value."""
    part = lambda content, value: F.struct(F.lit(content).alias("content"), value.alias("value"))
    nothing = F.lit(None).cast("string")
    term, remove, insert = part("term", nothing), part("delete", nothing), part("insert", F.col("value"))
    rows = F.when(F.col("kind") == "set", F.array(remove, insert)).when(F.col("kind") == "remove", F.array(remove)).otherwise(F.array(term))
    each = held.select("group_id", "key", F.col("idx").alias("seq"), "term", F.explode(rows).alias("c"))
    return each.select("group_id", "key", "seq", "term", "c.value", "c.content")


class EqualityDeleteTable:
    """A merge-on-read table below ``path``: batch=.../content=insert/, content=delete/ and content=term/."""

    def __init__(self, spark: SparkSession, path: str, like: StructType | None = None) -> None:
        """``like``: the schema of the feed, for the types of group_id, idx and term, which are int without it."""
        kinds = {f.name: f.dataType.simpleString() for f in like.fields} if like else {}
        group, seq, term = (kinds.get(c, "int") for c in ("group_id", "idx", "term"))
        self.schema = f"group_id {group}, key string, seq {seq}, term {term}, value string, batch string, content string"
        self.spark, self.path = spark, path

    def append(self, held: DataFrame, batch: str | None = None) -> "EqualityDeleteTable":
        """Adds the changes of a batch of entries in one pass. A batch with a name replaces what was appended under it, so that a
        batch repeated after a failure counts once."""
        changes(held).write.mode("overwrite").partitionBy("content").parquet(f"{self.path}/batch={batch or uuid.uuid4().hex}")
        return self

    def _files(self, *contents: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("content").isin(*contents)).drop("content", "batch")

    def superseded(self) -> DataFrame | None:
        """(group_id, seq, top) where batches brought several terms; None if there was one batch only, which holds no such rows."""
        if len([x for x in list_names(self.spark, self.path) if x.startswith("batch=")]) < 2:
            return None
        per = self._files("term", "delete").groupBy("group_id", "seq").agg(F.min("term").alias("least"), F.max("term").alias("top"))
        return cut(per.filter("least < top").select(F.col("group_id").alias("_g"), F.col("seq").alias("_s"), "top"), "superseded")

    @staticmethod
    def _holding(rows: DataFrame, over: DataFrame | None) -> DataFrame:
        if over is None:
            return rows
        return rows.join(over, (F.col("group_id") == F.col("_g")) & (F.col("seq") == F.col("_s")) & (F.col("term") < F.col("top")), "left_anti")

    def compact_deletes(self, over: DataFrame | None = None) -> DataFrame:
        """Per key the greatest delete and the number of deletes, combined before the shuffle."""
        return self._holding(self._files("delete"), over).groupBy("group_id", "key").agg(F.max("seq").alias("gone"), F.count("*").alias("n"))

    def read(self, parts: int | None = None) -> DataFrame:
        """The live rows: group_id, key, idx, value.

        The dead rows of a hot key fall to a broadcast of the at most ``parts`` hot deletes before any
        shuffle; the other rows are anti-joined with the deletes by key. Several inserts of one key at one
        sequence number are one row.
        """
        over = self.superseded()
        inserts, deletes = self._holding(self._files("insert"), over), cut(self.compact_deletes(over), "deletes")
        total = deletes.agg(F.sum("n")).first()[0] or 0

        def without_later(rows: DataFrame, gone: DataFrame) -> DataFrame:
            d = gone.select(F.col("group_id").alias("g"), F.col("key").alias("k"), "gone")
            hint = F.broadcast(d) if gone is hot else d
            return rows.join(hint, (F.col("group_id") == F.col("g")) & (F.col("key") == F.col("k")) & (F.col("gone") > F.col("seq")), "left_anti")

        hot = hot_rows(deletes, "n", total, parts)
        live = without_later(without_later(inserts, hot), deletes)
        return live.groupBy("group_id", "key", F.col("seq").alias("idx")).agg(real_value(F.col("value")).alias("value"))


def apply_feed(feed: DataFrame, path: str | None = None) -> DataFrame:
    """State after all changes of ``feed``: group_id, key, idx of the entry that set it, value."""
    spark = feed.sparkSession
    table = EqualityDeleteTable(spark, path or new_path(spark, "changes"), feed.schema)
    return table.append(entries(feed)).read()
