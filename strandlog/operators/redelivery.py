"""Exactly one copy of each message that was delivered at least once.

A message is (client, seq, padded key). A client counts its messages, so what a client has sent is kept as
*disjoint ranges* of numbers, which merge as gaps fill. Ranges are stored in blocks of ``BLOCK`` numbers, one
row per client and block with a sorted array of ranges, so that neither a client nor a block can grow
without bound, and a client that sends a third of all messages is spread over its blocks.

Deliveries are taken in batches, a whole table as one:
  1. deliveries are combined by number before the shuffle (first receipt, how many), and the numbers of a client and
     block meet its ranges in one row;
  2. a number that no range covers and that was delivered once is accepted at once, without a look at any key;
  3. of a number that a range covers, or that its first delivery in the batch covers for the later ones, the deliveries are
     copies or come from a counter that started again (a malformed identifier): only these are *asked*, by an exact
     lookup by (client, seq, key) among themselves and the messages accepted in earlier batches;
  4. the new numbers are merged into the ranges.

Defined cases
    null client, seq or key: no identity; every such delivery is kept and none is reported.
    negative or huge numbers: blocks are floor divisions, so any long works.
    ties: receipt numbers are unique; if they aren't, none of the copies with the smallest one is reported, and ``keep_one`` keeps one of them.
    null receipt number: ignored by the report, kept by ``keep_one``.
    empty table: empty result. Other columns may have any name that doesn't start with '_'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.operators.hot import join_on_keys
from strandlog.sources.shared import cut

#: Numbers in a block; a block holds at most half as many disjoint ranges.
BLOCK = 1024
NUMBER, MESSAGE = ["_client", "_seq"], ["_client", "_seq", "_key"]
RANGE = "struct<lo: bigint, hi: bigint>"
RANGES = f"_client long, _block long, _ranges array<{RANGE}>"
ACCEPTED = "_client long, _seq long, _key string"


def block_of(seq: Column) -> Column:
    """Floor division by BLOCK, a power of two, that is exact for any long."""
    return F.shiftright(seq, BLOCK.bit_length() - 1)


def merged(ranges: Column) -> Column:
    """Sorted disjoint ranges with no gap of zero between neighbours, of an array of ranges of one block."""
    empty = F.array().cast(f"array<{RANGE}>")

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (r["lo"] - last["hi"] <= 1), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def runs(column: str) -> Column:
    """The ranges of a column with sorted arrays of structs whose ``_seq`` are distinct numbers of one block: a number opens one if
    its predecessor isn't there, and closes one likewise."""
    numbers = F.col(column)
    opens = F.filter(numbers, lambda x, i: (i == 0) | (x["_seq"] - F.get(numbers, i - 1)["_seq"] != 1))
    closes = F.filter(numbers, lambda x, i: (i == F.size(numbers) - 1) | (F.get(numbers, i + 1)["_seq"] - x["_seq"] != 1))
    return F.zip_with(opens, closes, lambda a, z: F.struct(a["_seq"].alias("lo"), z["_seq"].alias("hi")))


def deliveries(df: DataFrame, recv: str, client: str, seq: str, key: str) -> DataFrame:
    """_recv, _client, _seq and _key (padded) of the deliveries with an identity and a receipt number."""
    d = df.select(F.col(recv).cast("long").alias("_recv"), F.col(client).cast("long").alias("_client"), F.col(seq).cast("long").alias("_seq"), pad_key(key).alias("_key"))
    return d.filter("_recv is not null and _client is not null and _seq is not null and _key is not null")


class SeenRanges:
    """Ranges and accepted messages of the batches so far; both lie in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.ranges: DataFrame | None = None
        self.accepted: DataFrame | None = None

    def take(self, batch: DataFrame, remember: bool = True, parts: int | None = None) -> DataFrame:
        """Takes a batch (_recv and MESSAGE); the deliveries in it that were asked: _recv, MESSAGE, _first (least receipt of the message in
        the batch), _seen (it was accepted in an earlier batch). All others are accepted. Without ``remember`` it is the last batch."""
        each = batch.groupBy(*NUMBER).agg(F.count("*").alias("_n"))
        pair = F.struct("_seq", "_n")
        blocks = each.groupBy("_client", block_of(F.col("_seq")).alias("_block")).agg(F.sort_array(F.collect_list(pair)).alias("_numbers"))  # BLOCK at most
        blocks = blocks.withColumn("_fresh", runs("_numbers"))
        covered = lambda x: x["_n"] > 1
        if self.ranges is not None:
            blocks = blocks.join(self.ranges, ["_client", "_block"], "full")
            empty = F.array().cast(f"array<{RANGE}>")
            old, fresh = F.coalesce("_ranges", empty), F.coalesce("_fresh", empty)
            blocks = blocks.select("_client", "_block", "_numbers", merged(F.concat(old, fresh)).alias("_fresh"), old.alias("_ranges"))
            covered = lambda x: (x["_n"] > 1) | F.exists("_ranges", lambda r: (r["lo"] <= x["_seq"]) & (x["_seq"] <= r["hi"]))
        blocks = cut(blocks.select("_client", "_block", F.col("_fresh").alias("_ranges"), F.size("_numbers").alias("_size"),
                                   F.aggregate("_numbers", F.lit(0).cast("long"), lambda n, x: n + x["_n"]).alias("_rows"), F.filter("_numbers", covered).alias("_asked")), "blocks")
        total = blocks.agg(F.sum("_rows")).first()[0] or 0
        ask = blocks.select("_client", F.inline("_asked"))
        asked = cut(join_on_keys(batch, ask, NUMBER, "_n", total, parts=parts).select("_recv", *MESSAGE), "asked")
        # The exact lookup. A message delivered a third of all times is combined in each task, and met by broadcast.
        found = asked.groupBy(*MESSAGE).agg(F.min("_recv").alias("_first"), F.count("*").alias("_n"))
        found = found.withColumn("_seen", F.lit(False)) if self.accepted is None else found.join(self.accepted.withColumn("_old", F.lit(True)), MESSAGE, "left").withColumn("_seen", F.coalesce("_old", F.lit(False))).drop("_old")
        found = cut(found, "found")
        if remember:
            plain = batch.join(ask.select(*NUMBER), NUMBER, "left_anti").select(*MESSAGE)
            new = cut(plain.unionByName(found.filter("not _seen").select(*MESSAGE)), "accepted")
            self.accepted = new if self.accepted is None else self.accepted.unionByName(new)
        self.ranges = blocks.select("_client", "_block", "_ranges")
        more = found.filter("_seen or _n > 1")
        return join_on_keys(asked, more, MESSAGE, "_n", total, parts=parts).drop("_n")


def batches_of(df: DataFrame, batches: int) -> list[DataFrame]:
    """Consecutive parts by receipt, equal in span; each is a pushed-down range of _recv."""
    if batches == 1:
        return [df]
    lo, hi = df.agg(F.min("_recv"), F.max("_recv")).first()
    if lo is None:
        return []
    step = max(1, -(-(hi - lo + 1) // batches))
    return [df.filter((F.col("_recv") >= lo + i * step) & (F.col("_recv") < lo + (i + 1) * step)) for i in range(batches) if lo + i * step <= hi]


def judge(df: DataFrame, recv: str = "recv_id", client: str = "client_id", seq: str = "seq_id", key: str = "key", batches: int = 1, parts: int | None = None) -> tuple[DataFrame, SeenRanges]:
    """The copies (_recv, MESSAGE) in ``df``, taken in so many batches, and the ranges after them."""
    state = SeenRanges(df.sparkSession)
    found = df.sparkSession.createDataFrame([], "_recv long, " + ACCEPTED)
    todo = batches_of(deliveries(df, recv, client, seq, key), batches)
    for i, batch in enumerate(todo):
        got = state.take(batch, i + 1 < len(todo), parts).filter("_seen or _recv > _first").select("_recv", *MESSAGE)
        found = got if i == 0 else found.unionByName(got)
    return found, state


def copies(df: DataFrame, recv: str = "recv_id", client: str = "client_id", seq: str = "seq_id", key: str = "key", batches: int = 1, parts: int | None = None) -> DataFrame:
    """The receipt number of each delivery that isn't the first of its message."""
    return judge(df, recv, client, seq, key, batches, parts)[0].select(F.col("_recv").alias(recv))


def keep_one(df: DataFrame, recv: str = "recv_id", client: str = "client_id", seq: str = "seq_id", key: str = "key", batches: int = 1) -> DataFrame:
    """``df`` without the copies; deliveries without an identity stay. Of copies that share receipt number, one is kept."""
    state = SeenRanges(df.sparkSession)
    todo = batches_of(deliveries(df, recv, client, seq, key), batches)
    gone, tied = None, None
    for i, batch in enumerate(todo):
        asked = cut(state.take(batch, i + 1 < len(todo)), "judged")
        copy = asked.filter("_seen or _recv > _first").select("_recv", *MESSAGE)
        same = asked.filter("not _seen and _recv = _first").groupBy("_recv", *MESSAGE).count().filter("count > 1").drop("count")
        gone, tied = (copy, same) if gone is None else (gone.unionByName(copy), tied.unionByName(same))
    if gone is None:
        return df
    rows = df.withColumns({"_recv": F.col(recv).cast("long"), "_client": F.col(client).cast("long"), "_seq": F.col(seq).cast("long"), "_key": pad_key(key)})
    kept = rows.join(gone.distinct(), ["_recv", *MESSAGE], "left_anti")
    tied = cut(tied, "tied")
    if not tied.isEmpty():
        kept = kept.join(tied, ["_recv", *MESSAGE], "left_anti").unionByName(kept.join(tied, ["_recv", *MESSAGE], "left_semi").dropDuplicates(["_recv", *MESSAGE]))
    return kept.select(*df.columns)


def whole_ranges(state: SeenRanges) -> DataFrame:
    """The seen ranges of each client, joined over block borders: client_id, lo, hi, numbers.

    Only ranges that touch a border of their block take part. They are sorted into parts, so that a client with most of the
    blocks is spread over tasks; from one part to the next goes one row per client.
    """
    if state.ranges is None:
        return state.spark.createDataFrame([], "client_id long, lo long, hi long, numbers long")
    each = state.ranges.select("_client", "_block", F.inline("_ranges"))
    edge = (F.pmod(F.col("lo"), F.lit(BLOCK)) == 0) | (F.pmod(F.col("hi"), F.lit(BLOCK)) == BLOCK - 1)
    parts = cut(each.filter(edge).repartitionByRange("_client", "lo").withColumn("_part", F.spark_partition_id()), "edges")
    inside, across = Window.partitionBy("_client", "_part").orderBy("lo"), Window.partitionBy("_client").orderBy("_part")
    marked = parts.withColumn("_opens", (~F.coalesce(F.lag("hi").over(inside) == F.try_subtract("lo", F.lit(1)), F.lit(False))).cast("int"))
    sums = marked.groupBy("_client", "_part").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.sum("_opens").alias("_chains"))
    joins = F.coalesce(F.lag("_hi").over(across) == F.try_subtract("_lo", F.lit(1)), F.lit(False)).cast("int")
    shift = sums.withColumn("_joins", joins).withColumn("_shift", F.sum(F.col("_chains") - F.col("_joins")).over(across) - F.col("_chains"))
    chain = F.sum("_opens").over(inside) + F.col("_shift")
    chains = marked.join(shift.select("_client", "_part", "_shift"), ["_client", "_part"]).withColumn("_chain", chain)
    joined = chains.groupBy("_client", "_chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_chain")
    both = each.filter(~edge).select("_client", "lo", "hi").unionByName(joined)
    return both.select(F.col("_client").alias("client_id"), "lo", "hi", (F.col("hi") - F.col("lo") + 1).alias("numbers"))
