"""Computations of a replicated log as table operators.

A log has columns grp, idx, term and others. Defined cases: null idx or term: no entry; groups with no rows give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.operators.ordered import numbered
from strandlog.sources.shared import cut


def quorum_index(matches: Column) -> Column:
    """Of an array of match indexes the one at place n div 2 in ascending order.

    For an odd number of nodes a majority holds it; for an even number only half of the nodes surely do.
    """
    return F.element_at(F.array_sort(matches), (F.floor(F.size(matches) / 2) + 1).cast("int"))


def commit_index(progress: DataFrame, group: str, match: str, nodes: int) -> DataFrame:
    """Per group with all ``nodes`` peers (one row each) the committed index."""
    got = progress.groupBy(group).agg(F.collect_list(match).alias("_m"))  # as many as there are nodes
    return got.filter(F.size("_m") == nodes).select(group, quorum_index(F.col("_m")).alias("commit_idx"))


def advance(current: Column, candidate: Column, candidate_term: Column, term: Column) -> Column:
    """A leader moves its commit index only forward, and only over entries of its own term."""
    return F.when((candidate > current) & (candidate_term == term), candidate).otherwise(current)


def first_conflict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per group the least index at which two logs (grp, idx, term) hold different terms."""
    other = b.select("grp", "idx", F.col("term").alias("_other"))
    return a.join(other, ["grp", "idx"]).filter(F.col("term") != F.col("_other")).groupBy("grp").agg(F.min("idx").alias("conflict_idx"))


def received(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """A follower's log after it took over the leader's: its entries before the first conflict, then the leader's.

    Entries beyond the leader's end stay if there is no conflict, as the leader may send more.
    """
    conflict = first_conflict(follower, leader)
    kept = follower.join(conflict, "grp", "left").filter(F.col("conflict_idx").isNull() | (F.col("idx") < F.col("conflict_idx"))).drop("conflict_idx")
    new = leader.join(kept.select("grp", "idx"), ["grp", "idx"], "left_anti")
    return kept.unionByName(new)


def follower_commit(leader_commit: Column, last_index: Column) -> Column:
    return F.least(leader_commit, last_index)


def append_replies(follower: DataFrame, leader: DataFrame, requests: DataFrame) -> DataFrame:
    """What a follower answers to the entries after ``prev_idx`` that a leader sends.

    ``requests``: grp, prev_idx, prev_term, leader_commit, own_commit, one row per group. The result has those and
      success: false if the follower has no entry at ``prev_idx`` (which isn't 0), or one of another term;
      conflict_term, conflict_idx of a refusal: -1 and the place after its last entry, or the other term and where it begins to occur;
      last_idx: the follower's last index afterwards; commit_idx: the least of that and the leader's, never less than its own.
    """
    per = follower.groupBy("grp").agg(F.max("idx").alias("_last"))
    there = follower.select("grp", F.col("idx").alias("prev_idx"), F.col("term").alias("_at"))
    asked = requests.join(per, "grp", "left").withColumn("_last", F.coalesce("_last", F.lit(0))).join(there, ["grp", "prev_idx"], "left")
    missing = F.col("prev_idx") > F.col("_last")
    other = ~missing & (F.col("prev_idx") != 0) & ~F.col("_at").eqNullSafe(F.col("prev_term"))
    asked = asked.withColumns({"success": ~missing & ~other, "conflict_term": F.when(other, F.col("_at")).otherwise(-1).cast("long")})
    first = follower.select("grp", F.col("term").cast("long").alias("conflict_term"), "idx").join(asked.filter("conflict_term <> -1").select("grp", "conflict_term", "prev_idx"), ["grp", "conflict_term"]).filter("idx <= prev_idx").groupBy("grp").agg(F.min("idx").alias("_first"))
    sent = leader.join(asked.filter("success").select("grp", "prev_idx"), "grp").filter("idx > prev_idx").select("grp", "idx", "term")
    # Behind the first entry that differs in term the follower's own entries go.
    differs = first_conflict(follower, sent).withColumnRenamed("conflict_idx", "_differs")
    ends = sent.groupBy("grp").agg(F.max("idx").alias("_sent"))
    out = asked.join(first, "grp", "left").join(differs, "grp", "left").join(ends, "grp", "left")
    last = F.when(~F.col("success"), F.col("_last")).when(F.col("_differs").isNotNull(), F.col("_sent")).otherwise(F.greatest("_last", F.coalesce("_sent", F.lit(0))))
    commit = F.when(F.col("success") & (F.col("leader_commit") > F.col("own_commit")), follower_commit(F.col("leader_commit"), F.col("last_idx"))).otherwise(F.col("own_commit"))
    return out.withColumns({"last_idx": last, "conflict_idx": F.when(missing, F.col("_last") + 1).when(other, F.col("_first"))}).withColumn("commit_idx", commit).select(*requests.columns, "success", "conflict_term", "conflict_idx", "last_idx", "commit_idx")


def backoff(leader: DataFrame, refused: DataFrame) -> DataFrame:
    """Next index to try per group (columns grp, prev_idx, conflict_term, conflict_idx).

    Going down from ``prev_idx`` the leader passes its entries of the conflicting term: behind the last entry of another term it tries
    again. If there is none, or the follower's log was too short (term -1), it is the follower's ``conflict_idx``.
    """
    other = leader.join(refused.select("grp", "prev_idx", "conflict_term"), "grp").filter("idx <= prev_idx and term <> conflict_term and conflict_term <> -1").groupBy("grp").agg(F.max("idx").alias("_other"))
    return refused.join(other, "grp", "left").select("grp", F.coalesce(F.col("_other") + 1, F.col("conflict_idx")).alias("next_idx"))


def last_entries(log: DataFrame) -> DataFrame:
    return log.groupBy("grp").agg(F.max(F.struct("idx", "term")).alias("m")).select("grp", F.col("m.term").alias("last_term"), F.col("m.idx").alias("last_idx"))


def up_to_date(cand_term: Column, cand_idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Whether a candidate's last entry is at least as new as the voter's."""
    return F.struct(cand_term.alias("t"), cand_idx.alias("i")) >= F.struct(own_term.alias("t"), own_idx.alias("i"))


def votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """``requests`` with ``granted``, in the order of ``seq``.

    ``requests``: voter, seq, term, candidate, last_term, last_idx; ``voters``: voter, own_term, voted_for (null: nobody yet in
    that term), own_last_term, own_last_idx. A term below the greatest the voter has met is refused. In each term there is one vote:
    it goes to the first candidate whose log is up to date, who gets it again if they ask again.
    """
    r = requests.join(voters, "voter")
    earlier = Window.partitionBy("voter").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    in_term = Window.partitionBy("voter", "term").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    current = F.greatest("own_term", F.coalesce(F.max("term").over(earlier), F.col("own_term")))
    fresh = up_to_date(F.col("last_term"), F.col("last_idx"), F.col("own_last_term"), F.col("own_last_idx"))
    r = r.withColumn("_ok", F.col("term") >= current).withColumn("_fresh", F.col("_ok") & fresh)
    chosen = F.first(F.when(F.col("_fresh"), F.col("candidate")), ignorenulls=True).over(in_term)
    holder = F.when((F.col("term") == F.col("own_term")) & F.col("voted_for").isNotNull(), F.col("voted_for")).otherwise(chosen)
    return r.withColumn("granted", F.coalesce(F.col("_fresh") & (F.col("candidate") == holder), F.lit(False))).select(*requests.columns, "granted")


def majority(granted: Column, nodes: Column) -> Column:
    """With its own vote, does a candidate have more than half of the nodes?"""
    return granted + 1 > F.floor(nodes / 2)


def sent_batch(log: DataFrame, size: Column, cap: int) -> DataFrame:
    """The leading entries of a log (idx) that a sender takes whose counter adds the whole buffer at each step.

    Both running sums are prefix sums over the range-partitioned log.
    """
    first = numbered(log.withColumn("_sz", size), ["idx"], {"_earlier": F.col("_sz")}).withColumn("_buffer", F.col("_earlier") + F.col("_sz")).drop("rn", "_earlier")
    second = numbered(first, ["idx"], {"_counted": F.col("_buffer")})
    return second.withColumn("counter", F.col("_counted") + F.col("_buffer")).filter(F.col("counter") <= cap).drop("rn", "_counted", "_buffer", "_sz")


def to_apply(log: DataFrame, applied: Column, commit: Column) -> DataFrame:
    """Entries after the applied and up to the committed index."""
    return log.filter((F.col("idx") > applied) & (F.col("idx") <= commit))


def rising_only(df: DataFrame, client: str, seq: str, order: str) -> DataFrame:
    """Rows whose number exceeds every earlier one of their client; rows with a null in either stay out.

    A client's rows are spread over ranges of the order; what the ranges before hold is one number per client and range.
    """
    rows = df.filter(F.col(client).isNotNull() & F.col(seq).isNotNull() & F.col(order).isNotNull())
    stored = cut(rows.repartitionByRange(client, order).withColumn("_part", F.spark_partition_id()), "by-client")
    earlier = Window.partitionBy(client).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = stored.groupBy(client, "_part").agg(F.max(seq).alias("_top")).withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    w = Window.partitionBy(client, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = stored.join(tops, [client, "_part"]).withColumn("_max", F.greatest(F.max(seq).over(w), F.col("_before")))
    return seen.filter(F.col("_max").isNull() | (F.col(seq) > F.col("_max"))).drop("_max", "_before", "_part")


def sessions(df: DataFrame, client: str, seq: str, idx: str) -> DataFrame:
    """client -> number of its last applied request."""
    return df.filter(F.col(client).isNotNull() & F.col(idx).isNotNull()).groupBy(client).agg(F.max(F.struct(idx, seq))[seq].alias("last_seq"))
