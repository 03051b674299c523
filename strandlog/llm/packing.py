"""Placing items into containers of fixed capacity by exact complements.

Only lengths matter for where items fit, so the search runs on the histogram of lengths, which has at most
capacity + 1 rows however many items there are, and yields *patterns*: lengths that share a container, and how
many such containers there are. Single, pair and triple sums of available lengths are indexed; beginning
with the longest, a length takes the combination that fills its gap exactly as often as the counts allow; a gap that no triple fills takes one length and a triple. What
has no exact complement is placed by best fit, longest first. Then every item gets its rank among the items of its
length, from prefix sums over buckets so that a length that a third of all items share is ranked in
parallel, and the rank names its container.

Defined cases: an item longer than the capacity is cut into full pieces and one rest; no other item is cut. Items of
no tokens (null and empty texts) take no room and lie in container 0. Ties are broken by the item's id; rows
repeated with one id are placed each. A container size that is null or less than 1 gets no rows. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.arrow import bounded_batches
from strandlog.llm.bpe import DEFAULT_DIR
from strandlog.sources.shared import cut

RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern for words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items in a bucket of ranks, on average over all lengths.
BUCKET = 100_000
#: Exhausted lengths after which the index of sums is rebuilt.
REBUILD = 64
#: Lengths in the complements that are searched for, each by itself.
DEPTHS = (4, 2, 1)

_encodings: dict = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", directory: str = DEFAULT_DIR, ranks: str = RANKS) -> DataFrame:
    """(doc, n_tokens) of whole texts."""
    bounded_batches(df.sparkSession)
    path = os.path.join(directory, ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoding(path)
        for b in batches:
            n = [len(e.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["_doc", "n_tokens"])

    rows = df.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    return rows.mapInArrow(count, f"_doc {kind}, n_tokens long").withColumnRenamed("_doc", doc)


class Sums:
    """Which lengths one, two and three available items make together, up to the capacity.

    The sums are an index that may be out of date as lengths run out, so what it proposes is checked against the counts.
    """

    def __init__(self, count: np.ndarray) -> None:
        self.count, self.capacity = count, len(count) - 1
        self.rebuild()

    def rebuild(self) -> None:
        self.gone = 0
        mask = (1 << (self.capacity + 1)) - 1
        lengths = np.flatnonzero(self.count).tolist()
        one = sum(1 << x for x in lengths)
        two = three = 0
        for x in lengths:
            two |= one << x & mask
        for x in lengths:
            three |= two << x & mask
        self.two, self.three = (np.unpackbits(np.frombuffer(v.to_bytes(self.capacity // 8 + 1, "little"), dtype=np.uint8), bitorder="little").astype(bool) for v in (two, three))

    def free(self, taken: list[int], *more: int) -> bool:
        need = Counter([*taken, *more])
        return all(self.count[x] >= need[x] for x in more)

    def pair(self, gap: int, most: int, taken: list[int]) -> list[int] | None:
        """Two lengths of at most ``most`` with sum ``gap``, the longest first."""
        lo, hi = (gap + 1) // 2, min(gap - 1, most)
        if hi < lo:
            return None
        there = self.count > 0
        for i in np.flatnonzero(there[lo : hi + 1] & there[gap - hi : gap - lo + 1][::-1])[::-1].tolist():
            if self.free(taken, lo + i, gap - lo - i):
                return [lo + i, gap - lo - i]
        return None

    def fill(self, gap: int, taken: list[int], most: int = 4) -> list[int] | None:
        """The fewest available lengths, up to ``most`` (1, 2 or 4), whose sum is ``gap``, the longest first; ``taken`` are taken already."""
        if self.count[gap] and self.free(taken, gap):
            return [gap]
        if most == 1:
            return None
        if found := self.two[gap] and self.pair(gap, gap - 1, taken):
            return found
        if most == 2:
            return None
        there = self.count > 0
        if self.three[gap]:
            lo = -(-gap // 3)
            for i in np.flatnonzero(there[lo : gap - 1] & self.two[2 : gap - lo + 1][::-1])[::-1].tolist():
                if self.free(taken, lo + i) and (found := self.pair(gap - lo - i, lo + i, [*taken, lo + i])):
                    return [lo + i, *found]
        # Failing that, the longest for which a triple fills what it leaves.
        if gap > 3:
            lo = -(-gap // 4)
            for i in np.flatnonzero(there[lo : gap - 2] & self.three[3 : gap - lo + 1][::-1])[::-1].tolist():
                y, rest = lo + i, gap - lo - i
                if not self.free(taken, y):
                    continue
                first = -(-rest // 3)
                for j in np.flatnonzero(there[first : rest - 1] & self.two[2 : rest - first + 1][::-1])[::-1].tolist():
                    z = first + j
                    if z <= y and self.free([*taken, y], z) and (found := self.pair(rest - z, z, [*taken, y, z])):
                        return [y, z, *found]
        return None


def patterns(count: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of containers, the lengths in each) that place all items of lengths 1 to ``capacity``.

    Combinations of many lengths leave fewer short ones for the residuals, so that shallower searches are made, too; the least number of containers wins.
    """
    return min((complements(count, capacity, most) for most in DEPTHS), key=lambda found: sum(n for n, _ in found))


def complements(count: dict[int, int], capacity: int, most: int) -> list[tuple[int, list[int]]]:
    """``patterns`` of one search with complements of up to ``most`` lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in count.items():
        if 0 < x <= capacity:
            left[x] = n
    out = [(int(left[capacity]), [capacity])] if left[capacity] else []
    left[capacity] = 0
    sums = Sums(left)
    for x in np.flatnonzero(left)[::-1].tolist():
        while left[x]:
            mates = sums.fill(capacity - x, [x], most)
            if mates is None:
                break
            need = Counter([x, *mates])
            r = min(int(left[y]) // k for y, k in need.items())
            out.append((r, [x, *mates]))
            for y, k in need.items():
                left[y] -= r * k
                sums.gone += left[y] == 0
            if sums.gone >= REBUILD:
                sums.rebuild()
    count = {int(x): int(left[x]) for x in np.flatnonzero(left)}
    # Best fit: of the open containers the fullest in which the length fits. Containers alike are one class.
    gaps: list[int] = []
    opened: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(gap: int, n: int, lengths: tuple[int, ...]) -> None:
        if gap not in opened:
            bisect.insort(gaps, gap)
        opened.setdefault(gap, []).append((n, lengths))

    for x in sorted((x for x, n in count.items() if n), reverse=True):
        left = count[x]
        while left and (i := bisect.bisect_left(gaps, x)) < len(gaps):
            gap = gaps[i]
            n, lengths = opened[gap].pop()
            if not opened[gap]:
                del opened[gap], gaps[i]
            m = min(n, left)
            if n > m:
                put(gap, n - m, lengths)
            left -= m
            put(gap - x, m, (*lengths, x))
        each = capacity // x
        for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
            if n:
                put(capacity - x * k, n, (x,) * k)
    return out + [(n, list(lengths)) for gap in sorted(opened) for n, lengths in opened[gap]]


SLOT = "size_id int, n int, start long, container long"


def slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one size: items of length n and rank start, start + 1, ... lie in container, container + 1, ..."""
    size, capacity = int(pdf["size_id"].iloc[0]), int(pdf["max_tokens"].iloc[0])
    rows, used, base = [(size, 0, 0, 0)], Counter(), 0
    for r, lengths in patterns(dict(zip(pdf["n"].tolist(), pdf["k"].tolist())), capacity):
        for x in lengths:
            rows.append((size, x, used[x], base))
            used[x] += r
        base += r
    return pd.DataFrame(rows, columns=["size_id", "n", "start", "container"])


def capacities(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """``rows`` once for each usable row of ``containers``, a handful by its nature, which becomes part of the plan."""
    sized = sorted((int(r.size_id), int(r.max_tokens)) for r in containers.select("size_id", "max_tokens").collect() if r.size_id is not None and (r.max_tokens or 0) >= 1)
    each = F.array(*(F.struct(F.lit(i).alias("size_id"), F.lit(m).alias("max_tokens")) for i, m in sized)).cast("array<struct<size_id: int, max_tokens: int>>")
    return rows.select("*", F.inline(each))


def items_of(sizes: DataFrame, containers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(size_id, max_tokens, doc, n, first, k): k pieces of n tokens, numbered from first; two rows an item at most."""
    per = capacities(sizes.select(F.col(doc), "n_tokens"), containers)
    full, rest = F.expr("n_tokens div max_tokens"), F.expr("n_tokens % max_tokens")
    whole = F.struct(F.col("max_tokens").cast("int").alias("n"), F.lit(0).cast("long").alias("first"), full.cast("long").alias("k"))
    end = F.struct(rest.cast("int").alias("n"), full.cast("long").alias("first"), F.lit(1).cast("long").alias("k"))
    parts = F.when(full == 0, F.array(end)).when(rest == 0, F.array(whole)).otherwise(F.array(whole, end))
    return per.select("size_id", "max_tokens", doc, F.explode(parts).alias("p")).select("size_id", "max_tokens", doc, "p.n", "p.first", "p.k")


def pack(sizes: DataFrame, containers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(size_id, doc, piece, n_tokens, container) for items (doc, n_tokens); ``sizes`` is read twice, so give a stored table."""
    spark: SparkSession = sizes.sparkSession
    buckets = max(8, -(-sizes.count() // BUCKET))
    items = items_of(sizes, containers, doc).withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int"))
    per_bucket = items.groupBy("size_id", "max_tokens", "n", "bucket").agg(F.sum("k").alias("k"))
    found = per_bucket.groupBy("size_id", "max_tokens", "n").agg(F.sum("k").alias("k")).groupBy("size_id").applyInPandas(slots, SLOT).toPandas()
    table: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for key, g in found.sort_values("start", kind="stable").groupby(["size_id", "n"]):
        table[key] = g["start"].to_numpy(), g["container"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    before = F.sum("k").over(Window.partitionBy("size_id", "n").orderBy("bucket")) - F.col("k")
    offset = per_bucket.select("size_id", "n", "bucket", before.alias("offset"))
    inside = F.sum("k").over(Window.partitionBy("size_id", "n", "bucket").orderBy(doc, "first").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    ranked = items.withColumn("inside", inside).join(offset, ["size_id", "n", "bucket"]).select(
        "size_id", doc, "n", "k", "first", (F.col("offset") + F.col("inside")).alias("rank"))
    each = ranked.select("size_id", doc, "n", "first", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i")).select(
        "size_id", doc, (F.col("first") + F.col("i")).alias("piece"), "n", (F.col("rank") + F.col("i")).alias("rank"))

    @F.pandas_udf("long")
    def container(size: pd.Series, n: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), dtype=np.int64)
        order = np.lexsort((n.to_numpy(), size.to_numpy()))
        s, x, r = size.to_numpy()[order], n.to_numpy()[order], rank.to_numpy()[order]
        edges = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])) if len(s) else np.array([], dtype=int)
        for a, b in zip(edges, [*edges[1:], len(s)]):
            if x[a]:
                start, first = shared.value[int(s[a]), int(x[a])]
                i = np.searchsorted(start, r[a:b], side="right") - 1
                out[order[a:b]] = first[i] + r[a:b] - start[i]
        return pd.Series(out)

    return each.select("size_id", doc, "piece", F.col("n").alias("n_tokens"), container("size_id", "n", "rank").alias("container"))


def pack_corpus(documents: DataFrame, containers: DataFrame, doc: str = "doc_id", text: str = "text", directory: str = DEFAULT_DIR) -> DataFrame:
    """``pack`` of whole texts; the token counts are stored once in the shared folder."""
    return pack(cut(token_counts(documents, doc, text, directory), "token-counts"), containers, doc)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per size: containers, pieces, tokens, and the share of the room that is used."""
    per = packed.groupBy("size_id").agg((F.max("container") + 1).alias("containers"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.join(F.broadcast(containers.select("size_id", "max_tokens")), "size_id").withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6))


def checks(packed: DataFrame, sizes: DataFrame, containers: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per size: items, and of a packing how many containers hold more than they can, items miss or gained tokens, and items were cut that
    fit; and whether there are at most 1 % (and three) more containers than the tokens fill. ``sizes`` (doc, n_tokens) may be counted by other means."""
    room = F.broadcast(containers.filter("size_id is not null and max_tokens >= 1").select("size_id", "max_tokens"))
    over = packed.groupBy("size_id", "container").agg(F.sum("n_tokens").alias("n")).join(room, "size_id").groupBy("size_id", "max_tokens").agg(
        F.count_if(F.col("n") > F.col("max_tokens")).alias("overfull"), F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    placed = packed.groupBy("size_id", doc).agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("pieces"))
    each = capacities(sizes.select(doc, "n_tokens"), containers)
    fits = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("max_tokens")))
    per = each.join(placed, ["size_id", doc], "left").groupBy("size_id").agg(
        F.count("*").alias("items"), F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("incomplete"), F.count_if(~F.col("pieces").eqNullSafe(fits)).alias("cut_wrongly"))
    near = F.col("containers") <= F.ceil(F.col("tokens") / F.col("max_tokens")) * 1.01 + 3
    return per.join(over, "size_id").select("size_id", "items", "overfull", "incomplete", "cut_wrongly", near.alias("near_bound"))
