"""Has this key been seen before? Golomb-coded sets, with exact checks of what they let through.

Keys are spread over shards of about ``SHARD`` keys by one hash. Of the keys of a shard another hash is reduced to the range
n * 2**RICE; the sorted hashes are stored as gaps, Golomb-coded with parameter 2**RICE, in blocks of ``BLOCK`` with a
directory of first hashes and bit places. A set takes about RICE + 1.5 bits a key and answers wrongly "seen" for about one
in 2**RICE new keys; it never wrongly answers "new". A probe decodes only the blocks that its hashes fall into.

Sets are stored, with the keys they were made of, in folders of neighbouring shards ('homes'). A task that is asked about keys
of a home reads its sets, and the keys of a shard only if a set lets something through, so that the stored keys are never
shuffled after their set was made. A store may be opened again and asked about the records of the next day.

Records come in waves of receipt. Stored segments come first, then what each earlier wave added; a wave probes all of
them. Only what they let through is looked up exactly, which also audits the rate of wrong answers. Inside a wave a key
counts as seen from its second record on.

Defined cases: a record with a null key has no answer; repeated store rows are one key; hot keys are combined before
the shuffle and meet their answer by broadcast; records without receipt number are left out; an empty store or empty
records give an empty set or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.keys import pad_key
from strandlog.operators.hot import join_on_keys
from strandlog.sources.shared import cut, list_names, new_path
from strandlog.sources.vlog import filesystem

#: Keys of a shard on average, hashes of a block, bits of the rest of a gap, waves of a whole table, shards of a home.
SHARD, BLOCK, RICE, WAVES, HOME = 40_000, 128, 10, 3, 16


class GolombSet:
    """A sorted set of hashes as Golomb-coded gaps: per block the quotients in unary, then the rests in RICE bits."""

    @staticmethod
    def reduce(h: np.ndarray, n: int) -> np.ndarray:
        """32-bit hashes to the range n * 2**RICE."""
        return (h.astype(np.uint64) * np.uint64(n << RICE)) >> np.uint64(32)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(first hash of each block, byte place of each block, code) of sorted distinct values."""
        firsts, places, out, at = [], [], [], 0
        for i in range(0, len(values), BLOCK):
            v = values[i : i + BLOCK].astype(np.int64)
            gap = np.diff(v) - 1
            q, r = gap >> RICE, gap & ((1 << RICE) - 1)
            unary = np.zeros(int(q.sum()) + len(q), dtype=np.uint8)
            unary[np.cumsum(q + 1) - 1] = 1
            rest = ((r[:, None] >> np.arange(RICE - 1, -1, -1)) & 1).astype(np.uint8).ravel()
            code = np.uint16(len(v)).tobytes() + np.packbits(np.concatenate([rest, unary])).tobytes()
            firsts.append(int(v[0]))
            places.append(at)
            out.append(code)
            at += len(code)
        return np.array(firsts, dtype=np.int64), np.array([*places, at], dtype=np.int64), b"".join(out)

    @staticmethod
    def decode(first: int, code: bytes) -> np.ndarray:
        """The values of one block."""
        n = int(np.frombuffer(code, dtype=np.uint16, count=1)[0]) - 1
        bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8, offset=2))
        rest = bits[: n * RICE].reshape(n, RICE).astype(np.int64) @ (1 << np.arange(RICE - 1, -1, -1, dtype=np.int64))
        stops = np.flatnonzero(bits[n * RICE :])[:n]
        q = np.diff(stops, prepend=-1) - 1
        return first + np.concatenate([[0], np.cumsum((q << RICE) + rest + 1)]).astype(np.int64)

    @classmethod
    def probe(cls, values: np.ndarray, firsts: np.ndarray, places: np.ndarray, code: bytes) -> np.ndarray:
        """Whether each value is in the set; blocks without a probe stay coded."""
        hit = np.zeros(len(values), dtype=bool)
        if not len(firsts):
            return hit
        block = np.searchsorted(firsts, values, side="right") - 1
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-2))
        for a, z in zip(edges, [*edges[1:], len(order)]):
            k = int(block[order[a]])
            if k >= 0:
                at = order[a:z]
                hit[at] = np.isin(values[at], cls.decode(int(firsts[k]), code[int(places[k]) : int(places[k + 1])]))
        return hit


#: What a task puts out: answers to keys, counts for the audit, and the sets of new keys.
FIELDS = {
    "what": pa.string(), "home": pa.int32(), "shard": pa.int32(), "segment": pa.int32(), "wave": pa.int32(), "key": pa.string(), "first": pa.int64(), "n": pa.int64(), "seen": pa.bool_(),
    "probes": pa.int64(), "passed": pa.int64(), "wrong": pa.int64(), "firsts": pa.list_(pa.int64()), "places": pa.list_(pa.int64()), "code": pa.binary(), "keys": pa.list_(pa.string()),
}
OUT = ("what string, home int, shard int, segment int, wave int, key string, first long, n long, seen boolean, probes long, passed long, wrong long, "
       "firsts array<long>, places array<long>, code binary, keys array<string>")


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    fill = lambda v, t: v if isinstance(v, pa.Array) else pa.repeat(pa.scalar(v, t), size) if v is not None else pa.nulls(size, t)
    return pa.RecordBatch.from_arrays([fill(columns.get(c), t) for c, t in FIELDS.items()], names=list(FIELDS))


class Segment:
    """The set of one shard and segment, and a way to its keys."""

    def __init__(self, number: int, n: int, firsts: np.ndarray, places: np.ndarray, code: bytes, keys) -> None:
        self.number, self.n, self.firsts, self.places, self.code, self.keys = number, n, firsts, places, code, keys

    @classmethod
    def of(cls, number: int, h: np.ndarray, keys: pa.Array) -> "Segment":
        return cls(number, len(h), *GolombSet.encode(np.unique(GolombSet.reduce(h, len(h)))), lambda: keys)

    def ask(self, h: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, int]:
        """Whether each key is in the segment, and how many the set let through."""
        hit = np.flatnonzero(GolombSet.probe(GolombSet.reduce(h, self.n).astype(np.int64), self.firsts, self.places, self.code))
        out = np.zeros(len(h), dtype=bool)
        if len(hit):
            out[hit] = pc.is_in(keys.take(pa.array(hit)), value_set=self.keys()).to_numpy(zero_copy_only=False)
        return out, len(hit)


def stored_segments(folders: list[str], home: int) -> dict[int, list[Segment]]:
    """Of a home the stored sets by shard."""
    out: dict[int, list[Segment]] = {}
    for folder in folders:
        where, name = filesystem(f"{folder}/what=set/home={home}")
        files = [x.path for x in where.get_file_info(_selector(name)) if x.is_file and x.base_name[0] not in "_."]
        for path in files:
            held: dict[tuple[int, int], pa.Array] = {}

            def keys(shard: int, segment: int, path=path, where=where, held=held) -> pa.Array:
                if not held:
                    t = pq.read_table(path, columns=["shard", "segment", "keys"], filesystem=where, partitioning=None)
                    lists = t["keys"].combine_chunks()
                    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                    held.update({(s, g): lists[i].values for i, (s, g) in enumerate(zip(t["shard"].to_pylist(), t["segment"].to_pylist()))})
                return held[shard, segment]

            for r in pq.read_table(path, columns=["shard", "segment", "n", "firsts", "places", "code"], filesystem=where, partitioning=None).to_pylist():
                s, g = r["shard"], r["segment"]
                out.setdefault(s, []).append(Segment(g, r["n"], np.array(r["firsts"], dtype=np.int64), np.array(r["places"], dtype=np.int64), r["code"], lambda s=s, g=g, keys=keys: keys(s, g)))
    return out


def _selector(name: str):
    from pyarrow import fs

    return fs.FileSelector(name, allow_not_found=True)


class SeenStore:
    """Stored sets below ``path``: shards=N/take=A-B/what=set/home=H/, of segments A to B."""

    def __init__(self, spark: SparkSession, path: str, rows: int = 0) -> None:
        """Opens a store; a new one gets as many shards as about ``rows`` keys need."""
        self.spark = spark
        made = [x for x in list_names(spark, path) if x.startswith("shards=")]
        self.shards = int(made[0][7:]) if made else max(1, -(-rows // SHARD))
        self.root = f"{path}/shards={self.shards}"

    def takes(self) -> list[tuple[int, int]]:
        """First and last segment of each take that was written to its end."""
        names = [x for x in list_names(self.spark, self.root) if x.startswith("take=") and "_SUCCESS" in list_names(self.spark, f"{self.root}/{x}")]
        return sorted(tuple(map(int, x[5:].split("-"))) for x in names)

    def take(self, keys: DataFrame, waves: int) -> DataFrame:
        """Asks about distinct (wave, key) with first and n, wave below ``waves``, and adds the new ones. The answers and the counts for the audit, as ``OUT``."""
        takes = self.takes()
        base = takes[-1][1] + 1 if takes else 0
        folders = [f"{self.root}/take={a}-{b}" for a, b in takes]
        per_home = max(1, min(HOME, self.shards // 64))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, stored = None, {}
            for shard, table in _by_shard(batches):
                if shard // per_home != home:
                    home = shard // per_home
                    stored = stored_segments(folders, home)
                segments = stored.get(shard, [])
                h, wave, key = table.column("h").to_numpy(), table.column("wave").to_numpy(), table.column("key")
                for w in np.unique(wave).tolist():
                    at = np.flatnonzero(wave == w)
                    take = pa.array(at)
                    hw, kw = h[at], key.take(take)
                    seen = np.zeros(len(at), dtype=bool)
                    for g in segments:
                        there, passed = g.ask(hw, kw)
                        seen |= there
                        yield _rows(1, what="stat", home=0, shard=shard, segment=g.number, probes=len(at), passed=passed, wrong=passed - int(there.sum()))
                    yield _rows(len(at), what="answer", home=0, wave=w, key=kw, first=table.column("first").take(take), n=table.column("n").take(take), seen=pa.array(seen))
                    new = np.flatnonzero(~seen)
                    if len(new):
                        g = Segment.of(base + w, hw[new], kw.take(pa.array(new)))
                        segments.append(g)
                        yield _rows(1, what="set", home=home, shard=shard, segment=g.number, n=g.n, firsts=pa.array([g.firsts], pa.list_(pa.int64())), places=pa.array([g.places], pa.list_(pa.int64())),
                                    code=g.code, keys=pa.ListArray.from_arrays(pa.array([0, g.n], pa.int32()), g.keys()))

        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        placed = keys.select("wave", "key", "first", "n", shard.alias("shard"), F.xxhash64("key", F.lit("within")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
        near = placed.repartition(F.floor(F.col("shard") / per_home)).sortWithinPartitions("shard")
        target = f"{self.root}/take={base}-{base + waves - 1}"
        near.mapInArrow(ask, OUT).write.mode("overwrite").partitionBy("what", "home").parquet(target)
        return self.spark.read.schema(OUT).parquet(target)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by shard, a shard at a time."""
    held: list[pa.RecordBatch] = []
    at = None

    def whole() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column("shard").to_numpy()
        edges = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(shard)]):
            if at is not None and shard[a] != at:
                yield at, _flat(whole())
                held.clear()
            at = int(shard[a])
            held.append(b.slice(a, z - a))
    if held:
        yield at, _flat(whole())


def _flat(t: pa.Table) -> pa.RecordBatch:
    return t.to_batches()[0]


class Judged:
    """``records``: recv, wave, key; ``keys``: per wave and key first, n and seen; ``stats``: probes, passed and wrong per shard, segment and wave."""

    def __init__(self, records: DataFrame, keys: DataFrame, stats: DataFrame, store: SeenStore, total: int) -> None:
        self.records, self.keys, self.stats, self.store, self.total = records, keys, stats, store, total


def remember(store: DataFrame, rows: int, key: str = "key", path: str | None = None) -> SeenStore:
    """A store with the sets of a table's keys, with room for about ``rows`` keys."""
    made = SeenStore(store.sparkSession, path or new_path(store.sparkSession, "seen"), rows)
    known = store.select(pad_key(key).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    made.take(known.select(F.lit(0).alias("wave"), "key", F.lit(0).cast("long").alias("first"), "n"), 1)
    return made


def ask(records: DataFrame, store: DataFrame | SeenStore, recv: str = "recv_id", key: str = "key", waves: int = WAVES) -> Judged:
    """Takes records in waves of receipt and adds their keys to the store; a table is made a store first."""
    rows = records.select(F.col(recv).cast("long").alias("recv"), pad_key(key).alias("key")).filter("recv is not null and key is not null")
    lo, hi, total = rows.agg(F.min("recv"), F.max("recv"), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    if not isinstance(store, SeenStore):
        store = remember(store, store.count() + total, key)
    step = max(1, -(-(hi - lo + 1) // waves))
    rows = rows.withColumn("wave", F.expr(f"cast((recv - {lo}) div {step} as int)"))
    out = store.take(rows.groupBy("wave", "key").agg(F.min("recv").alias("first"), F.count("*").alias("n")), waves)
    return Judged(rows, out.filter("what = 'answer'").select("wave", "key", "first", "n", "seen"), out.filter("what = 'stat'"), store, total)


def seen_before(records: DataFrame, store: DataFrame | SeenStore, recv: str = "recv_id", key: str = "key", waves: int = WAVES, parts: int | None = None) -> DataFrame:
    """The receipt number of each record whose key is in the store (a table, or an opened store) or in a record received before."""
    j = ask(records, store, recv, key, waves)
    more = j.keys.filter("seen or n > 1")
    found = join_on_keys(j.records, more, ["wave", "key"], "n", j.total, F.col("seen") | (F.col("recv") > F.col("first")), parts)
    return found.select(F.col("recv").alias(recv))


def rates(records: DataFrame, store: DataFrame, recv: str = "recv_id", key: str = "key", waves: int = WAVES) -> DataFrame:
    """Per segment: keys, probes, passed, wrong (passed but not in it), theory (rate of wrong answers expected) and audited."""
    j = ask(records, store, recv, key, waves)
    sets = cut(j.store.spark.read.schema(OUT.replace("what string, ", "") + ", take string, what string").parquet(j.store.root).filter("what = 'set'").select("segment", "n"), "set-sizes")
    sizes = sets.groupBy("segment").agg(F.sum("n").alias("keys"))
    got = j.stats.groupBy("segment").agg(*(F.sum(c).alias(c) for c in ("probes", "passed", "wrong")))
    fresh = F.col("probes") - F.col("passed") + F.col("wrong")
    return sizes.join(got, "segment").select("segment", "keys", "probes", "passed", "wrong", F.lit(2.0**-RICE).alias("theory"), F.when(fresh > 0, F.col("wrong") / fresh).alias("audited"))
