"""Percentiles with a multiplicative rank error at the upper tail, from sketches that can be merged.

A sketch is a chain of relative-rank compactors. Level h holds values that stand for 2**h inputs each. A full level is
sorted, its upper half is protected, and of a lower part, whose length follows a schedule by the number of earlier
compactions, every other value goes up a level. Whether the odd or the even ones go follows from a digest of the values, so
that the errors of different compactions don't add up. The largest values are never compacted, and the error of a
rank is bounded by a share of the number of values *above* it, so that 99.9 % is as good as 90 %. Sketches of
partitions and days are merged level by level.

A task puts its rows together by group and makes a sketch of the sorted values of each; sketches are stored, and merged in
rounds of at most ``FAN`` per group and task. The result depends on which rows a task gets, hence on the number of shuffle
partitions, but neither on the order in which they come to it (but for groups with over ``HELD`` values in a task) nor on that of merges.

Defined cases: null and negative values are left out; a group without values gives no row; a null group is a group;
rows with one result id count once, each column with its greatest value; rows without an id count each. Percentile p is
the value of rank ceil(p * n) as the sketch knows it. A group of at most K * 6 values is exact.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.sources.shared import cut

#: Length of a section: a greater one lowers the error. The documented bound on the relative rank error follows from it.
K = 32
SECTIONS = 3
#: Sketches of a group that one task merges; values of a group that a task sorts at once; texts that are coded as numbers.
FAN, HELD, CODED = 256, 4_000_000, 64
PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
METRICS = ("read_latency_ns", "write_latency_ns", "value_size")


def error_bound(k: int = K) -> float:
    """Share of the values above a percentile by which its rank may be off.

    The standard deviation of relative-rank compactors is 0.13 / k; this is five of them. The tests measure it over 10,000
    parts and orders that are made to hurt.
    """
    return 0.65 / k


def _coin(items: np.ndarray, level: int, done: int) -> int:
    """0 or 1 by a digest of the values."""
    z = (int(items.sum()) * 0x9E3779B97F4A7C15 + int(items[-1]) * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9 + done) & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return z >> 63


class Level:
    __slots__ = ("items", "sections", "size", "done")

    def __init__(self, k: int) -> None:
        self.items, self.sections, self.size, self.done = np.empty(0, dtype=np.int64), SECTIONS, float(k), 0

    def room(self) -> int:
        return 2 * self.sections * max(4, 2 * round(self.size / 2))


class Sketch:
    """Relative-rank compactors that protect the greatest values."""

    def __init__(self, k: int = K) -> None:
        self.k, self.n, self.levels = k, 0, [Level(k)]

    def add(self, values: np.ndarray) -> "Sketch":
        self.n += len(values)
        for at in range(0, len(values), 4096):
            self.levels[0].items = np.concatenate([self.levels[0].items, values[at : at + 4096].astype(np.int64)])
            self._settle()
        return self

    def merge(self, other: "Sketch") -> "Sketch":
        while len(self.levels) < len(other.levels):
            self.levels.append(Level(self.k))
        for a, b in zip(self.levels, other.levels):
            a.items = np.concatenate([a.items, b.items])
            if b.sections > a.sections:
                a.sections, a.size = b.sections, b.size
            a.done |= b.done
        self.n += other.n
        self._settle()
        return self

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h].items) >= self.levels[h].room():
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        lv = self.levels[h]
        room, step = lv.room(), max(4, 2 * round(lv.size / 2))
        items = np.sort(lv.items)
        # As many sections as the number of compactions so far ends in ones, plus one; the upper half always stays.
        ones = (lv.done ^ (lv.done + 1)).bit_length() - 1
        keep = room // 2 + (lv.sections - min(ones + 1, lv.sections)) * step
        low = len(items) - keep
        low -= low % 2
        up = items[_coin(items[:low], h, lv.done) : low : 2]
        lv.items = items[low:]
        lv.done += 1
        if lv.done >= 1 << (lv.sections - 1) and lv.size > 8:
            lv.sections, lv.size = lv.sections * 2, lv.size / math.sqrt(2)
        if h + 1 == len(self.levels):
            self.levels.append(Level(self.k))
        self.levels[h + 1].items = np.concatenate([self.levels[h + 1].items, up])

    def quantiles(self, probs: list[float]) -> list[int]:
        v = np.concatenate([lv.items for lv in self.levels])
        w = np.concatenate([np.full(len(lv.items), 1 << h, dtype=np.int64) for h, lv in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        v, cum = v[order], np.cumsum(w[order])
        # counted from above, where weights are least
        above = cum[-1] - cum
        return [int(v[min(len(v) - 1, int(np.searchsorted(-above, -(self.n - max(1, math.ceil(p * self.n - 1e-9))), side="left")))]) for p in probs]

    def dump(self) -> bytes:
        out = [struct.pack("<iqi", self.k, self.n, len(self.levels))]
        for lv in self.levels:
            out += [struct.pack("<idqi", lv.sections, lv.size, lv.done, len(lv.items)), lv.items.astype("<i8").tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, raw: bytes) -> "Sketch":
        k, n, levels = struct.unpack_from("<iqi", raw)
        out, at = cls(k), struct.calcsize("<iqi")
        out.n, out.levels = n, []
        for _ in range(levels):
            lv = Level(k)
            lv.sections, lv.size, lv.done, m = struct.unpack_from("<idqi", raw, at)
            at += struct.calcsize("<idqi")
            lv.items = np.frombuffer(raw, dtype="<i8", count=m, offset=at).astype(np.int64)
            at += 8 * m
            out.levels.append(lv)
        return out


def once(df: DataFrame, ident: str, groups: list[str], metrics: list[str]) -> DataFrame:
    """One row per id, each column with its greatest value; rows without an id stay.

    A hash aggregate takes numbers only. Texts of at most ``CODED`` values, counted before, hence go by their place among the sorted values;
    with more of them a sorting aggregate does the same.
    """
    keyed, cols, back = df.filter(F.col(ident).isNotNull()), {c: F.col(c) for c in [*groups, *metrics]}, {}
    for c in groups:
        if df.schema[c].dataType.simpleString() == "string":
            values = sorted(r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(CODED + 1).collect())
            if 0 < len(values) <= CODED:
                known = F.array(*map(F.lit, values))
                cols[c], back[c] = F.array_position(known, F.col(c)), known
    named = keyed.groupBy(ident).agg(*(F.max(e).alias(c) for c, e in cols.items()))
    named = named.select(*((F.get(back[c], (F.col(c) - 1).cast("int")) if c in back else F.col(c)).alias(c) for c in cols))
    return named.unionByName(df.filter(F.col(ident).isNull()).select(*cols))


def long_form(df: DataFrame, groups: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(groups..., metric, value) with the values that count."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("value")) for m in metrics))
    return df.select(*groups, F.inline(each)).filter("value >= 0")


def _runs(b: pa.RecordBatch, groups: list[str]) -> np.ndarray:
    """Where in a batch, sorted by the groups, runs of equal groups begin."""
    if not b.num_rows:
        return np.array([], dtype=np.int64)
    new = np.zeros(b.num_rows, dtype=bool)
    new[0] = True
    for g in groups:
        c = b.column(g).dictionary_encode()
        code = c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _per_group(batches: Iterator[pa.RecordBatch], groups: list[str], take) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by the groups one sketch per group; ``take(sketch, batch, start, end)`` adds rows to a sketch, or makes one of None."""
    key, held, kinds = None, None, None
    done: list[tuple[tuple, bytes]] = []

    def put() -> pa.RecordBatch:
        cols = [pa.array([k[i] for k, _ in done], kinds[i]) for i in range(len(groups))]
        out = pa.RecordBatch.from_arrays([*cols, pa.array([x for _, x in done], pa.binary())], names=[*groups, "sketch"])
        done.clear()
        return out

    for b in batches:
        starts = _runs(b, groups)
        kinds = [b.schema.field(g).type for g in groups]
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            here = tuple(b.column(g)[a].as_py() for g in groups)
            if held is not None and here != key:
                done.append((key, held.dump()))
                held = None
            key, held = here, take(held, b, a, z)
        if len(done) > 4096:
            yield put()
    if held is not None:
        done.append((key, held.dump()))
    if done:
        yield put()


def _schema(df: DataFrame, groups: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*groups).schema.fields)


def sketches(rows: DataFrame, groups: list[str], metrics: tuple[str, ...] = METRICS, k: int = K) -> DataFrame:
    """(groups..., metric, sketch), stored: one per group, metric and task, then merged by ``merge_sketches``.

    A task puts the rows of a group together by a digest of the group and sorts the values of each itself, ``HELD`` at a time.
    """
    kinds = _schema(rows, groups)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {m: [] for m in metrics}
        made: dict[str, Sketch] = {}
        key, types, done = None, None, []

        def settle(m: str) -> None:
            values = np.concatenate(held[m])
            values.sort()
            made.setdefault(m, Sketch(k)).add(values)
            held[m].clear()

        def close() -> None:
            for m in metrics:
                if held[m]:
                    settle(m)
            done.extend((*key, m, s.dump()) for m, s in made.items())
            made.clear()

        def put() -> pa.RecordBatch:
            cols = list(zip(*done))
            arrays = [*(pa.array(c, t) for c, t in zip(cols, types)), pa.array(cols[-2], pa.string()), pa.array(cols[-1], pa.binary())]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*groups, "metric", "sketch"])

        for b in batches:
            starts = _runs(b, groups)
            types = [b.schema.field(g).type for g in groups]
            values = {m: b.column(m).fill_null(-1).to_numpy() for m in metrics}
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                here = tuple(b.column(g)[a].as_py() for g in groups)
                if here != key:
                    if key is not None:
                        close()
                    key = here
                for m in metrics:
                    v = values[m][a:z]
                    v = v[v >= 0]
                    if len(v):
                        held[m].append(v)
                        if sum(map(len, held[m])) >= HELD:
                            settle(m)
            if len(done) > 4096:
                yield put()
        if key is not None:
            close()
        if done:
            yield put()

    near = rows.select(*groups, *(F.col(m).cast("long").alias(m) for m in metrics)).withColumn("_near", F.xxhash64(*groups))
    made = near.sortWithinPartitions("_near").drop("_near").mapInArrow(build, f"{kinds}, metric string, sketch binary")
    return merge_sketches(cut(made, "task-sketches"), [*groups, "metric"])


def merge_sketches(made: DataFrame, groups: list[str], most: int | None = None) -> DataFrame:
    """Merges the stored sketches of equal groups, ``most`` of a group at the most, in one order whatever the order of arrival.

    Rounds in which a task takes at most ``FAN`` sketches of a group, hence as many as the most frequent group needs.
    """
    schema = _schema(made, groups)
    if most is None:
        most = made.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0

    def merge(by: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def take(s: Sketch | None, b: pa.RecordBatch, a: int, z: int) -> Sketch:
                for raw in b.column("sketch").slice(a, z - a).to_pylist():
                    s = s.merge(Sketch.load(raw)) if s else Sketch.load(raw)
                return s

            for out in _per_group(batches, by, take):
                yield out.select([*groups, "sketch"])

        return run

    while most > FAN:
        most = -(-most // FAN)
        part = made.withColumn("_part", F.pmod(F.xxhash64("sketch"), F.lit(most)))
        made = part.repartition(*groups, "_part").sortWithinPartitions(*groups, "_part", "sketch").mapInArrow(merge([*groups, "_part"]), f"{schema}, sketch binary")
    return made.repartition(*groups).sortWithinPartitions(*groups, "sketch").mapInArrow(merge(groups), f"{schema}, sketch binary")


def read_sketches(made: DataFrame, groups: list[str], probs: dict[str, float] = PROBS) -> DataFrame:
    """(groups..., n, one column per percentile)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[s.n, *s.quantiles(list(probs.values()))] for s in map(Sketch.load, b.column("sketch").to_pylist())]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * (1 + len(probs))
            yield pa.RecordBatch.from_arrays([*(b.column(g) for g in groups), *cols], names=[*groups, "n", *probs])

    return made.select(*groups, "sketch").mapInArrow(read, f"{_schema(made, groups)}, n long, " + ", ".join(f"{p} long" for p in probs))


def daily(df: DataFrame) -> DataFrame:
    """Stored sketches per workload, day and metric of a table of results."""
    groups = ["workload", "run_day"]
    return cut(sketches(once(df, "result_id", groups, list(METRICS)), groups), "sketches")


def over_days(days: DataFrame) -> DataFrame:
    """The sketches of all days of each workload and metric, joined from the stored ones of the days."""
    return merge_sketches(days.select("workload", "metric", "sketch"), ["workload", "metric"])


def percentiles(df: DataFrame) -> DataFrame:
    """(workload, run_day, metric, n, p50, p90, p99, p999); run_day is null in the rows over all days."""
    days = daily(df)
    per_day = read_sketches(days, ["workload", "run_day", "metric"]).withColumn("scope", F.lit("day"))
    overall = read_sketches(over_days(days), ["workload", "metric"]).withColumns({"scope": F.lit("all"), "run_day": F.lit(None).cast("date")})
    return per_day.unionByName(overall)


def audit(df: DataFrame, found: DataFrame, probs: dict[str, float] = PROBS, k: int = K) -> DataFrame:
    """(scope, workload, run_day, metric, n, within): whether every percentile's true rank lies within ``error_bound``."""
    rows = long_form(once(df, "result_id", ["workload", "run_day"], list(METRICS)), ["workload", "run_day"])
    day = rows.withColumn("scope", F.lit("day"))
    overall = rows.withColumns({"scope": F.lit("all"), "run_day": F.lit(None).cast("date")})
    keys = ["scope", "workload", "run_day", "metric"]
    counted = day.unionByName(overall).groupBy(*keys, "value").agg(F.count("*").alias("w"))
    tag = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in keys))
    ask = found.withColumn("tag", tag).select("tag", F.col("n").alias("told"), *probs)
    joined = counted.withColumn("tag", tag).join(ask, "tag")
    sums = [F.sum("w").alias("n"), F.max("told").alias("told")]
    for p in probs:
        sums += [F.sum(F.when(F.col("value") < F.col(p), F.col("w")).otherwise(0)).alias(f"{p}_lo"), F.sum(F.when(F.col("value") <= F.col(p), F.col("w")).otherwise(0)).alias(f"{p}_hi")]
    out = joined.groupBy(*keys).agg(*sums)
    good = F.col("n") == F.col("told")
    for p, q in probs.items():
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q) - F.lit(1e-9)))
        slack = F.lit(error_bound(k)) * (F.col("n") - rank) + 1
        good = good & (F.col(f"{p}_lo") + 1 <= rank + slack) & (F.col(f"{p}_hi") >= rank - slack)
    return out.select(*keys, "n", good.alias("within"))
