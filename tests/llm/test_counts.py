"""Frequent values, percentiles and seen keys against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.llm import frequent, quantiles, seen


def pad(k):
    return k[:10].rjust(10, "0")


def test_frequent_values_are_exact(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([None, "hot", "hot", "hot", "b", "b", str(r.randrange(500)), ""]),) for _ in range(4000)]
    df = spark.createDataFrame(rows, "value string").repartition(5)
    want = Counter(x for (x,) in rows if x is not None)
    monkeypatch.setattr(frequent, "RUN", 300)
    assert {(x.value, x.n) for x in frequent.at_least(df, F.col("value"), 0.05).collect()} == {(k, n) for k, n in want.items() if n >= 0.05 * sum(want.values())}
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert [(x.value, x.n) for x in frequent.top(df, F.col("value"), 7).collect()] == best


def test_heap_is_bounded_and_keeps_ties_by_value():
    import pyarrow as pa

    values = [f"{i:04d}" for i in range(500)]
    batches = [pa.RecordBatch.from_pydict({"value": values[i : i + 50], "n": [1] * 50}) for i in range(0, 500, 50)]
    out = list(frequent.merged_heap(10)(iter(batches)))[0]
    assert sorted(out.column(0).to_pylist()) == values[:10]
    split = [pa.RecordBatch.from_pydict({"value": ["a", "b"], "n": [1, 2]}), pa.RecordBatch.from_pydict({"value": ["b", "b", "c"], "n": [3, 1, 1]}), pa.RecordBatch.from_pydict({"value": ["c"], "n": [9]})]
    out = list(frequent.merged_heap(2)(iter(split)))[0]
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {"c": 10, "b": 6}


def test_frequent_empty_and_small_heap(spark):
    df = spark.createDataFrame([(None,)], "value string")
    assert frequent.at_least(df, F.col("value"), 0.5).collect() == [] and frequent.top(df.limit(0), F.col("value"), 3).collect() == []
    with pytest.raises(ValueError):
        frequent.at_least(df, F.col("value"), 0.0001)


def shapes(n):
    g = np.random.default_rng(1)
    return {"normal": g.normal(1e6, 1e5, n), "heavy": g.pareto(1.1, n) * 1e4, "ties": g.integers(0, 5, n), "sorted": np.arange(n), "falling": np.arange(n)[::-1], "same": np.full(n, 7)}


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "sorted", "falling", "same"])
@pytest.mark.parametrize("parts", [1, 40])
def test_rank_error_is_relative_to_the_tail(kind, parts):
    values = np.abs(shapes(60_000)[kind]).astype(np.int64)
    merged = quantiles.Sketch()
    for part in np.array_split(values, parts):
        merged.merge(quantiles.Sketch.load(quantiles.Sketch().add(part).dump()))
    assert merged.n == len(values)
    assert sum(len(lv.items) << h for h, lv in enumerate(merged.levels)) == len(values)
    assert sum(len(lv.items) for lv in merged.levels) < 6000
    ordered = np.sort(values)
    for p in (0.5, 0.9, 0.99, 0.999, 1.0):
        got = merged.quantiles([p])[0]
        lo, hi, rank = np.searchsorted(ordered, got, "left"), np.searchsorted(ordered, got, "right"), max(1, math.ceil(p * len(values)))
        slack = quantiles.error_bound() * (len(values) - rank) + 1
        assert lo + 1 <= rank + slack and hi >= rank - slack, (kind, p, lo, hi, rank)


@pytest.mark.parametrize("kind", ["lognormal", "interleaved", "blocks", "falling", "sawtooth"])
@pytest.mark.parametrize("tree", [False, True])
def test_rank_error_over_ten_thousand_parts(kind, tree):
    n = 1_000_000
    g = np.random.default_rng(5)
    values = {"lognormal": lambda: g.lognormal(10, 2, n), "interleaved": lambda: np.arange(n).reshape(-1, 200).T.ravel(), "blocks": lambda: np.arange(n), "falling": lambda: np.arange(n)[::-1], "sawtooth": lambda: np.arange(n) % 977}[kind]().astype(np.int64)
    s = [quantiles.Sketch().add(np.sort(p)) for p in np.array_split(values, 10_000)]
    if tree:
        while len(s) > 1:
            s = [s[i].merge(s[i + 1]) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
    else:
        for x in s[1:]:
            s[0].merge(x)
    ordered = np.sort(values)
    for p, got in zip((0.5, 0.9, 0.99, 0.999), s[0].quantiles([0.5, 0.9, 0.99, 0.999])):
        rank = math.ceil(p * n)
        slack = quantiles.error_bound() * (n - rank) + 1
        assert np.searchsorted(ordered, got, "left") + 1 <= rank + slack and np.searchsorted(ordered, got, "right") >= rank - slack, (p, got)


def test_sketches_do_not_depend_on_the_order_of_rows_or_merges(spark, monkeypatch):
    rows = spark.range(30_000).select(F.pmod("id", F.lit(3)).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("value")).repartition(7, "value")
    of = lambda df: quantiles.sketches(df, ["g"], ("value",))
    whole = {r.g: bytes(r.sketch) for r in of(rows).collect()}
    turned = rows.sortWithinPartitions(F.rand(3))
    assert {r.g: bytes(r.sketch) for r in of(turned).collect()} == whole
    monkeypatch.setattr(quantiles, "FAN", 2)  # seven sketches of a group then take several rounds
    few = {r.g: r for r in quantiles.read_sketches(of(rows), ["g"]).collect()}
    assert {g: r.n for g, r in few.items()} == {0: 10_000, 1: 10_000, 2: 10_000}
    for r in few.values():
        assert abs(r.p90 - 9e8) < 2e7


def test_one_row_per_id_with_many_texts(spark, monkeypatch):
    rows = [(i % 40 if i % 7 else None, f"w{i % 9}" if i % 5 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "ident long, w string, v long")
    few = sorted(map(str, quantiles.once(df, "ident", ["w"], ["v"]).collect()))
    monkeypatch.setattr(quantiles, "CODED", 3)
    assert sorted(map(str, quantiles.once(df, "ident", ["w"], ["v"]).collect())) == few
    assert len(few) == 40 + sum(r[0] is None for r in rows)


def test_small_sketches_are_exact():
    v = np.random.default_rng(0).integers(0, 1000, 150)
    assert quantiles.Sketch().add(v).quantiles([0.5, 0.9, 1.0]) == [int(np.sort(v)[math.ceil(p * 150) - 1]) for p in (0.5, 0.9, 1.0)]


def test_percentiles_of_dirty_results(spark):
    kind = "result_id long, workload string, run_day date, read_latency_ns long, write_latency_ns long, value_size int, sketch string"
    import datetime as dt

    d = dt.date(2026, 3, 1)
    rows = [(1, "A", d, 5, None, -1, "x"), (1, "A", d, 5, None, -1, "x"), (2, "A", d, 9, None, 3, "x"), (None, "A", d, 7, None, None, "x"), (None, "A", d, 7, None, None, "x"), (3, None, None, None, 4, None, "x"), (4, "B", None, 8, None, None, "x"), (4, "C", d, 6, None, None, "x")]
    got = {(r.scope, r.workload, r.run_day, r.metric): (r.n, r.p50, r.p999) for r in quantiles.percentiles(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("day", "A", d, "read_latency_ns"): (4, 7, 9), ("all", "A", None, "read_latency_ns"): (4, 7, 9), ("day", "A", d, "value_size"): (1, 3, 3), ("all", "A", None, "value_size"): (1, 3, 3),
                   ("day", None, None, "write_latency_ns"): (1, 4, 4), ("all", None, None, "write_latency_ns"): (1, 4, 4),
                   ("day", "C", d, "read_latency_ns"): (1, 8, 8), ("all", "C", None, "read_latency_ns"): (1, 8, 8)}
    assert quantiles.percentiles(spark.createDataFrame([], kind)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
def test_golomb_sets_decode_exactly(n):
    g = np.random.default_rng(n)
    h = g.integers(0, 2**32, n).astype(np.int64)
    values = np.unique(seen.GolombSet.reduce(h, max(n, 1))).astype(np.int64)
    firsts, places, code = seen.GolombSet.encode(values)
    back = np.concatenate([seen.GolombSet.decode(int(f), code[places[i] : places[i + 1]]) for i, f in enumerate(firsts)]) if n else np.array([])
    assert np.array_equal(back, values)
    assert len(code) * 8 <= (seen.RICE + 3) * max(n, 1) + 32 * (len(firsts) + 1)
    other = g.integers(0, 2**32, 20_000).astype(np.int64)
    asked = seen.GolombSet.reduce(other, max(n, 1)).astype(np.int64)
    hit = seen.GolombSet.probe(asked, firsts, places, code)
    assert np.array_equal(hit, np.isin(asked, values))
    assert seen.GolombSet.probe(values, firsts, places, code).all()


def test_seen_before_matches_python(spark):
    for seed, waves in ((1, 1), (2, 4)):
        r = random.Random(seed)
        store = [(r.choice([None, "1", "001", str(r.randrange(200))]), 1) for _ in range(150)]
        rows = [(i if r.random() > 0.02 else None, r.choice([None, "hot", "hot", "", str(r.randrange(900)), "0" + str(r.randrange(900))]), 1) for i in range(900)]
        r.shuffle(rows)
        known, want = {pad(k) for k, _ in store if k is not None}, set()
        for i, k, _ in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[0]):
            if pad(k) in known:
                want.add(i)
            known.add(pad(k))
        records, held = spark.createDataFrame(rows, "recv_id long, key string, wave int"), spark.createDataFrame(store, "key string, shard int")
        assert {x.recv_id for x in seen.seen_before(records, held, waves=waves, parts=5).collect()} == want
        rates = {x.segment: x for x in seen.rates(records, held, waves=waves).collect()}
        assert rates[0].theory == 2.0**-seen.RICE and all(x.wrong <= x.passed <= x.probes for x in rates.values())


def test_a_store_is_opened_again(spark, monkeypatch):
    monkeypatch.setattr(seen, "SHARD", 20)
    r = random.Random(8)
    held = spark.createDataFrame([(str(r.randrange(300)),) for _ in range(200)], "key string")
    days = [[(1000 * day + i, str(r.randrange(900))) for i in range(400)] for day in range(3)]
    path = seen.new_path(spark, "seen-days")
    seen.remember(held, 2000, path=path)
    known = {pad(x.key) for x in held.collect()}
    for rows in days:
        want = set()
        for i, k in rows:
            if pad(k) in known:
                want.add(i)
            known.add(pad(k))
        got = seen.seen_before(spark.createDataFrame(rows, "recv_id long, key string"), seen.SeenStore(spark, path), waves=2)
        assert {x.recv_id for x in got.collect()} == want
    assert seen.SeenStore(spark, path).shards == 100 and seen.SeenStore(spark, path).takes() == [(0, 0), (1, 2), (3, 4), (5, 6)]


def test_seen_empty(spark):
    records, store = spark.createDataFrame([], "recv_id long, key string"), spark.createDataFrame([], "key string")
    assert seen.seen_before(records, store).collect() == []
    one = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "recv_id long, key string")
    assert [x.recv_id for x in seen.seen_before(one, store).collect()] == [2]


def test_audited_rate_is_near_theory(spark):
    store = spark.range(60_000).select(F.concat(F.lit("s"), "id").alias("key"))
    records = spark.range(60_000).select(F.col("id").alias("recv_id"), F.concat(F.lit("r"), "id").alias("key"))
    r = {x.segment: x for x in seen.rates(records, store, waves=1).collect()}[0]
    assert r.keys == r.probes == 60_000 and 0.3 * r.theory < r.audited < 2 * r.theory
