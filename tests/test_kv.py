"""The key-value semantics: invariants and edge cases."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlog.functions import scalars
from strandlog.functions.keys import pad_key, unpad_key
from strandlog.operators import compact, consensus, features, live, metrics, ordered, putlog, workload
from strandlog.plans import kv, work
from strandlog.sources import csvio, shared, vlog
from strandlog.sources.generations import Conflict, Generations

LOG = "key string, idx long, value string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,padded,unpadded", [("7", "0000000007", "7"), ("007", "0000000007", "7"), ("0", "0000000000", ""), ("12345678901", "1234567890", "1234567890"), ("", "0000000000", ""), (None, None, None)])
def test_keys(spark, raw, padded, unpadded):
    r = spark.createDataFrame([(raw,)], "k string").select(pad_key("k").alias("p"), unpad_key(pad_key("k")).alias("u")).first()
    assert (r.p, r.u) == (padded, unpadded)


def test_little_endian(spark):
    for n in (0, 1, 255, 2**40 + 3, 2**63 - 1, -1, -2):
        assert one(spark, scalars.to_little_endian(F.lit(n))) == struct.pack("<q", n).hex().upper()
        assert one(spark, scalars.from_little_endian(scalars.to_little_endian(F.lit(n)))) == n
    assert one(spark, scalars.from_little_endian(F.lit("00"))) is None


def test_clocks(spark):
    def dominated(a, b):
        kind = "struct<a: map<string, bigint>, b: map<string, bigint>>"
        r = spark.createDataFrame([((a, b),)], f"x {kind}").select(scalars.clock_dominated(F.col("x.a"), F.col("x.b")).alias("y"))
        return r.first().y

    assert dominated({"a": 1}, {}) and dominated({"a": 1}, None) and dominated({"a": 1}, {"a": 1, "b": 0}) and dominated({}, {"a": 1})
    assert not dominated({"a": 2}, {"a": 1}) and not dominated({"a": 1, "b": 1}, {"a": 5}) and not dominated({"a": 1}, {"b": 1})


def random_log(spark, seed, n):
    r = random.Random(seed)
    rows = [(pad(str(r.randrange(20))), i, "".join(r.choices("abé", k=r.randrange(9))) or None) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, LOG)


def pad(k):
    return k[:10].rjust(10, "0")


def test_latest_equals_dict(spark):
    for seed in range(3):
        rows, df = random_log(spark, seed, 200)
        want = {k: (i, v) for k, i, v in sorted(rows, key=lambda x: x[1])}
        assert {r.key: (r.idx, r.value) for r in live.latest(df, "value").collect()} == want


def test_offsets_are_contiguous_and_compaction_is_idempotent(spark):
    rows, df = random_log(spark, 9, 300)
    at = 0
    values = {i: v for _, i, v in rows}
    for r in compact.log_offsets(df).orderBy("idx").collect():
        assert r.offset == at
        at += r.size
        assert r.size == 30 + len((values[r.idx] or "").encode())
    once = compact.compact(df)
    twice = compact.compact(once.select("key", "idx", "value"))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert [r.key for r in once.orderBy("position").collect()] == sorted({k for k, _, _ in rows})
    assert compact.order_violations(once).first().violations == 0
    assert compact.index_mismatches(live.latest(df), once).first().mismatches == 0
    g = compact.garbage(df).first()
    assert g.total_bytes == at and g.reclaimable_bytes == at - sum(r.size for r in once.collect()) and g.live_records == once.count()
    records = compact.log_offsets(df)
    assert compact.liveness(records, compact.key_index(records)).filter("valid").count() == once.count()
    assert sorted((r.key, r.idx, r.value, r.offset) for r in compact.rewrite_live(df).collect()) == sorted((r.key, r.idx, r.value, r.offset) for r in once.collect())
    narrow = compact.compact(df, payload=False)
    assert sorted(map(tuple, narrow.select("key", "idx", "offset").collect())) == sorted(map(tuple, once.select("key", "idx", "offset").collect()))


def test_order_violations_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    df = spark.createDataFrame([(f"{k:03d}", i) for i, k in enumerate([1, 2, 3, 4, 4, 9, 8, 10])], "key string, position long")
    assert compact.order_violations(df).first().violations == 2


def test_empty_logs(spark):
    df = spark.createDataFrame([], LOG)
    assert compact.compact(df).collect() == [] and compact.log_offsets(df).collect() == []
    assert tuple(compact.garbage(df).first()) == (0, 0, 0, 0)
    assert compact.order_violations(compact.compact(df)).first().violations == 0


def test_get_scan_merge(spark):
    lv = spark.createDataFrame([(pad("1"), "a"), (pad("2"), ""), (pad("3"), None)], "key string, value string")
    keys = spark.createDataFrame([("1",), ("002",), ("9",)], "key string")
    assert sorted(map(tuple, live.get(lv, keys).collect())) == [("002", "OK", ""), ("1", "OK", "a"), ("9", "ErrNoKey", "NOKEY")]
    assert sorted(map(tuple, live.get(lv, keys, miss_value="ErrNoKey", empty_is_missing=True).collect())) == [("002", "ErrNoKey", "ErrNoKey"), ("1", "OK", "a"), ("9", "ErrNoKey", "ErrNoKey")]
    assert lv.filter(live.between("key", "2", "3")).count() == 2 and lv.filter(live.between("key", "3", "2")).count() == 0
    newer = spark.createDataFrame([(pad("1"), "new")], "key string, value string")
    assert sorted(map(tuple, live.merge(newer, lv).collect()))[0] == (pad("1"), "new", "new")
    assert live.merge(newer, lv).count() == 3


def test_number_filter_equals_the_padded_one_and_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(n,) for n in (-5, 0, 7, 41, 42, 43, 420, 4_200_000_000, 42_000_000_001, 10**12)], "n long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for a, b in (("42", "42"), ("7", "420"), ("4200000000", "4200000000"), ("50", "7"), ("x", "y"), ("0", "12345678901")):
        assert df.filter(live.number_between("n", a, b)).collect() == df.filter(live.between(F.lpad(F.col("n").cast("string"), 10, "0"), a, b)).collect()
    plan = df.filter(live.number_between("n", "42", "42"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,42)" in plan and "LessThanOrEqual(n,42)" in plan


def test_range_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(pad("1"), "a")], "key string, value string").write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").filter(live.between("key", "1", "2")).select("key")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,0000000001)" in plan and "ReadSchema: struct<key:string>" in plan


def test_consensus(spark):
    for values, want in (([3, 5, 7], 5), ([7, 3], 7), ([1], 1), ([4, 1, 3, 2], 3)):
        assert one(spark, consensus.quorum_index(F.array(*map(F.lit, values)))) == want
    kind = "grp int, idx int, term int"
    a, b = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2)], kind), spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3)], kind)
    assert tuple(consensus.first_conflict(a, b).first()) == (1, 3)
    assert sorted(map(tuple, consensus.received(a, b).collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]
    assert consensus.received(a, a.filter("idx < 3")).count() == 4
    assert one(spark, consensus.up_to_date(F.lit(2), F.lit(1), F.lit(1), F.lit(9))) and not one(spark, consensus.up_to_date(F.lit(1), F.lit(8), F.lit(1), F.lit(9)))
    assert one(spark, consensus.advance(F.lit(3), F.lit(5), F.lit(2), F.lit(2))) == 5 and one(spark, consensus.advance(F.lit(3), F.lit(5), F.lit(1), F.lit(2))) == 3
    assert one(spark, consensus.follower_commit(F.lit(9), F.lit(4))) == 4


def test_append_replies_and_backoff(spark):
    entry, ask = "grp int, idx long, term long", "grp int, prev_idx long, prev_term long, leader_commit long, own_commit long"
    follower = spark.createDataFrame([(g, i, t) for g in range(1, 6) for i, t in ((1, 1), (2, 1), (3, 2), (4, 2))], entry)
    leader = spark.createDataFrame([(g, i, t) for g in range(1, 6) for i, t in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 3))], entry)
    # after the third entry; after nothing; beyond the end; where the terms differ; no entries after the end
    asked = spark.createDataFrame([(1, 3, 2, 9, 0), (2, 0, 0, 2, 1), (3, 7, 3, 9, 1), (4, 4, 3, 9, 1), (5, 2, 1, 1, 2), (6, 1, 1, 3, 0)], ask)
    got = {r.grp: (r.success, r.conflict_term, r.conflict_idx, r.last_idx, r.commit_idx) for r in consensus.append_replies(follower, leader, asked).collect()}
    assert got == {1: (True, -1, None, 5, 5), 2: (True, -1, None, 5, 2), 3: (False, -1, 5, 4, 1), 4: (False, 2, 3, 4, 1), 5: (True, -1, None, 5, 2), 6: (False, -1, 1, 0, 0)}
    refused = spark.createDataFrame([(1, 4, 3, 1), (2, 3, 2, 1), (3, 7, -1, 5), (4, 2, 1, 1), (5, 4, 2, 3)], "grp int, prev_idx long, conflict_term long, conflict_idx long")
    # behind the last entry of another term at or before prev_idx; none: what the follower named
    assert {r.grp: r.next_idx for r in consensus.backoff(leader, refused).collect()} == {1: 4, 2: 3, 3: 5, 4: 1, 5: 5}


def test_one_vote_a_term(spark):
    requests = [(1, 1, 2, "a", 1, 5), (1, 2, 2, "b", 9, 9), (1, 3, 2, "a", 1, 5), (1, 4, 3, "b", 0, 9), (1, 5, 3, "c", 1, 5), (1, 6, 2, "a", 9, 9), (1, 7, 3, "b", 9, 9), (2, 1, 4, "x", 1, 5), (2, 2, 4, "y", 1, 5), (2, 3, 3, "y", 1, 5), (2, 4, 5, "x", 1, 5)]
    r = spark.createDataFrame(requests, "voter int, seq int, term int, candidate string, last_term int, last_idx int")
    v = spark.createDataFrame([(1, 1, None, 1, 5), (2, 4, "y", 1, 5)], "voter int, own_term int, voted_for string, own_last_term int, own_last_idx int")
    got = {(x.voter, x.seq) for x in consensus.votes(r, v).filter("granted").collect()}
    assert got == {(1, 1), (1, 3), (1, 5), (2, 2), (2, 4)}


def test_rising_only_over_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.choice([1, 1, 1, 2, None]), r.randrange(50)) for i in range(400)]
    top, want = {}, []
    for i, c, s in rows:
        if c is not None and s > top.get(c, -1):
            top[c] = s
            want.append(i)
    got = consensus.rising_only(spark.createDataFrame(rows, "i long, c long, s long"), "c", "s", "i")
    assert sorted(x.i for x in got.collect()) == want


def test_features_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 16)
    monkeypatch.setattr(ordered.over_preceding, "__defaults__", (16,))
    v = [random.Random(1).random() for _ in range(70)]
    df = spark.createDataFrame([(i, i * 10, x) for i, x in enumerate(v)], "idx long, t long, v double")
    got = {r.idx: r for r in features.sequences(df, 5).collect()}
    assert sorted(got) == list(range(5, 70)) and all(list(got[i].seq) == v[i - 5 : i] and got[i].target == v[i] for i in got)
    w = features.with_period(features.row_windows(df, 10, 0.5)).orderBy("win").collect()
    assert [r.period for r in w] == [0] + [100] * 6
    assert [r.write_counts for r in w] == [sum(abs(v[j] - v[j - 1]) > 0.5 for j in range(max(1, i), i + 10)) for i in range(0, 70, 10)]


def test_lstm_of_two_inputs(spark):
    rng = np.random.default_rng(3)
    w = {"wx": rng.normal(size=(8, 2)), "wh": rng.normal(size=(8, 2)), "b": rng.normal(size=8), "out": np.array([1.0, -2.0]), "bias": 0.5}
    seq = rng.normal(size=(4, 2)).tolist()
    act = lambda z: 1 / (1 + np.exp(-z))
    h, c = np.zeros(2), np.zeros(2)
    for x in seq:
        z = w["wx"] @ np.array(x) + w["wh"] @ h + w["b"]
        c = act(z[2:4]) * c + act(z[:2]) * np.tanh(z[4:6])
        h = act(z[6:]) * np.tanh(c)
    got = features.lstm_scores(spark.createDataFrame([(1, seq), (2, seq)], "idx long, seq array<array<double>>"), w).collect()
    assert np.allclose([r.score for r in got], h @ w["out"] + 0.5)


def test_lstm_matches_plain_python(spark):
    import numpy as np

    w = {"wx": np.full((8, 1), 0.1), "wh": np.full((8, 2), 0.2), "b": np.zeros(8), "out": np.ones(2), "bias": 0.5}
    seq = [0.3, -0.2, 0.9]
    h = c = 0.0
    act = lambda z: 1 / (1 + np.exp(-z))
    for x in seq:
        z = 0.1 * x + 0.4 * h
        c = act(z) * c + act(z) * np.tanh(z)
        h = act(z) * np.tanh(c)
    got = features.lstm_scores(spark.createDataFrame([(1, seq)], "idx long, seq array<double>"), w).first()
    assert abs(got.score - (2 * h + 0.5)) < 1e-12


def test_the_cap_alone_ends_a_batch(spark, tmp_path):
    spark.createDataFrame([(i * 1000, 1, "v" * 20) for i in range(600)], "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    r = kv.QUERIES["append_batches"](spark, str(tmp_path)).first()
    n = max(n for n in range(600) if 50 * n * (n + 1) // 2 <= 3_000_000)
    assert (r.entries, r.counter) == (n, 50 * n * (n + 1) // 2)


def test_every_key_is_rewritten(spark, tmp_path):
    rows = [(i, i % 7, f"v{i}") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.key, r.idx, r.value) for r in work.QUERIES["rmw_last"](spark, str(tmp_path)).collect()}
    assert got == {(f"{u:010}", i + 1_000_000, f"v{i}") for u, i in {u: i for i, u, _ in rows}.items()}


def test_zipf_reads_reach_the_least_ranks(spark):
    keys, n, far = 2_000_000, 20_000, 900_000
    share = (1.0 + np.arange(keys)) ** -1.01
    want = share[far:].sum() / share.sum()
    got = [r.key for r in workload.zipf_reads(spark, n, keys).collect()]
    assert len(got) == n and abs(sum(k >= far for k in got) / n - want) < 4 * (want / n) ** 0.5
    assert all((1.0 + k) ** -1.01 * workload.zipf_scale(k) >= 99 for k in (1, 9000, 10**5, 25_600_000, 10**12))


def test_workloads(spark):
    mix = workload.operation_mix(spark, 200, 0.25, 40).collect()
    assert sum(r.is_write for r in mix) == 50 and all(0 <= r.key < 40 for r in mix)
    perm = workload.shuffled_slices(spark, 100, 7).collect()
    assert sorted(r.key for r in perm) == list(range(100)) and [r.key for r in sorted(perm, key=lambda r: r.pos)] != list(range(100))
    z = [r.key for r in workload.zipf_reads(spark, 3000, 50).collect()]
    assert len(z) == 3000 and z.count(0) > z.count(10) > 0
    assert workload.operation_mix(spark, 0, 0.5, 10).collect() == []


def test_metrics_defined_cases(spark):
    rows = [("w", 1, True, True, 10**9, 10**6, 3), ("w", 1, False, True, 10**9, 10**6, 7), ("w", 2, None, None, -1, None, None), ("z", 1, False, False, None, 5, None), ("w", 2, True, True, 10**8, 10**6, 0), ("w", 2, True, False, 10**7, 10**6, 5)]
    ops = spark.createDataFrame(rows, "workload string, client int, ok boolean, is_read boolean, latency_ns long, size long, items long")
    got = {(r.workload, r.variant): (r.mb_per_s, r.latency_ns) for r in metrics.rollup(ops, ["workload"]).collect()}
    assert got["w", "longest_client"] == (1.5, (2e9 + 5.5e7) / 2) and got["z", "wall_clock"] == (None, None) and got["w", "fixed_reply"] == (0.0015, None)
    # of the scans one failed and one found nothing; the write counts in the mix only
    assert got["w", "fixed_item"] == (0.006, None) and got["w", "scan_clients"] == (3.0, 5e8) and got["w", "scan_mix"] == (4.0, 5e8)
    assert len(got) == 2 * len(metrics.variants())


def test_vlog_roundtrip(spark, tmp_path):
    vlog.register(spark)
    rows = [(1, 2, 3, "5", "é" * 40), (2**32 - 1, 0, 0, "12345678901", ""), (7, 1, 1, None, None)] * 30
    df = spark.createDataFrame(rows, "idx long, term long, voted_for long, key string, value string")
    for layout in ("stored", "demo"):
        path = f"{tmp_path}/{layout}"
        df.coalesce(1).write.format("vlog").option("layout", layout).option("splitEvery", 100).mode("append").save(path)
        back = spark.read.format("vlog").option("layout", layout).option("splitBytes", 500).load(path)
        assert back.rdd.getNumPartitions() > 3
        got = back.orderBy("file_offset").collect()
        head = 20 if layout == "stored" else 8
        assert [(r.key, r.value) for r in got] == [(pad(k or ""), v or "") for *_, k, v in rows]
        assert [r.file_offset for r in got][1] == head + 10 + 80
        if layout == "stored":
            assert [(r.idx, r.term, r.voted_for) for r in got] == [x[:3] for x in rows]
        file = f"{path}/{got[0].file}"
        assert vlog.read_at(file, got[1].file_offset, layout == "demo") == ("1234567890", "") and vlog.read_at(file, -1) is None


def test_vlog_bytes_and_torn_end(spark, tmp_path):
    vlog.register(spark)
    raw = vlog.pack(1, 2, 3, "k", "vv")
    assert raw == struct.pack("<5I", 1, 2, 3, 10, 2) + b"000000000kvv"
    (tmp_path / "a.vlog").write_bytes(raw + raw[:-1])
    read = spark.read.format("vlog").option("truncated", "drop").load(str(tmp_path))
    assert read.count() == 1
    with pytest.raises(Exception, match="ends after the file"):
        spark.read.format("vlog").load(str(tmp_path)).count()
    for n in (0, 1, -1, 300, -70000, 2**62):
        assert vlog.unzigzag(vlog.zigzag(n)) == n


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g")
    assert g.read().collect() == []
    g.append(spark.createDataFrame([("a", 1, "1"), ("b", 2, "2")], LOG))
    g.append(spark.createDataFrame([("a", 1, "newer"), ("c", 1, None)], LOG))
    before = sorted(map(tuple, g.read().collect()))
    assert before == [("a", 1, "newer"), ("b", 2, "2"), ("c", 1, None)]
    for _ in range(2):
        g.compact()
        assert sorted(map(tuple, g.read().collect())) == before and len(g.manifest()["live"]) == 1
    version = g.manifest()["version"]
    with pytest.raises(Conflict):
        g._swap([], version - 1)
    assert g.manifest()["version"] == version and len(g.vacuum()) > 2 and sorted(map(tuple, g.read().collect())) == before


def test_generations_of_writers_that_meet_or_die(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/g"
    a, b = Generations(spark, root), Generations(spark, root)
    row = lambda k: spark.createDataFrame([(k, 1, k)], LOG)
    swap, times = a._swap, []

    def second(live, version):
        if not times:
            times.append(b.append(row("b")))  # another writer is first
        swap(live, version)

    monkeypatch.setattr(a, "_swap", second)
    a.append(row("a"))
    assert sorted(r.key for r in a.read().collect()) == ["a", "b"] and a.manifest()["version"] == 2
    times.clear()
    a.compact()  # keeps what came meanwhile
    assert sorted(r.key for r in a.read().collect()) == ["a", "b"] and [x["sorted"] for x in a.manifest()["live"]] == [True, False]
    row("dead").write.parquet(f"{root}/gen=4-dead")  # of a writer that died before its swap
    b.append(row("c"))
    assert sorted(r.key for r in b.read().collect()) == ["a", "b", "c"]


def test_shared_folder_must_be_named_on_a_cluster(spark):
    class Conf(dict):
        set = dict.__setitem__

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(Session("spark://host:7077"))
    local = Session("local[2]")
    root = shared.shared_root(local)
    assert root.startswith("file:///") and shared.shared_root(local) == root


def test_release_removes_intermediate_tables(spark):
    df = shared.cut(spark.range(5).toDF("id"), "released")
    path = shared._written[-1][1]
    assert df.count() == 5 and shared.list_names(spark, path)
    kept = [x for x in shared._written if x[1] != path]
    shared._written[:] = [(spark, path)]
    shared.release(spark)
    assert shared.list_names(spark, path) == [] and shared._written == []
    shared._written.extend(kept)


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,open,low\n1,x,0.5\n2,x,bad\n3,x,\n")
    got = csvio.read_series(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.time, r.low) for r in got] == [(1.0, 0.5), (2.0, None), (3.0, None)]
    csvio.write(spark.createDataFrame([(1,)], "a int"), f"{tmp_path}/o")
    csvio.append(spark.createDataFrame([(2,)], "a int"), f"{tmp_path}/o", header=True)
    assert sorted(r.a for r in spark.read.csv(f"{tmp_path}/o", header=True).collect()) == ["1", "2"]


def test_put_index(spark):
    df = spark.createDataFrame([(3, "put", "7", "v", 1, 1), (1, "put", "8", None, 1, 2)], "recv_id long, op string, key string, value string, client_id long, seq_id long")
    assert [(r.idx, r.key, r.file_version) for r in putlog.assign_index(df, ["recv_id"], compacting=True).orderBy("idx").collect()] == [(1, pad("8"), 1), (2, pad("7"), 1)]


def test_schedule(spark):
    import datetime as dt

    at = [0, 10, 400, 1790, 3700, 9100]
    rows = [(dt.datetime(2026, 3, 1) + dt.timedelta(seconds=s), s == 9100) for s in at] + [(None, True)]
    df = spark.createDataFrame(rows, "at timestamp_ntz, full boolean")
    got = {r.slot % 86_400_000_000 // 60_000_000: r.reason for r in compact.schedule(df, "at", full=F.col("full")).collect()}
    assert got == {0: "idle", 60: "idle", 150: "full"}
    assert compact.schedule(df.limit(0), "at").collect() == []


def test_load_inserts(spark):
    rows = workload.load_inserts(spark, 40, 0.25, 100, 1000).collect()
    assert sorted(r.key for r in rows if r.is_write) == list(range(1000, 1010)) and all(r.key < 100 for r in rows if not r.is_write)
