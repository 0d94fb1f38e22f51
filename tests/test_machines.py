"""Queues, limiters, stores and hashes against plain loops, and what earlier versions got wrong."""

import heapq
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry import session
from quarry.functions import scalars
from quarry.operators import cache, keyedlog, membership, sequences, shedder
from quarry.plans import machines
from quarry.plans.dialect import render
from quarry.session import scratch_path
from quarry.sources import binarylog, generators, text


def slow_route(rows, limit, tick, age):
    """Every tick in turn, with nothing left out."""
    rows, out, queue, running, k = sorted(rows, key=lambda r: (r[1], r[0])), {}, [], [], 0
    now = 0.0
    while k < len(rows) or queue:
        while k < len(rows) and rows[k][1] <= now:
            seq, at, pos, service = rows[k]
            heapq.heappush(queue, (pos, seq, at, service))
            k += 1
        running = [x for x in running if x > now]
        while queue:
            pos, seq, at, service = queue[0]
            if now - at > age:
                out[seq] = (None, None)
            elif len(running) < limit:
                running.append(now + service)
                out[seq] = (now, now + service)
            else:
                break
            heapq.heappop(queue)
        now += tick
    return out


@pytest.mark.parametrize("limit, age, gap", [(1, 30, 3), (3, 12, 2), (2, 1000, 5), (4, 5, 30)])
def test_routing_against_every_tick(spark, limit, age, gap):
    rng = random.Random(limit)
    rows, at = [], 0.0
    for i in range(400):
        at += rng.randrange(2 * gap) / 2 if rng.random() < 0.9 else 100
        rows.append((i, at, float(rng.randrange(20)), float(rng.randrange(1, 20))))
    df = spark.createDataFrame([(*r, lane) for r in rows for lane in (0, 1)], "seq bigint, at double, pos double, service double, lane int")
    got = shedder.route(df, limit, 1.0, float(age), F.col("lane")).collect()
    want = slow_route(rows, limit, 1.0, age)
    for lane in (0, 1):
        assert {r.seq: (r.started, r.finished) for r in got if r.lane == lane} == want
    assert all(r.expired == (r.started is None) and r.in_flight <= limit for r in got)


def test_routing_query_keeps_its_limit(spark, sf):
    got = machines.shed_route(spark, sf).toPandas()
    arrived = machines.arrivals(spark, sf).toPandas()
    assert len(got) == len(arrived)
    for lane, part in arrived.groupby("lane"):
        rows = [tuple(r) for r in part[["seq", "at", "pos", "service"]].astype(float).itertuples(index=False)]
        start = min(r[1] for r in rows) // machines.TICK * machines.TICK
        want = slow_route([(s, a - start, p, v) for s, a, p, v in rows], machines.WORKERS, machines.TICK, machines.AGE)
        for r in got[got.lane == lane].itertuples():
            begun = want[r.seq][0]
            assert r.expired == (begun is None) and (begun is None or r.started == begun + start)


def test_fnv_and_xxhash(spark):
    def fnv(data):
        h = scalars.FNV_BASIS
        for b in data:
            h = (h ^ b) * scalars.FNV_PRIME % (1 << 64)
        return h

    keys = ["", "a", "foobar", "héllo", "x" * 300, "\x00\xff"]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    got = df.select("k", scalars.fnv1a(F.col("k")).alias("h"), scalars.fnv1a(F.col("k"), 7).alias("s"), scalars.xx_double_hash(F.col("k"), 4, 1000).alias("p")).collect()
    for r in got:
        if r.k is None:
            assert r.h is None and r.s is None
            continue
        data = r.k.encode()
        assert r.h % (1 << 64) == fnv(data) and r.s % (1 << 64) == fnv(data + b"\x07")
        h = xxhash.xxh64_intdigest(data, 42)
        assert r.p == [((h & 0xFFFFFFFF) + i * (h >> 32)) % (1 << 32) % 1000 for i in range(4)]


def test_cache_without_a_limit(spark):
    rng = random.Random(4)
    seq = [str(rng.randrange(15)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(seq)), "seq bigint, key string")
    plain = cache.LRU(0)
    want = [plain.access(k) for k in seq]
    for chunk in (2, 1000):
        assert [(r.hit, r.evicted) for r in cache.replay(rows, 0, chunk).orderBy("seq").collect()] == want


def test_lanes_do_not_mix(spark):
    rng = random.Random(5)
    rows = [(lane, i, rng.random() * (1 + lane), rng.random()) for lane in (0, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "lane bigint, interval bigint, x double, y double")
    both = {(r.lane, r.interval): r.cov for r in shedder.rolling_covariance(df, "interval", "x", "y", 5, lane="lane").collect()}
    alone = {(0, r.interval): r.cov for r in shedder.rolling_covariance(df.filter("lane = 0"), "interval", "x", "y", 5).collect()}
    assert all(both[k] == v or abs(both[k] - v) < 1e-12 for k, v in alone.items() if v is not None)


def test_limit_follows_the_clock(spark):
    rows = [(0, 0, 2.0, 1.0, 0.1), (0, 1, 3.0, 1.0, 0.1), (0, 2, 21.0, 1.0, 0.1), (0, 3, 22.0, -1.0, None)]
    df = shedder.due(spark.createDataFrame(rows, "lane bigint, interval bigint, closed double, cov double, slowdown double"), "closed")
    assert [r.times for r in df.orderBy("interval").collect()] == [0, 4, 0, 0]
    assert [r["limit"] for r in shedder.tune(df, 50).orderBy("interval").collect()] == [50, 54, 54, 53]


@pytest.mark.parametrize("n", [300, 6000])
def test_bloom_rate_holds_at_any_size(spark, n):
    keys = spark.range(0, 2 * n, 2).withColumnRenamed("id", "key")
    bits, k, m = membership.build(keys, "key", 0.02)
    row = membership.false_positive_rate(membership.probe(bits, spark.range(2 * n).withColumnRenamed("id", "key"), "key", k, m), keys, "key").first()
    assert row.n_members_hit == n and row.n_false / row.n_others < 0.05


def log_of(spark, n):
    return spark.createDataFrame([(f"k{i:05d}", i, "v" * (i % 30), False) for i in range(n)], "key string, seq bigint, value string, tombstone boolean")


def test_memtables_and_writers(spark):
    options = keyedlog.StoreOptions(memtable_bytes=100)
    got = keyedlog.memtables(log_of(spark, 300), options, F.pmod("seq", F.lit(2))).toPandas().sort_values("seq")
    for writer in (0, 1):
        run, held = writer << 32, 0
        for r in got[got.seq % 2 == writer].itertuples():
            assert r.run_id == run
            held += 16 + len(r.key) + len(r.value)
            if held > 100:
                run, held = run + 1, 0


def test_runs_are_skipped(spark):
    """A probe outside a run's keys reads no row of it: the scan's own counter says so."""
    path = scratch_path(spark, "store")
    keyedlog.write_runs(log_of(spark, 2000).withColumn("run_id", F.expr("seq div 500")), path)
    assert keyedlog.read_runs(spark, path).count() == 2000
    for keys, most in ((["k00001"], 500), (["nothing"], 0), (["k00001", "k01999"], 1000)):
        found = keyedlog.read_keys(spark, path, keys)
        assert found.count() == sum(k.startswith("k") for k in keys)
        plan = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().toRdd().count()
        leaf = plan.collectLeaves().head()
        assert leaf.metrics().apply("numOutputRows").value() <= most


def test_old_runs_go(spark, tmp_path):
    path, merged = str(tmp_path / "old"), str(tmp_path / "new")
    keyedlog.write_runs(log_of(spark, 100).withColumn("run_id", F.expr("seq div 10")), path)
    keyedlog.compact_store(spark, path, merged, remove_old=True)
    assert not (tmp_path / "old").exists() and keyedlog.read_runs(spark, merged).count() == 100


def test_packed_files(spark):
    log = log_of(spark, 50).withColumn("run_id", F.expr("seq div 20"))
    files = binarylog.pack(log)
    assert sorted(r.path for r in files.select("path").collect()) == ["0.log", "1.log", "2.log"]
    rows = binarylog.unpack(files).orderBy("file_id", "file_offset").collect()
    assert [(r.file_id, r.ts, r.key.decode()) for r in rows] == [(i // 20, i, f"k{i:05d}") for i in range(50)]


def test_a_folder_of_one_machine_is_no_use_on_a_cluster(spark, monkeypatch):
    class Conf:
        @staticmethod
        def get(name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Cluster:
        conf = Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_rendering_says_what_it_leaves_out(spark):
    assert len(render(spark.range(1500)).splitlines()) == 1502
    assert render(spark.range(5), rows=3).splitlines()[-1] == "and more"
    assert "and more" not in render(spark.range(3), rows=3)


def test_generators_stop_early_and_in_batches(spark):
    taken = []

    def first_three(rows):
        for k, (n,) in enumerate(rows):
            if k == 3:
                return  # what is left is not pulled
            yield (n,)

    assert sequences.pull(spark.range(0, 100, 1, 1), first_three, "n bigint").count() == 3
    assert sequences.pull(spark.range(25_000), lambda rows: rows, "n bigint").count() == 25_000
    assert taken == []


def test_prime_counts(spark):
    found = [r.n for r in sequences.primes(spark, 2000).collect()]
    assert len(found) == 2000 and found[-1] == 17389
    assert all(n % p for n in found[::50] for p in range(2, math.isqrt(n) + 1))


def test_normal_numbers(spark):
    row = spark.range(4000).select(generators.normal(1, F.col("id")).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(row[0]) < 0.08 and abs(row[1] - 1) < 0.06
    slow = spark.range(5).select(scalars.service_time(F.lit(-9.0), F.col("id") * 10).alias("x")).collect()
    assert [r.x for r in slow] == pytest.approx([math.exp(k) / 1000 for k in range(5)])


def test_message_stream(spark, tmp_path):
    stream = generators.message_stream(spark, 200)
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        import time

        for _ in range(60):
            if len(seen) >= 200:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(seen) >= 200 and all(0 <= r.priority < 6 and 0 <= r.cohort < 128 for r in seen)
    fixed = {r.seq: (r.priority, r.cohort) for r in generators.messages(spark, 50, 1.0).collect()}
    assert all(fixed[r.seq] == (r.priority, r.cohort) for r in seen if r.seq < 50)


def test_awkward_folded_lines(spark):
    lines = ["a;b 1.", "a;b .5", "a;b 1.2.3", "a b", "12", "", "a;b  7 8.25", "a;b\t3", "a 1e5", "x 2 y 3"]
    got = [(r.frames, r.n1, r.n2, r.ignored) for r in text.parse_folded(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got[0] == (["a", "b"], 1.0, None, False) and got[6] == (["a", "b"], 7.0, 8.25, False) and got[7] == (["a", "b"], 3.0, None, False)
    assert [g[3] for g in got] == [False, True, True, True, True, True, False, False, True, False]
    assert got[9] == (["x 2 y"], 3.0, None, False)


def test_long_profiles_are_read_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 7)
    lines = ["Samples:"] + [f"  {i}  100: {i % 9} {i % 4}" for i in range(1, 60)] + ["Locations"] + [f"  {i}: 0x{i:x} f{i} :0" for i in range(9)] + ["Mappings", "1: 0x0 0x1 x"]
    samples, names = text.profile(spark.createDataFrame(list(enumerate(lines)), "pos bigint, value string").repartition(3))
    assert sorted((r.n, r.loc_ids) for r in samples.collect()) == [(i, [str(i % 9), str(i % 4)]) for i in range(1, 60)]
    assert {r.id: r.name for r in names.collect()} == {str(i): f"f{i}" for i in range(9)}
