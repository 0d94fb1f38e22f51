"""Invariants of the core operators on generated tables."""

import math
import random
from itertools import pairwise

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import cache, keyedlog, membership, ordered, placement, sequences, shedder, stacks
from quarry.session import scratch_path
from quarry.sources import binarylog, generators, text
from quarry.streaming import pipelines

LOG = "key string, seq bigint, value string, tombstone boolean, run_id bigint"


def log_of(spark, ops, per_run=100):
    """A log of (key, value or None to delete), in order."""
    return spark.createDataFrame([(k, i, "" if v is None else v, v is None, i // per_run) for i, (k, v) in enumerate(ops)], LOG)


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def test_log_against_a_dict(spark):
    rng = random.Random(1)
    ops = [(f"k{rng.randrange(200)}", None if rng.random() < 0.3 else f"v{i}") for i in range(3000)]
    want = {}
    for k, v in ops:
        want.pop(k, None)
        if v is not None:
            want[k] = v
    log = log_of(spark, ops)
    assert as_dict(keyedlog.snapshot(log)) == want
    probes = spark.createDataFrame([(f"k{i}",) for i in range(250)], "key string")
    for found in (keyedlog.get(log, probes), keyedlog.multi_get(keyedlog.runs(log), probes), keyedlog.multi_get(keyedlog.compact(keyedlog.runs(log)), probes)):
        assert as_dict(found) == {f"k{i}": want.get(f"k{i}", "") for i in range(250)}
    assert tuple(keyedlog.fold(log).first()) == (len(want), sum(map(len, want.values())))


def test_empty_value_is_a_value(spark):
    assert as_dict(keyedlog.snapshot(log_of(spark, [("a", ""), ("b", "x"), ("b", None)]))) == {"a": ""}


def test_delete_gives_back_bytes_once(spark):
    ops = [("a", "val"), ("a", None), ("a", None), ("missing", None)]
    for chunk in (1, 2, 1000):
        assert [r.n_bytes for r in keyedlog.deleted_bytes(log_of(spark, ops), chunk).orderBy("seq").collect()] == [19, 0, 0]


def test_compaction_keeps_the_latest(spark):
    ops = [(f"key_{i}", f"val_{i}") for i in range(1000)] + [(f"key_{i}", None) for i in range(0, 1000, 5)] + [(f"key_{i}", f"new_{i}") for i in range(200)]
    path, merged = scratch_path(spark, "store"), scratch_path(spark, "merged")
    keyedlog.write_runs(log_of(spark, ops, 64), path)
    keyedlog.compact_store(spark, path, merged)
    found = {r.key: None if r.tombstone else r.value for r in keyedlog.read_runs(spark, merged).collect()}
    assert found == {f"key_{i}": f"new_{i}" if i < 200 else None if i % 5 == 0 else f"val_{i}" for i in range(1000)}
    assert {r.level for r in keyedlog.read_runs(spark, merged).select("level").distinct().collect()} == {1}


def test_lone_tombstone_at_a_merge(spark):
    merged = keyedlog.compact(keyedlog.runs(log_of(spark, [("a", "1"), ("b", None), ("c", "3")])))
    assert [(r.key, r.value, r.tombstone) for r in merged.collect()] == [("a", "1", False), ("b", "", True), ("c", "3", False)]


def test_rotation_by_writer(spark):
    log = log_of(spark, [(f"{i % 2}", "x" * (i % 50)) for i in range(500)])
    found = keyedlog.rotate(log, 200, F.col("key").cast("bigint")).toPandas().sort_values(["writer", "seq"])
    for _, part in found.groupby("writer"):
        file_id, offset = 0, 0
        for got_file, got_offset, size in zip(part.file_id, part.file_offset, part.n_bytes):
            if offset and offset + size > 200:
                file_id, offset = file_id + 1, 0
            assert (got_file, got_offset) == (file_id, offset)
            offset += size


def test_range_lookup_finds_the_block(spark):
    keys = [f"{i:04d}" for i in range(0, 500, 5)]
    tables = spark.createDataFrame([(0, k, "v") for k in keys], "run_id bigint, key string, value string")
    index = keyedlog.sparse_index(tables, 16)
    probes = spark.createDataFrame([(0, f"{i:04d}") for i in range(0, 600, 7)] + [(0, "")], "run_id bigint, key string")
    for r in keyedlog.range_lookup(index, probes).collect():
        assert r.block == max([0] + [b for b, k in enumerate(keys[::16]) if k <= r.key])


def test_fold_with_a_function(spark):
    def lengths(batches):
        for b in batches:
            yield b.assign(n=b.value.str.len())[["key", "n"]]

    found = keyedlog.fold_with(log_of(spark, [("a", "xx"), ("b", "y"), ("b", None)]), lengths, "key string, n bigint")
    assert [tuple(r) for r in found.collect()] == [("a", 2)]


def test_append_and_replay(spark):
    path = scratch_path(spark, "log")
    for part in ([("a", "1")], [("b", "2")]):
        keyedlog.append(log_of(spark, part), path)
    assert keyedlog.replay(spark, path).count() == 2


def test_bloom_never_misses(spark):
    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "key")
    bits, k, m = membership.build(keys, "key", 0.01)
    saved = spark.read.parquet(membership.save(bits))
    row = membership.false_positive_rate(membership.probe(saved, spark.range(20000).withColumnRenamed("id", "key"), "key", k, m), keys, "key").first()
    assert row.n_members == row.n_members_hit == 2000
    assert abs(row.n_false / row.n_others - 0.01) < 0.01


def test_jump_hash_moves_keys_to_the_new_bucket_only(spark):
    keys = spark.range(3000)
    for n in (1, 7, 100):
        row = placement.moved(keys, "id", n).first()
        assert row.n_moved == row.n_to_new
        assert abs(row.n_moved - 3000 / (n + 1)) < 6 * math.sqrt(3000 / (n + 1))
    assert keys.select(placement.jump_hash(F.col("id"), 1).alias("b")).distinct().collect()[0].b == 0


def test_lru_unit():
    c = cache.LRU(5)
    assert [c.access(k)[1] for k in "abcdef"] == [None] * 5 + ["a"]
    assert c.access("a") == (False, "b")
    c = cache.LRU(0, list("abcde"))
    assert c.access("b")[0] and c.head(3) == ["b", "e", "d"]
    assert c.remove("a") and not c.remove("a")


@pytest.mark.parametrize("capacity,chunk", [(1, 7), (5, 40), (5, 10_000), (50, 13)])
def test_lru_chunks_equal_one_replay(spark, capacity, chunk):
    rng = random.Random(capacity)
    seq = [str(rng.randrange(20)) for _ in range(400)]
    plain = cache.LRU(capacity)
    want = [plain.access(k) for k in seq]
    rows = spark.createDataFrame([(3 * i, k) for i, k in enumerate(seq)], "seq bigint, key string")
    got = cache.replay(rows, capacity, chunk).orderBy("seq").collect()
    assert [(r.hit, r.evicted) for r in got] == want


def test_expiry_counts_from_the_last_write(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('a', TIMESTAMP_NTZ '2024-01-01 00:00:05'), ('b', TIMESTAMP_NTZ '2024-01-01 00:00:01') t(key, written_at)")
    assert [r.key for r in cache.expired(rows, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:05'"), "1 SECOND").collect()] == ["b"]


def test_ordered_helpers_need_no_global_window(spark):
    rng = random.Random(2)
    values = [rng.randrange(1000) for _ in range(700)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint")
    pos = {r.id: r.pos for r in ordered.numbered(df, [F.col("v"), F.col("id")]).collect()}
    assert sorted(pos, key=pos.get) == sorted(range(700), key=lambda i: (values[i], i))
    sums = {r.id: r.s for r in ordered.prefix_sum(df.withColumn("b", F.expr("id div 50")), "b", ["id"], "v", "s").collect()}
    assert all(sums[i] == sum(values[: i + 1]) for i in range(700))
    roll = {r.id: (r.s, r.n) for r in ordered.rolling(df, "id", 30, {"s": F.sum("v"), "n": F.count("*")}, chunk=40).collect()}
    assert all(roll[i] == (sum(values[max(0, i - 29) : i + 1]), min(30, i + 1)) for i in range(700))


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.95])
def test_rolling_quantile_is_sparks_percentile(spark, ratio):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, rng.randrange(50)) for i in range(500)], "seq bigint, pos int")
    found = shedder.thresholds(rows, ratio, frame=40, chunk=64).select("seq", "threshold")
    exact = ordered.rolling(rows, "seq", 40, {"exact": F.percentile(F.col("pos").cast("double"), F.lit(ratio))}, chunk=100)
    assert found.join(exact, "seq").filter("threshold <=> exact").count() == 500


def test_strict_threshold(spark):
    rows = spark.createDataFrame([(i, 5) for i in range(10)], "seq bigint, pos int")
    assert shedder.thresholds(rows, 0.0).filter("admitted").count() == 0


def test_intervals_need_count_and_time(spark):
    fast = [(i, i * 0.001, 1.0) for i in range(400)] + [(400 + i, 10 + i * 0.1, 1.0) for i in range(300)]
    found = shedder.close_intervals(spark.createDataFrame(fast, "seq bigint, at double, latency double")).groupBy("interval").count().orderBy("interval").collect()
    assert [r["count"] for r in found] == [401, 251, 48]


def test_limit_follows_latency():
    assert shedder.tuned_limit(50, -1.0, None) == 49
    assert shedder.tuned_limit(50, 1.0, 0.1) == 51
    assert shedder.tuned_limit(50, 1.0, 9.0) == 49
    assert shedder.tuned_limit(10, -1.0, 99.0) == 10


def test_profile_to_stacks(spark):
    lines = ["# comment", "PeriodType: cpu", "Samples:", "samples/count cpu/nanoseconds", "   1   10000000: 1 2 ", "   1   10000000: 3 2 ", "   2   10000000: 3 9 ",
             "Locations", "     1: 0x58b265 scanblock :0 s=0", "     2: 0x599530 M=1 GC :0 s=0", "     3: 0x58a999 flushptrbuf :0 s=0", "Mappings", "1: 0x0/0x0"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos bigint, value string")
    samples, names = text.profile(df)
    found = {";".join(r.frames): r.n for r in stacks.resolve(samples, names).collect()}
    assert found == {"GC;scanblock": 1, "GC;flushptrbuf": 1, "9;flushptrbuf": 2}


def test_folded_lines(spark):
    df = spark.createDataFrame([("a;b;c 31",), ("a;b 1 2.5",), ("nothing",), ("a b;c 4",)], "value string")
    found = [(r.frames, r.n1, r.n2, r.ignored) for r in text.parse_folded(df).collect()]
    assert found[0] == (["a", "b", "c"], 31.0, None, False)
    assert found[1] == (["a", "b"], 1.0, 2.5, False)
    assert found[2][3] and found[3][0] == ["a b", "c"]


def test_flame_nodes_and_search(spark):
    folded = spark.createDataFrame([(["a", "b"], 3), (["a-b"], 1), (["a", "x", "b"], 2), (["a"], 4)], "frames array<string>, n bigint")
    tree = stacks.nodes(folded)
    got = {";".join(r.path): (r.value, r.start, r.end) for r in tree.collect()}
    assert got == {"": (10, 0, 10), "a": (9, 0, 9), "a;b": (3, 4, 7), "a;x": (2, 7, 9), "a;x;b": (2, 7, 9), "a-b": (1, 9, 10)}
    assert stacks.matched_share(tree, "^b$").first().percent == 50.0
    assert stacks.matched_share(tree, "^(A|B)$", ignore_case=True).first().percent == 90.0
    assert {";".join(r.path) for r in stacks.zoom(tree, ["a", "x"]).collect()} == {"", "a", "a;x", "a;x;b"}
    assert stacks.prune(tree, percent=25).count() == 3
    assert stacks.prune(tree, pixels=300).count() == 3
    shared = {";".join(r.frames): r.shared for r in stacks.common_prefix(folded).collect()}
    assert shared == {"a": 0, "a;b": 1, "a;x;b": 1, "a-b": 0}
    notes = spark.createDataFrame([("x", {"href": "y"})], "name string, attributes map<string,string>")
    assert {";".join(r.path): r.attributes for r in stacks.with_attributes(tree, notes).collect() if r.attributes} == {"a;x": {"href": "y"}}
    frames = spark.createDataFrame([(["a", "--", "b", "c"],)], "f array<string>").select(stacks.with_wakers(F.col("f")).alias("f"))
    assert frames.first().f == ["a", "--", "b_[w]", "c_[w]"]


def test_metric_and_attribute_lines(spark):
    df = spark.createDataFrame([("queue: 3, inflight: (2/50), in: 7",)], "value string")
    assert text.metric_lines(df).first().metrics == {"queue": "3", "inflight": "(2/50)", "in": "7"}
    df = spark.createDataFrame([("main\thref=x=y\ttitle=t",)], "value string")
    assert tuple(text.attributes(df).first()) == ("main", {"href": "x=y", "title": "t"})


def test_measurement_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("b;1.5\n\na;-2.0\nb;0.1")
    found = text.measurements(spark, str(tmp_path / "m.txt"), kind="decimal(4,1)").collect()
    assert sorted((r.key, float(r.value)) for r in found) == [("a", -2.0), ("b", 0.1), ("b", 1.5)]


def test_binary_log(spark, tmp_path):
    (tmp_path / "2.log").write_bytes(binarylog.encode([(1, 0, b"a", b"old"), (2, 0, b"b", b"x")]))
    (tmp_path / "10.log").write_bytes(binarylog.encode([(3, 0, b"a", b"new"), (4, 0, b"b", b"")]) + b"\0\0")
    rows = binarylog.read(spark, f"{tmp_path}/*.log")
    assert as_dict(keyedlog.snapshot(rows)) == {"a": "new"}
    assert rows.filter("file_id = 2").orderBy("seq").select("file_offset").collect()[1][0] == 20


def test_run_files(spark, tmp_path):
    data = binarylog.encode_run([(b"b", b""), (b"a", b"x" * 300), (b"c", b"3")])
    (tmp_path / "run-3.data").write_bytes(data)
    assert [binarylog.from_varint(binarylog.varint(n)) for n in (0, 1, 63, 64, 300, 1 << 40)] == [0, 1, 63, 64, 300, 1 << 40]
    found = binarylog.read_runs(spark, str(tmp_path)).orderBy("key").collect()
    assert [(r.run_id, r.key, len(r.value), r.tombstone) for r in found] == [(3, "a", 300, False), (3, "b", 0, True), (3, "c", 1, False)]
    assert [k for _, k, _ in binarylog.decode_run(data, found[1].file_offset, found[2].file_offset)] == [b"b"]


def test_generators_repeat(spark):
    one, two = (generators.measurements(spark, 500, ["x", "y", "x"], seed=3).collect() for _ in range(2))
    assert one == two and {r.key for r in one} == {"x", "y"}
    z = generators.zipf_keys(spark, 20_000, 100).groupBy("key").count().orderBy(F.desc("count")).first()
    assert z["count"] > 2000
    m = generators.messages(spark, 100, 10.0).agg(F.max("at"), F.min("priority"), F.max("cohort")).first()
    assert m[0] == 9.9 and m[1] >= 0 and m[2] < 128


def test_sequences(spark):
    assert [r.n for r in sequences.primes(spark, 10).collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    a = spark.createDataFrame([(i, i) for i in range(5)], "o int, v int")
    b = spark.createDataFrame([(9 - i, 4 - i) for i in range(5)], "o int, v int")
    c = spark.createDataFrame([(i, i) for i in range(6)], "o int, v int")
    order = [F.col("o")]
    assert sequences.same_sequence(a, b, order, order, "v").first().same
    assert not sequences.same_sequence(a, c, order, order, "v").first().same


def test_generators_over_partitions(spark):
    def doubled(rows):
        for (n,) in rows:
            yield (2 * n,)

    def broken(rows):
        yield from rows
        raise ValueError("no more")

    assert sorted(r.n for r in sequences.pull(spark.range(3), doubled, "n bigint").collect()) == [0, 2, 4]
    with pytest.raises(PythonException, match="no more"):
        sequences.pull(spark.range(3), broken, "n bigint").collect()
    sequences.register_counter(spark)
    assert [r.n for r in spark.sql("SELECT n FROM counter_from(2, 3) ORDER BY n").collect()] == [2, 3, 4]


def test_trees_in_order(spark):
    # the same sequence 1..5 as two shapes
    rows = [("a", 1, None, None, 3), ("a", 2, 1, "left", 1), ("a", 3, 2, "right", 2), ("a", 4, 1, "right", 5), ("a", 5, 4, "left", 4),
            ("b", 1, None, None, 1), ("b", 2, 1, "right", 2), ("b", 3, 2, "right", 3), ("b", 4, 3, "right", 4), ("b", 5, 4, "right", 5)]
    found = sequences.in_order(spark.createDataFrame(rows, "tree string, node_id int, parent_id int, side string, value int")).collect()
    for t in "ab":
        assert [r.value for r in sorted(found, key=lambda r: r.pos) if r.tree == t] == [1, 2, 3, 4, 5]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.int_add(F.lit(2147483647), F.lit(1)), scalars.after_last(F.lit("a;b;1.5"), ";"), scalars.before_first(F.lit("a;b"), ";"), scalars.tenths(F.lit("-3.4")),
        scalars.extension(F.lit("x/y.tar.gz")), scalars.thousands(F.lit(1234567)), scalars.xml_escape(F.lit('<a&"b">')), scalars.strip_annotation(F.lit("f_[k]")),
        scalars.one_decimal(F.lit(0.25)), scalars.admission_ratio(F.lit(-5.0), F.lit(0.0)), F.round(scalars.limit_threshold(F.lit(10), 2.0), 6),
    ).first()
    assert tuple(row) == (-2147483648, "1.5", "a", -34, "gz", "1,234,567", "&lt;a&amp;&quot;b&quot;&gt;", "f", "0.3", 0.0, 2.0)
    assert scalars.human_bytes(1536) == "1.5 KiB"
    assert scalars.human_seconds(3725) == "1 hours 2 minutes 5 seconds"
    assert scalars.int32(1 << 31) == -(1 << 31)
    assert spark.range(100).select(scalars.service_time(F.randn(1), F.lit(3)).alias("x")).filter("x < 0").count() == 0


def test_streamed_upserts_over_many_batches(spark, tmp_path):
    rng = random.Random(5)
    ops = [(f"k{rng.randrange(20)}", i, f"v{i}", rng.random() < 0.2) for i in range(300)]
    for a, b in pairwise(range(0, 301, 100)):
        spark.createDataFrame(ops[a:b], "key string, seq bigint, value string, tombstone boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    found = pipelines.upsert_runs(pipelines.file_stream(spark, str(tmp_path / "log"), files_per_trigger=1)).collect()
    want = {k: (i, v, t) for k, i, v, t in ops}
    assert {r.key: (r.seq, r.value, r.tombstone) for r in found} == want


def test_streamed_cache(spark, tmp_path):
    rng = random.Random(6)
    seq = [(i, str(rng.randrange(30))) for i in range(300)]
    spark.createDataFrame(seq, "seq bigint, key string").coalesce(1).write.parquet(str(tmp_path / "a"))
    found = pipelines.drain(pipelines.lru_stream(pipelines.file_stream(spark, str(tmp_path / "a")), 4, 2), "append", "lru").collect()
    caches = {}
    assert len(found) == 300
    for r in sorted(found, key=lambda r: r.seq):
        assert (r.hit, r.evicted) == caches.setdefault(r.shard, cache.LRU(4)).access(r.key)


def test_files_by_extension(spark, tmp_path):
    from quarry.operators import aggregate

    for name, size in (("a.txt", 30), ("b.txt", 10), ("c.log", 60)):
        (tmp_path / name).write_bytes(b"x" * size)
    found = {r.ext: (r.n, r.bytes, float(r.percent)) for r in aggregate.files_by_extension(text.file_listing(spark, str(tmp_path))).collect()}
    assert found == {"txt": (2, 40, 40.0), "log": (1, 60, 60.0)}


def test_idle_shards_expire(spark, tmp_path):
    import time

    rows = [(i, f"k{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "seq bigint, key string").coalesce(1).write.parquet(str(tmp_path / "a"))
    seen = []
    stream = pipelines.lru_stream(pipelines.file_stream(spark, str(tmp_path / "a")), 2, 1, ttl_ms=200)
    query = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            if any(r.seq is None for r in seen):
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.seq for r in seen if r.seq is not None] == list(range(9))
    assert sorted(r.evicted for r in seen if r.seq is None) == ["k1", "k2"]


def test_numbers_as_text_round_like_python(spark):
    """Ties go to the even digit, by the exact binary value, in columns as in Python."""
    sizes = [0.0, 0.05, 0.15, 0.25, 0.95, 0.35, 999.95, 1174.0, 1280.0, 3328.0, 1279.0, 1281.0, 1023.96, 2**20 * 1.25, 2**30 * 2.75, 2**40 * 7.35, 2.0**70]
    times = [0.0, 0.0005, 0.0015, 0.0625, 0.9995, 59.0625, 59.9995, 1e-9, 2.0005, 12.3125, 60.0, 3725.5]
    df = spark.createDataFrame([(x, "size") for x in sizes] + [(x, "time") for x in times] + [(None, "size")], "x double, kind string")
    got = df.select("x", "kind", scalars.bytes_text(F.col("x")).alias("size"), scalars.seconds_text(F.col("x")).alias("time")).collect()
    for r in got:
        want = None if r.x is None else scalars.human_bytes(r.x) if r.kind == "size" else scalars.human_seconds(r.x)
        assert r[r.kind] == want, r


@pytest.mark.parametrize("misses", [False, True])
def test_sketched_quantile_is_exact_beyond_its_accuracy(spark, misses, monkeypatch):
    rng = random.Random(12)
    rows = [("a", rng.random()) for _ in range(5000)] + [("b", float(rng.randrange(4))) for _ in range(3000)] + [(None, rng.gauss(0, 1)) for _ in range(777)]
    rows += [("a", None)] * 9 + [("none", None)] * 2 + [("one", 5.0)]
    if misses:
        monkeypatch.setattr(shedder.F, "percentile_approx", lambda v, ends, accuracy: F.array(F.max(v) + 1, F.max(v) + 2))
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for q in (0.9, 0.5, 0.0, 1.0):
        got = {r.k: (r.quantile, r.n, r.least) for r in shedder.sketched_quantile(df, ["k"], "v", q, accuracy=50).collect()}
        want = {}
        for k in {k for k, _ in rows}:
            found = sorted(v for g, v in rows if g == k and v is not None)
            rank = max(1, math.ceil(len(found) * round(10 * q) / 10 - 1e-9))
            want[k] = (found[rank - 1] if found else None, sum(g == k for g, _ in rows), found[0] if found else None)
        assert got == want
