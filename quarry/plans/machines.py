"""Registered queries of stateful machinery: queues, caches, memtables, ordered maps, trees and generators, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import cache, keyedlog, ordered, placement, sequences, shedder, stacks
from quarry.plans import catalog
from quarry.plans.catalog import CAPACITY, _LAST, _LOG, _SIZE, event_log, query
from quarry.session import load

#: Workers, seconds of a tick and of waiting at most of the routing query.
WORKERS, TICK, AGE = 2, 60.0, 1800.0
#: Bytes of a memtable of the flushing query.
MEMTABLE = keyedlog.StoreOptions(every=16, memtable_bytes=4096)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of eight lanes that take as many minutes as half their value."""
    rows = catalog._messages(spark, sf_dir).join(load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id"), "seq")
    return rows.select("seq", F.pmod("user_id", F.lit(8)).alias("lane"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "pos", (F.col("value") * 30).alias("service"))


@query()
def shed_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through a queue to two workers a lane: who waits too long is dropped, and the limit holds."""
    rows = arrivals(spark, sf_dir)
    return shedder.route(rows, WORKERS, TICK, AGE, F.col("lane"))


@query("SELECT event_id AS seq FROM events WHERE ts + INTERVAL 6 HOUR >= (SELECT max(ts) FROM events)")
def shed_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages no older than six hours at the end."""
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))
    now = events.agg(F.max("created_at")).first()[0]
    return shedder.unexpired(events, F.lit(now).cast("timestamp_ntz"), "6 HOUR").select("seq")


@query("SELECT event_id AS seq, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(value) OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) AS least_so_far FROM events")
def latency_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least latency so far, reset every day."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value")
    return shedder.running_least(rows, ["day"], "seq", "value").select("seq", "day", "least_so_far")


@query(
    f"WITH RECURSIVE {_LOG}, s AS (SELECT seq, key, value, tombstone, {_SIZE} AS n_bytes FROM log), r AS ("
    "SELECT seq, n_bytes AS held, 0::BIGINT AS run_id FROM s WHERE seq = 0 UNION ALL"
    f" SELECT s.seq, CASE WHEN r.held > {MEMTABLE.memtable_bytes} THEN s.n_bytes ELSE r.held + s.n_bytes END, CASE WHEN r.held > {MEMTABLE.memtable_bytes} THEN r.run_id + 1 ELSE r.run_id END"
    " FROM r JOIN s ON s.seq = r.seq + 1), f AS (SELECT s.*, r.run_id FROM s JOIN r USING (seq)),"
    " runs AS (SELECT run_id, key, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM f GROUP BY run_id, key)"
    f" SELECT run_id, count(*) AS items, CAST(sum({_SIZE}) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE tombstone) AS tombstones FROM runs GROUP BY run_id"
)
def lsm_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that memtables of four kilobytes flush."""
    return keyedlog.run_summary(keyedlog.memtables(event_log(spark, sf_dir), MEMTABLE))


@query(f"WITH {_LOG}, {_LAST} SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key, seq, value FROM last WHERE NOT tombstone")
def log_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys in order, as an ordered map hands them out after inserts and removals."""
    return keyedlog.traverse(event_log(spark, sf_dir)).select("pos", "key", "seq", "value")


@query(f"WITH {_LOG}, {_LAST} SELECT key, octet_length(encode(value)) * 2 AS twice FROM last WHERE NOT tombstone")
def log_fold_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one's own over batches of the live keys."""

    def twice(batches):
        for batch in batches:
            yield batch.assign(twice=batch.value.str.encode("utf-8").str.len() * 2)[["key", "twice"]]

    return keyedlog.fold_with(event_log(spark, sf_dir), twice, "key string, twice bigint")


@query(f"WITH {_LOG}, {_LAST} SELECT key, value FROM last WHERE NOT tombstone AND key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')")
def map_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered map after the keys of a set were removed from it."""
    gone = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("key"))
    return keyedlog.snapshot(event_log(spark, sf_dir)).join(gone, "key", "left_anti").select("key", "value")


@query(
    "WITH a AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, lag(event_id) OVER w AS p, lead(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),"
    " held AS (SELECT a.seq, b.key, row_number() OVER (PARTITION BY a.seq ORDER BY b.seq DESC) AS place FROM a JOIN a b ON b.seq <= a.seq AND (b.f IS NULL OR b.f > a.seq)),"
    f" hits AS (SELECT a.seq, a.p IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM a b WHERE b.seq > a.p AND b.seq < a.seq) < {CAPACITY} AS hit FROM a)"
    f" SELECT h.seq, h.key AS evicted FROM held h JOIN hits USING (seq) WHERE NOT hit AND place = {CAPACITY + 1}"
)
def lru_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which key each miss drives out of a full cache."""
    return cache.replay(catalog._accesses(spark, sf_dir), CAPACITY).filter("evicted IS NOT NULL").select("seq", "evicted")


@query("SELECT event_id AS seq, event_id <> min(event_id) OVER (PARTITION BY user_id) AS hit FROM events")
def lru_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache without a limit: a key hits once it was used."""
    return cache.replay(catalog._accesses(spark, sf_dir), 0).select("seq", "hit")


@query(
    "WITH e AS (SELECT event_id AS seq, value, user_id AS key, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::UBIGINT % 16 AS BIGINT) AS shard, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),"
    f" h AS (SELECT a.shard, a.value, a.p IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM e b WHERE b.shard = a.shard AND b.seq > a.p AND b.seq < a.seq) < {CAPACITY} AS hit FROM e a)"
    " SELECT shard, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, quantile_cont(value, 0.99) FILTER (WHERE hit) AS read_p99, quantile_cont(value, 0.99) FILTER (WHERE NOT hit) AS write_p99 FROM h GROUP BY shard"
)
def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and 99th percentiles of the times of hits, which read, and misses, which write, by shard."""
    accesses = catalog._accesses(spark, sf_dir)
    replayed = cache.replay_sharded(accesses, placement.shard(F.col("key"), 16), CAPACITY)
    timed = replayed.join(load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    return cache.report(timed, "value", "shard")


@query(
    "WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_size AS v FROM part WHERE p_partkey <= 127),"
    " t AS (SELECT i, v, '' AS path FROM n WHERE i = 1 UNION ALL SELECT n.i, n.v, t.path || CASE WHEN n.i % 2 = 0 THEN '0' ELSE '2' END FROM t JOIN n ON n.i // 2 = t.i)"
    " SELECT row_number() OVER (ORDER BY path || '1') - 1 AS pos, v AS value FROM t"
)
def tree_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes of a binary tree of 127 nodes by in-order position."""
    part = ordered.numbered(load(spark, sf_dir, "part").filter("p_partkey <= 127"), [F.col("p_partkey")], "i", 1)
    node, parent = F.col("i"), F.when(F.col("i") > 1, F.expr("i div 2"))
    tree = part.select(F.lit("t").alias("tree"), node.alias("node_id"), parent.alias("parent_id"), F.when(F.col("i") % 2 == 0, "left").otherwise("right").alias("side"), F.col("p_size").alias("value"))
    return sequences.in_order(tree).select(F.col("pos").cast("bigint").alias("pos"), "value")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a simulation in the order in which they run."""
    return sequences.events_in_time(load(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "pos")


@query("WITH conv AS (SELECT conv_id, list(role ORDER BY turn, role) AS frames, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(sum(n) OVER (ORDER BY conv_id DESC) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY conv_id DESC) AS BIGINT) AS \"end\" FROM conv")
def flame_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations on a time axis, the last one first."""
    turns = load(spark, sf_dir, "conversations")
    frames = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return stacks.chart(turns.groupBy("conv_id").agg(frames.alias("frames"), F.count("*").alias("n")), "conv_id").select("conv_id", "start", "end")


def _digest(columns: list[str]) -> Column:
    return sequences.shuffle_key([F.col(c) for c in columns], 42)


@query("SELECT n_nationkey, row_number() OVER (ORDER BY md5('42|' || n_nationkey || '|' || n_name)) - 1 AS pos FROM nation")
def shuffle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their place in a seeded random order."""
    return ordered.numbered(load(spark, sf_dir, "nation"), [_digest(["n_nationkey", "n_name"])]).select("n_nationkey", "pos")


@query("SELECT 2 * c_custkey + k AS n FROM customer, range(2) t(k)")
def pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python generator that pulls rows and yields two for each."""

    def double(rows):
        for (n,) in rows:
            yield (2 * n,)
            yield (2 * n + 1,)

    return sequences.pull(load(spark, sf_dir, "customer").select("c_custkey"), double, "n bigint")


@query("SELECT n FROM range(2, 1002) t(n)")
def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator as a table function of SQL."""
    sequences.register_counter(spark)
    return spark.sql("SELECT n FROM counter_from(2, 1000)")
