"""Registered queries of the core operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import cents, extension, queue_position
from quarry.operators import aggregate, cache, keyedlog, membership, placement, sequences, shedder, stacks
from quarry.plans.dialect import Engine
from quarry.session import load, materialize, scratch_path
from quarry.sources import generators, text
from quarry.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Runs, index sparseness, cache capacity and file cap of the keyed-log and cache queries.
RUNS, EVERY, CAPACITY, CAP = 8, 16, 8, 4096
#: Keys of the Bloom queries and their false-positive rate.
BLOOM_FPR = 0.01
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL if there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _select(name: str, table: str, sql: str, oracle: str) -> None:
    """A query of one dialect statement over one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, strict=True).register(table, load(spark, sf_dir, table)).execute(sql)

    run.__name__ = name
    query(oracle)(run)


_select("sql_project", "customer", "SELECT c_name, c_custkey FROM customer", "SELECT c_name, c_custkey FROM customer")
_select("sql_filter_int", "nation", "SELECT n_name FROM nation WHERE n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2")
_select("sql_filter_text", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
_select("sql_and_neq", "customer", "SELECT c_name FROM customer WHERE c_mktsegment != 'BUILDING' AND c_nationkey = 3",
        "SELECT c_name FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey = 3")
_select("sql_or", "part", "SELECT p_partkey, p_size FROM part WHERE p_size = 7 OR p_brand = 'Brand#11'",
        "SELECT p_partkey, p_size FROM part WHERE p_size = 7 OR p_brand = 'Brand#11'")
_select("sql_int_add", "nation", "SELECT n_nationkey + 2, n_name FROM nation", "SELECT CAST(n_nationkey + 2 AS INTEGER) AS n_nationkey, n_name FROM nation")
_select("sql_int_wrap", "nation", "SELECT n_nationkey + 2147483647, n_name FROM nation",
        "SELECT CAST((n_nationkey::BIGINT + 2147483647 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS n_nationkey, n_name FROM nation")
_select("sql_text_concat", "nation", "SELECT n_nationkey, n_name + '!' FROM nation", "SELECT n_nationkey, n_name || '!' AS n_name FROM nation")
_select("sql_bool_column", "nation", "SELECT n_name, n_regionkey = 1 AS american FROM nation", "SELECT n_name, n_regionkey = 1 AS american FROM nation")
_select("sql_star", "region", "SELECT * FROM region", "SELECT * FROM region")


@query("SELECT * FROM (VALUES (3, 'Alice', 1), (2, 'Bob', 2), (1, 'Alice', 3), (3, 'Eva', 3)) t(id, name, step)")
def sql_ddl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script that creates, fills and selects; wrong inserts change nothing."""
    engine = Engine(spark, strict=True)
    engine.execute("CREATE TABLE users (id INT, name TEXT)")
    for row in ("(1, 'Alice')", "(2, 'Bob'), (3, 'Eva')"):
        engine.execute(f"INSERT INTO users VALUES {row}")
    for wrong in ("(1, 3)", "(1)"):
        try:
            engine.execute(f"INSERT INTO users VALUES {wrong}")
            raise AssertionError("a wrong row was taken")
        except ValueError:
            pass
    parts = [
        "SELECT id + 2 AS id, name, 1 AS step FROM users WHERE name = 'Alice'",
        "SELECT id, name, 2 AS step FROM users WHERE name != 'Alice' AND id = 2",
        "SELECT id, name, 3 AS step FROM users WHERE name = 'Alice' OR id = 3",
    ]
    found = [engine.execute(p) for p in parts]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 1 ORDER BY 1 LIMIT 10")
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dialect lacks goes to Spark SQL and is executed, not ignored."""
    engine = Engine(spark).register("orders", load(spark, sf_dir, "orders"))
    return engine.execute("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING count(*) > 1 ORDER BY 1 LIMIT 10")


# Keyed aggregation


def _stats_sql(source: str, key: str, value: str) -> str:
    total = f"sum(CAST(round({value} * 100) AS BIGINT))"
    return f"SELECT {key}, min({value}) AS min_value, round(CAST({total} AS DOUBLE) / count({value}) / 100, 4) AS mean_value, max({value}) AS max_value, count({value}) AS n FROM {source} GROUP BY {key} ORDER BY {key}"


@query(_stats_sql("events", "event_type", "value"))
def key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min, mean, max and count by event type."""
    return aggregate.key_stats(load(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT user_id, min(c) AS min_cents, max(c) AS max_cents, CAST(sum(c) AS BIGINT) AS sum_cents, count(c) AS n FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY user_id")
def key_stats_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in whole cents by user."""
    return aggregate.key_stats_fixed(load(spark, sf_dir, "events"), "user_id", "value")


@query(_stats_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice"))
def key_stats_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit partial statistics of eight parts, then their merge."""
    keys = ["l_returnflag", "l_linestatus"]
    parts = aggregate.partial_stats(load(spark, sf_dir, "lineitem"), F.pmod("l_orderkey", F.lit(8)), keys, "l_extendedprice")
    return aggregate.merge_stats(parts, keys)


@query(_stats_sql("(SELECT event_type AS key, value FROM events)", "key", "value"))
def key_stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key;value text written, read back in splits and aggregated."""
    path = scratch_path(spark, "measurements")
    text.write_measurements(load(spark, sf_dir, "events").select("event_type", F.col("value").cast("decimal(18,2)")), path)
    found = aggregate.key_stats(text.measurements(spark, path), "key", "value")
    return found.withColumns({c: F.col(c).cast("double") for c in ("min_value", "max_value", "mean_value")})


@query(
    "SELECT '{' || string_agg(event_type || '=' || lo || '/' || mid || '/' || hi, ',' ORDER BY event_type) || '}' AS report FROM ("
    "SELECT event_type, CAST(round(min(value), 1) AS DECIMAL(18,1))::VARCHAR AS lo, CAST(round(max(value), 1) AS DECIMAL(18,1))::VARCHAR AS hi,"
    " CAST(round(round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) / 100, 4), 1) AS DECIMAL(18,1))::VARCHAR AS mid FROM events GROUP BY event_type)"
)
def key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-line report."""
    return aggregate.report_line(key_stats(spark, sf_dir), "event_type")


@query("SELECT source, count(*) AS n, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS bytes, round(100.0 * sum(coalesce(octet_length(encode(text)), 0)) / sum(sum(coalesce(octet_length(encode(text)), 0))) OVER (), 2) AS percent FROM documents GROUP BY source")
def size_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, bytes and share of documents by source."""
    return aggregate.share(load(spark, sf_dir, "documents"), "source", F.octet_length("text"))


@query("SELECT list_extract(string_split(url, '.'), -1) AS ext, count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, round(100.0 * sum(octet_length(encode(html))) / sum(sum(octet_length(encode(html)))) OVER (), 2) AS percent FROM pages GROUP BY 1")
def ext_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages by what follows the last dot of their address."""
    return aggregate.share(load(spark, sf_dir, "pages").withColumn("ext", extension(F.col("url"))), "ext", F.octet_length("html"))


# Keyed log


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: user by event number; an error deletes."""
    events = load(spark, sf_dir, "events")
    log = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tombstone"))
    return keyedlog.with_runs(log, RUNS)


_LOG = (
    "log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, props AS value, event_type = 'error' AS tombstone,"
    f" event_id // (SELECT greatest(1, CAST(ceil(count(*) / {RUNS}.0) AS BIGINT)) FROM events) AS run_id FROM events)"
)
_LAST = "last AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log GROUP BY key)"
_RUNS = "runs AS (SELECT run_id, key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log GROUP BY run_id, key)"
_SIZE = "(16 + octet_length(encode(key)) + octet_length(encode(value)))"


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value FROM last WHERE NOT tombstone")
def log_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys."""
    return keyedlog.snapshot(event_log(spark, sf_dir))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer numbers as keys; most are missing."""
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


_PROBES = "probes AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer)"


@query(f"WITH {_LOG}, {_LAST}, {_PROBES} SELECT p.key, coalesce(l.value, '') AS value, l.key IS NOT NULL AS found FROM probes p LEFT JOIN (SELECT * FROM last WHERE NOT tombstone) l ON p.key = l.key")
def log_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups; missing and deleted keys are empty."""
    return keyedlog.get(event_log(spark, sf_dir), _probes(spark, sf_dir))


@query(f"WITH {_LOG}, {_LAST} SELECT count(*) AS n_keys, CAST(coalesce(sum(octet_length(encode(value))), 0) AS BIGINT) AS n_bytes FROM last WHERE NOT tombstone")
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys and bytes."""
    return keyedlog.fold(event_log(spark, sf_dir))


@query(f"WITH {_LOG}, w AS (SELECT *, lag(value) OVER o AS v, lag(tombstone) OVER o AS t FROM log WINDOW o AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, CASE WHEN t = FALSE THEN octet_length(encode(v)) + 16 ELSE 0 END AS n_bytes FROM w WHERE tombstone")
def log_delete_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each delete gives back."""
    return keyedlog.deleted_bytes(event_log(spark, sf_dir))


@query(
    f"WITH {_LOG}, s AS (SELECT *, {_SIZE} AS n_bytes FROM log), o AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s)"
    " SELECT run_id, seq, key, CAST(a AS BIGINT) AS record_offset, CAST(a + 16 AS BIGINT) AS value_offset, octet_length(encode(value)) AS value_size, n_bytes FROM o"
)
def log_file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of each run's file, written and read without the values."""
    return keyedlog.hint(spark, event_log(spark, sf_dir))


@query(
    f"WITH RECURSIVE {_LOG}, s AS (SELECT seq, key, {_SIZE} AS n_bytes FROM log), r AS ("
    "SELECT seq, key, n_bytes, 0::BIGINT AS file_id, 0::BIGINT AS file_offset FROM s WHERE seq = 0 UNION ALL"
    f" SELECT s.seq, s.key, s.n_bytes, CASE WHEN r.file_offset + r.n_bytes + s.n_bytes > {CAP} THEN r.file_id + 1 ELSE r.file_id END,"
    f" CASE WHEN r.file_offset + r.n_bytes + s.n_bytes > {CAP} THEN 0 ELSE r.file_offset + r.n_bytes END FROM r JOIN s ON s.seq = r.seq + 1) SELECT seq, key, n_bytes, file_id, file_offset FROM r"
)
def log_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by greedy packing."""
    return keyedlog.rotate(event_log(spark, sf_dir), CAP).drop("writer")


@query(f"WITH {_LOG}, {_RUNS} SELECT run_id, count(*) AS items, CAST(sum({_SIZE}) AS BIGINT) AS n_bytes, count(*) FILTER (WHERE tombstone) AS tombstones FROM runs GROUP BY run_id")
def lsm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and bytes of the sorted runs."""
    return keyedlog.run_summary(event_log(spark, sf_dir))


@query(
    f"WITH {_LOG}, {_RUNS}, {_PROBES}, newest AS (SELECT key, max(run_id) AS run_id, arg_max(value, run_id) AS value, arg_max(tombstone, run_id) AS tombstone FROM runs GROUP BY key)"
    " SELECT p.key, coalesce(n.value, '') AS value, coalesce(n.run_id, -1) AS run_id FROM probes p LEFT JOIN (SELECT * FROM newest WHERE NOT tombstone) n ON p.key = n.key"
)
def lsm_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups over all runs, the newest first."""
    return keyedlog.multi_get(keyedlog.runs(event_log(spark, sf_dir)), _probes(spark, sf_dir))


@query(f"WITH {_LOG}, {_RUNS} SELECT key, arg_max(value, run_id) AS value, arg_max(tombstone, run_id) AS tombstone, max(run_id) AS run_id FROM runs GROUP BY key")
def lsm_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written to a store, read back and merged to one, deletes kept."""
    path = scratch_path(spark, "store")
    keyedlog.write_runs(event_log(spark, sf_dir), path)
    return keyedlog.compact(keyedlog.read_runs(spark, path))


_INDEX = (
    f"places AS (SELECT run_id, key, row_number() OVER o - 1 AS rn, coalesce(sum({_SIZE}) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a"
    f" FROM runs WINDOW o AS (PARTITION BY run_id ORDER BY key)), idx AS (SELECT run_id, rn // {EVERY} AS block, key, CAST(a AS BIGINT) AS file_offset FROM places WHERE rn % {EVERY} = 0)"
)


@query(f"WITH {_LOG}, {_RUNS}, {_INDEX} SELECT * FROM idx")
def lsm_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixteenth key of each run with its offset."""
    return keyedlog.sparse_index(keyedlog.runs(event_log(spark, sf_dir)), EVERY)


@query(
    f"WITH {_LOG}, {_RUNS}, {_INDEX}, asked AS (SELECT run_id, p.key FROM (SELECT DISTINCT run_id FROM runs), (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer) p)"
    " SELECT a.run_id, a.key, coalesce(i.block, 0) AS block FROM asked a ASOF LEFT JOIN idx i ON i.run_id = a.run_id AND i.key <= a.key"
)
def lsm_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of each run that a probed key would be in."""
    index = keyedlog.sparse_index(keyedlog.runs(event_log(spark, sf_dir)), EVERY)
    probes = _probes(spark, sf_dir).select("key", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run_id"))
    return keyedlog.range_lookup(index, probes.select(F.col("run_id").cast("bigint"), "key"))


# Membership and placement


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Even customer numbers, the bits of a filter sized for them, and its k and m."""
    keys = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"))
    return keys, *membership.build(keys, "key", BLOOM_FPR)


_POSITIONS = "(('0x' || substr(md5(CAST(key AS VARCHAR)), 1, 8))::UBIGINT::BIGINT + i * ('0x' || substr(md5(CAST(key AS VARCHAR)), 9, 8))::UBIGINT::BIGINT) % m"
_BLOOM = (
    "members AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0),"
    f" bits_of AS (SELECT n, CAST(ceil(-n * ln({BLOOM_FPR}) / (ln(2) * ln(2))) AS BIGINT) AS m FROM (SELECT greatest(1, count(*)) AS n FROM members)),"
    " size AS (SELECT m, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)) AS k FROM bits_of),"
    f" bits AS (SELECT DISTINCT {_POSITIONS} AS position FROM (SELECT key, m, unnest(range(k)) AS i FROM members, size)),"
    " asked AS (SELECT DISTINCT o_custkey AS key FROM orders),"
    f" places AS (SELECT DISTINCT key, {_POSITIONS} AS position FROM (SELECT key, m, unnest(range(k)) AS i FROM asked, size)),"
    " probed AS (SELECT key, bool_and(b.position IS NOT NULL) AS hit FROM places p LEFT JOIN bits b USING (position) GROUP BY key)"
)


@query(f"WITH {_BLOOM} SELECT position FROM bits")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set bits of a filter over even customer numbers, sized by their count."""
    return _members(spark, sf_dir)[1]


@query(f"WITH {_BLOOM} SELECT key, hit FROM probed")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders against the filter, saved and read back."""
    _, bits, k, m = _members(spark, sf_dir)
    saved = spark.read.parquet(membership.save(bits))
    return membership.probe(saved, load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key", k, m)


@query(f"WITH {_BLOOM} SELECT count(*) FILTER (WHERE key % 2 = 0) AS n_members, count(*) FILTER (WHERE key % 2 = 0 AND hit) AS n_members_hit, count(*) FILTER (WHERE key % 2 <> 0) AS n_others, count(*) FILTER (WHERE key % 2 <> 0 AND hit) AS n_false FROM probed")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits among members and others."""
    return membership.false_positive_rate(bloom_probe(spark, sf_dir), _members(spark, sf_dir)[0], "key")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def semi_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact semi join that a filter approximates."""
    members = load(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(members, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not in a set."""
    gone = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::UBIGINT % 16 AS BIGINT) AS shard, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses and keys by hash shard; keys are counted once before shards are."""
    by_key = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("c"))
    return by_key.groupBy(placement.shard(F.col("user_id"), 16).alias("shard")).agg(F.sum("c").alias("n"), F.count("*").alias("n_keys"))


def _jump_sql(n: int) -> str:
    return (
        f"j{n} AS (SELECT c_custkey, c_custkey::HUGEINT AS s, 0::BIGINT AS place, 0::BIGINT AS ahead FROM customer UNION ALL"
        f" SELECT c_custkey, (s * 2862933555777941757 + 1) % 18446744073709551616, ahead,"
        f" CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / (((s * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE)) AS BIGINT) FROM j{n} WHERE ahead < {n}),"
        f" b{n} AS (SELECT c_custkey, max(place) AS bucket FROM j{n} GROUP BY c_custkey)"
    )


@query(f"WITH RECURSIVE {_jump_sql(16)} SELECT c_custkey, bucket FROM b16")
def jump_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump-hash bucket of each customer among sixteen."""
    return load(spark, sf_dir, "customer").select("c_custkey", placement.jump_hash(F.col("c_custkey"), 16).alias("bucket"))


@query(f"WITH RECURSIVE {_jump_sql(16)}, {_jump_sql(17)} SELECT count(*) AS n_keys, count(*) FILTER (WHERE b16.bucket <> b17.bucket) AS n_moved, count(*) FILTER (WHERE b16.bucket <> b17.bucket AND b17.bucket = 16) AS n_to_new FROM b16 JOIN b17 USING (c_custkey)")
def jump_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that move when a seventeenth bucket comes."""
    return placement.moved(load(spark, sf_dir, "customer"), "c_custkey", 16)


# Caches


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"))


@query(
    "WITH a AS (SELECT event_id AS seq, user_id AS key, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),"
    f" h AS (SELECT a.seq, a.key, a.p, a.p IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM a b WHERE b.seq > a.p AND b.seq < a.seq) < {CAPACITY} AS hit FROM a)"
    " SELECT seq, CAST(key AS VARCHAR) AS key, hit FROM h"
)
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache of eight keys, replayed by chunks."""
    return cache.replay(_accesses(spark, sf_dir), CAPACITY).select("seq", "key", "hit")


@query(
    "WITH e AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8))::UBIGINT % 16 AS BIGINT) AS shard FROM events),"
    " a AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p FROM e),"
    f" h AS (SELECT shard, p IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM a b WHERE b.shard = a.shard AND b.seq > a.p AND b.seq < a.seq) < {CAPACITY} AS hit FROM a)"
    " SELECT shard, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate FROM h GROUP BY shard"
)
def lru_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit statistics of sixteen shards of eight keys."""
    return cache.statistics(cache.replay_sharded(_accesses(spark, sf_dir), placement.shard(F.col("key"), 16), CAPACITY), "shard")


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS seq FROM events GROUP BY user_id ORDER BY 2 DESC LIMIT 10")
def lru_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keys used last."""
    return cache.head(_accesses(spark, sf_dir), 10)


@query("SELECT user_id AS key, max(ts) AS written_at FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys not written for an hour at the end."""
    events = load(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    return cache.expired(events.select(F.col("user_id").alias("key"), F.col("ts").alias("written_at")), F.lit(now).cast("timestamp_ntz"), "1 HOUR")


# Load shedding


def _priority() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")).cast("int") - 1


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: seq, ts, pos from event type and user."""
    pos = queue_position(_priority(), F.pmod("user_id", F.lit(128)))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", "value", pos.cast("int").alias("pos"))


_TYPES = "['click', 'error', 'purchase', 'signup', 'view']"
_MSG = f"msg AS (SELECT event_id AS seq, ts, value, CAST((list_position({_TYPES}, event_type) - 1) * 128 + user_id % 128 AS INTEGER) AS pos FROM events)"
_SHED = f"{_MSG}, shed AS (SELECT seq, ts, pos, quantile_cont(pos::DOUBLE, 0.3) OVER (ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS threshold FROM msg)"


@query(f"WITH {_SHED} SELECT seq, pos, round(threshold, 6) AS threshold, pos > threshold AS admitted FROM shed")
def shed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling 0.3-percentile of the last 1,000 positions and who passes it."""
    found = shedder.thresholds(_messages(spark, sf_dir), 0.3)
    return found.select("seq", "pos", F.round("threshold", 6).alias("threshold"), "admitted")


@query(f"WITH {_SHED} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS tick, count(*) AS n_in, count(*) FILTER (WHERE pos > threshold) AS n_out, count(*) FILTER (WHERE NOT pos > threshold) AS n_rejected FROM shed GROUP BY 1")
def shed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, admissions and rejections by day."""
    return shedder.ticks(shedder.thresholds(_messages(spark, sf_dir), 0.3), "1 day")


@query(
    f"WITH {_SHED}, t AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS tick, count(*) AS n_in, count(*) FILTER (WHERE pos > threshold) AS n_out FROM shed GROUP BY 1),"
    " e AS (SELECT *, (n_in - n_out - 10)::DOUBLE / CASE WHEN n_out = 0 THEN 10 ELSE n_out END AS err FROM t),"
    " s AS (SELECT *, sum(err) OVER (ORDER BY tick ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS err_sum FROM e)"
    " SELECT tick, n_in, n_out, round(err, 6) AS err, round(err_sum, 6) AS err_sum, round(least(0.999999, greatest(0, 1 - exp(-0.1 * err - 1.4 * err_sum))), 6) AS ratio FROM s"
)
def shed_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-loop control ratio by hour."""
    counts = shedder.ticks(shedder.thresholds(_messages(spark, sf_dir), 0.3), "1 hour")
    return shedder.pid(counts, 10).select("tick", "n_in", "n_out", *[F.round(c, 6).alias(c) for c in ("err", "err_sum", "ratio")])


@query()
def shed_closed_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control loop closed over the hours."""
    tick = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return shedder.closed_loop(_messages(spark, sf_dir), 10, tick)


@query(f"WITH {_MSG}, r AS (SELECT seq, pos, CAST(date_trunc('day', ts) AS TIMESTAMP) AS grp, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY pos, seq) AS rank FROM msg) SELECT seq, pos, grp, rank FROM r WHERE rank <= 20")
def shed_queue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty messages that each day's queue hands out first."""
    return shedder.top_positions(_messages(spark, sf_dir), F.date_trunc("day", "ts").cast("timestamp_ntz"), 20).select("seq", "pos", "grp", "rank")


@query(
    "WITH c AS (SELECT ts AS t, 1 AS d FROM events UNION ALL SELECT ts + to_seconds(CAST(ceil(value) AS BIGINT)) AS t, -1 AS d FROM events), n AS (SELECT t, sum(d) AS d FROM c GROUP BY t)"
    " SELECT t AS moment, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS n_running FROM n"
)
def shed_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in flight over time, each as many seconds as its value."""
    end = F.col("ts") + F.make_dt_interval(secs=F.ceil("value").cast("decimal(18,6)"))
    return shedder.inflight(load(spark, sf_dir, "events"), F.col("ts"), end, F.date_trunc("day", "at")).withColumnRenamed("at", "moment")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, quantile_cont(value, 0.9) AS p90, count(*) AS n, min(value) AS least FROM events GROUP BY 1")
def latency_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 90th percentile by day."""
    rows = load(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return shedder.latency_quantile(rows, ["day"], "value", 0.9).withColumnRenamed("quantile", "p90")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, quantile_disc(value, 0.9) AS p90, count(*) AS n, min(value) AS least FROM events GROUP BY 1")
def latency_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentile that is one of the values, exact: a sketch of bounded size says between which two it lies."""
    rows = load(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return shedder.sketched_quantile(rows, ["day"], "value", 0.9, accuracy=10_000).withColumnRenamed("quantile", "p90")


@query(
    "WITH q AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, quantile_cont(value, 0.9) AS p90, count(*) AS n FROM events GROUP BY 1)"
    " SELECT hour, p90, round(covar_samp(n / p90, p90) OVER (ORDER BY hour ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS cov FROM q"
)
def latency_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of latency and throughput over the last fifty hours."""
    rows = load(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    found = shedder.latency_quantile(rows, ["hour"], "value", 0.9).withColumn("rate", F.col("n") / F.col("quantile"))
    return shedder.rolling_covariance(found, "hour", "quantile", "rate").select("hour", F.col("quantile").alias("p90"), F.round("cov", 6).alias("cov"))


@query(
    "WITH RECURSIVE m AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS DOUBLE) AS t, value FROM events),"
    " r AS (SELECT seq, t, value, 0::BIGINT AS number, 1::BIGINT AS n, t AS began FROM m WHERE seq = 0 UNION ALL"
    "  SELECT m.seq, m.t, m.value, CASE WHEN r.n > 250 AND r.t - r.began > 3 THEN r.number + 1 ELSE r.number END,"
    "   CASE WHEN r.n > 250 AND r.t - r.began > 3 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n > 250 AND r.t - r.began > 3 THEN m.t ELSE r.began END FROM r JOIN m ON m.seq = r.seq + 1),"
    " q AS (SELECT number, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.5) AS p50, min(value) AS least, count(*) AS n FROM r GROUP BY number),"
    " c AS (SELECT *, covar_samp(n / p90, p90) OVER (ORDER BY number ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS cov, p50 / nullif(least, 0) AS slow FROM q),"
    " l AS (SELECT -1::BIGINT AS number, 50::BIGINT AS lim UNION ALL"
    "  SELECT number, greatest(10, mid + CASE WHEN slow < -2 * log10(mid / 100.0) THEN 1 WHEN slow > -4 * log10(mid / 100.0) THEN -1 ELSE 0 END)"
    "  FROM (SELECT c.number, c.slow, CASE WHEN c.cov < 0 THEN greatest(10, l.lim - 1) ELSE l.lim END AS mid FROM l JOIN c ON c.number = l.number + 1))"
    ' SELECT number AS "interval", p90, p50, least, n, lim AS "limit" FROM q JOIN l USING (number)'
)
def latency_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals closed by count and time, their 90th percentile, and the limit that a tuner sets after each."""
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("latency"))
    dealt = shedder.close_intervals(rows)
    found = materialize(dealt.groupBy("lane", "interval").agg(F.percentile("latency", F.lit(0.9)).alias("p90"), F.percentile("latency", F.lit(0.5)).alias("p50"), F.min("latency").alias("least"), F.count("*").alias("n")), "intervals")
    history = shedder.rolling_covariance(found.withColumn("rate", F.col("n") / F.col("p90")), "interval", "p90", "rate", lane="lane")
    tuned = shedder.tune(history.select("lane", "interval", "cov", (F.col("p50") / F.nullif("least", F.lit(0.0))).alias("slowdown")), 50)
    return found.join(tuned, ["lane", "interval"]).drop("lane")


# Streams


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS tick, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_slow FROM events GROUP BY 1, 2")
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters of a file stream in complete mode."""
    stream = pipelines.file_stream(spark, f"{sf_dir}/events.parquet")
    counts = {"n": F.count("*"), "n_slow": F.count_if(F.col("value") > 50)}
    found = pipelines.drain(pipelines.tumbling_counts(stream, "ts", "1 day", counts, by=["event_type"]), "complete", "report")
    return found.withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query(f"WITH {_LOG}, {_LAST} SELECT key, seq, value, tombstone FROM last")
def stream_keyed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upserts from a file stream: micro-batches become runs, the newest row of a key wins."""
    stream = pipelines.file_stream(spark, f"{sf_dir}/events.parquet")
    log = stream.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("tombstone"))
    return pipelines.upsert_runs(log)


# Stacks and sequences


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of roles of each conversation as a stack."""
    turns = load(spark, sf_dir, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return stacks.collapse(turns.groupBy("conv_id").agg(ordered.alias("frames")).withColumn("n", F.lit(1).cast("bigint")))


_FOLDED = "conv AS (SELECT conv_id, list(role ORDER BY turn, role) AS frames FROM conversations GROUP BY conv_id), folded AS (SELECT frames, count(*) AS n FROM conv GROUP BY frames)"
_NODES = (
    f"{_FOLDED}, lay AS (SELECT frames, n, sum(n) OVER (ORDER BY frames) - n AS a, sum(n) OVER (ORDER BY frames) AS b FROM folded),"
    " spread AS (SELECT list_slice(frames, 1, k) AS path, n, a, b FROM (SELECT *, unnest(range(len(frames) + 1)) AS k FROM lay)),"
    " nodes AS (SELECT path, len(path) AS depth, sum(n) AS value, min(a) AS start, max(b) AS \"end\" FROM spread GROUP BY path)"
)
_ROLES = "array_to_string(path, ';')"


def _shown(tree: DataFrame, *columns: str) -> DataFrame:
    return tree.select(F.array_join("path", ";").alias("path"), *columns)


@query(f"WITH {_FOLDED} SELECT array_to_string(list_reverse(frames), ';') AS stack, n FROM folded")
def stack_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of folded stacks, leaf last, from samples and a table of names."""
    folded = _folded(spark, sf_dir)
    names = spark.createDataFrame([("none", "nobody")], "id string, name string")
    found = stacks.resolve(folded.withColumnRenamed("frames", "loc_ids"), names)
    return found.select(F.array_join("frames", ";").alias("stack"), "n")


@query(
    f"WITH {_FOLDED}, l AS (SELECT frames, n, lag(frames) OVER (ORDER BY frames) AS b FROM folded)"
    " SELECT array_to_string(frames, ';') AS path, n, CAST((SELECT count(*) FROM range(1, len(frames) + 1) t(k) WHERE list_slice(frames, 1, k) = list_slice(b, 1, k) AND k <= len(b)) AS INTEGER) AS shared FROM l"
)
def stack_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading frames that each stack shares with the one before it."""
    found = stacks.common_prefix(_folded(spark, sf_dir))
    return found.select(F.array_join("frames", ";").alias("path"), "n", "shared")


@query(f"WITH {_NODES} SELECT {_ROLES} AS path, depth, CAST(value AS BIGINT) AS value, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", round(100.0 * value / (SELECT sum(n) FROM folded), 2) AS percent FROM nodes")
def flame_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes as nodes on one axis."""
    return _shown(stacks.nodes(_folded(spark, sf_dir)), "depth", "value", "start", "end", "percent")


@query(f"WITH {_NODES} SELECT {_ROLES} AS path, CAST(value AS BIGINT) AS value FROM nodes WHERE \"end\" - start >= (SELECT max(\"end\") FROM nodes) * 5.0 / 100")
def flame_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of at least five percent."""
    return _shown(stacks.prune(stacks.nodes(_folded(spark, sf_dir)), percent=5.0), "value")


@query(
    "WITH conv AS (SELECT conv_id, list(role ORDER BY turn, role) AS frames FROM conversations GROUP BY conv_id)"
    " SELECT array_to_string(frames, ';') AS path, count(*) FILTER (WHERE conv_id % 2 = 1) - count(*) FILTER (WHERE conv_id % 2 = 0) AS delta FROM conv GROUP BY frames"
)
def flame_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd less even conversations by stack."""
    turns = load(spark, sf_dir, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = turns.groupBy("conv_id").agg(ordered.alias("frames"))
    pairs = rows.groupBy("frames").agg(F.count_if(F.col("conv_id") % 2 == 0).alias("n1"), F.count_if(F.col("conv_id") % 2 == 1).alias("n2"))
    return _shown(stacks.differences(pairs), "delta")


@query(
    f"WITH {_NODES}, hit AS (SELECT * FROM nodes WHERE len(path) > 0 AND regexp_matches(path[-1], '^assist')),"
    " top AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit u WHERE len(u.path) < len(h.path) AND list_slice(h.path, 1, len(u.path)) = u.path))"
    " SELECT round(100.0 * coalesce(sum(\"end\" - start), 0) / (SELECT max(\"end\") FROM nodes), 2) AS percent FROM top"
)
def flame_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the axis under matching frames."""
    return stacks.matched_share(stacks.nodes(_folded(spark, sf_dir)), "^assist")


@query(f"WITH {_NODES} SELECT {_ROLES} AS path, CAST(value AS BIGINT) AS value FROM nodes WHERE list_slice(path, 1, 2) = ['user', 'assistant'] OR path IN ([], ['user'])")
def flame_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node, what is above and what is below it."""
    return _shown(stacks.zoom(stacks.nodes(_folded(spark, sf_dir)), ["user", "assistant"]), "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type")
def exec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions by name."""
    return sequences.executions(load(spark, sf_dir, "events"), "event_type")


@query("SELECT n FROM range(2, 2000) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(p) WHERE p * p <= n AND n % p = 0) ORDER BY n LIMIT 200")
def primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two hundred primes."""
    return sequences.primes(spark, 200)


@query("SELECT count(*) = (SELECT count(*) FROM part) AS same, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS v FROM part) a JOIN (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS v FROM part) b USING (i, v)")
def same_fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether parts and shuffled parts have the same keys in order."""
    part = load(spark, sf_dir, "part").select("p_partkey")
    return sequences.same_sequence(part, sequences.shuffled(part, 7), [F.col("p_partkey")], [F.col("p_partkey")], "p_partkey")


@query()
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a seeded random order."""
    return sequences.shuffled(load(spark, sf_dir, "nation"), 42)


@query()
def gen_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of ten thousand generated measurements, named after the 25 nations."""
    names = [r.n_name for r in load(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    return aggregate.key_stats(generators.measurements(spark, 10_000, names), "key", "value")


@query("SELECT cents, n, CAST(sum(n) OVER (ORDER BY cents) AS BIGINT) AS running FROM (SELECT CAST(round(value * 100) AS BIGINT) AS cents, count(*) AS n FROM events GROUP BY 1)")
def running_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts of values, summed by bucket before they are accumulated."""
    from quarry.operators.ordered import prefix_sum

    rows = load(spark, sf_dir, "events").groupBy(cents(F.col("value")).alias("cents")).agg(F.count("*").alias("n"))
    return prefix_sum(rows.withColumn("bucket", F.expr("cents div 1000")), "bucket", ["cents"], "n", "running").drop("bucket")


from quarry.plans import formats, machines  # noqa: E402, F401  they register their queries here
