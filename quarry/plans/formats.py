"""Registered queries of sources, sinks and text formats, with DuckDB SQL."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import keyedlog, placement, sequences, stacks
from quarry.plans import catalog
from quarry.plans.catalog import EVERY, _FOLDED, _INDEX, _LAST, _LOG, _NODES, _ROLES, _RUNS, _SIZE, event_log, query
from quarry.plans.dialect import DialectError, Engine, render, run_script
from quarry.session import load, scratch_path
from quarry.sources import binarylog, generators, text

SCRIPT = (
    "CREATE TABLE users (id INT, name TEXT)", "INSERT INTO users VALUES (1, 'Alice')", "INSERT INTO users VALUES (2, 'Bob')", "INSERT INTO users VALUES (1, 3, 'Alice')",
    "INSERT INTO users VALUES (1)", "", "SELECT id, name FROM users WHERE name != 'Alice'", "SELECT name FROM missing", "SELECT name FROM users",
)


@query("SELECT * FROM (VALUES (0, 'ok', 0), (1, 'ok', 0), (2, 'ok', 0), (3, 'error', 0), (4, 'error', 0), (5, 'rows', 1), (6, 'error', 0), (7, 'rows', 2)) t(statement, outcome, n)")
def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of a statement a line, as from a file or standard input: errors are reported and the rest goes on."""
    results = run_script(Engine(spark, strict=True), io.StringIO("\n".join(SCRIPT)), out=io.StringIO())
    rows = [(k, "ok" if r is None else "error" if isinstance(r, DialectError) else "rows", r.count() if isinstance(r, DataFrame) else 0) for k, r in enumerate(results)]
    return spark.createDataFrame(rows, "statement int, outcome string, n int")


#: What the strict dialect refuses.
REFUSED = (
    "SELECT n_name FROM nation WHERE n_nationkey < 3", "SELECT n_name FROM nation WHERE n_name LIKE 'A%'", "SELECT n_nationkey - 1 FROM nation", "SELECT n_nationkey * 2 FROM nation",
    "SELECT n_nationkey / 2 FROM nation", "SELECT n_name FROM nation WHERE (n_nationkey = 1)", "SELECT n_name FROM nation WHERE NOT n_nationkey = 1",
    "SELECT n_name FROM nation WHERE n_name IS NULL", "SELECT upper(n_name) FROM nation", "SELECT n_name + 1 FROM nation", "SELECT n_name FROM nation WHERE n_name = 1", "SELECT n_name FROM nation WHERE n_nationkey",
)


@query(f"SELECT statement, TRUE AS refused FROM range({len(REFUSED)}) t(statement)")
def sql_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators, functions and mixed types that the strict dialect refuses when it reads them, not when rows come."""
    engine = Engine(spark, strict=True).register("nation", load(spark, sf_dir, "nation"))

    def refused(statement: str) -> bool:
        try:
            engine.execute(statement)
        except DialectError:
            return True
        return False

    return spark.createDataFrame([(k, refused(s)) for k, s in enumerate(REFUSED)], "statement bigint, refused boolean")


@query("SELECT n_name FROM nation WHERE n_nationkey < 3 AND NOT (n_name LIKE 'A%' OR n_name IS NULL)")
def sql_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict dialect refuses is Spark SQL in the superset."""
    return Engine(spark).register("nation", load(spark, sf_dir, "nation")).execute("SELECT n_name FROM nation WHERE n_nationkey < 3 AND NOT (n_name LIKE 'A%' OR n_name IS NULL)")


@query(
    "SELECT rtrim(rpad('r_regionkey', w1, ' ') || ' | ' || rpad('r_name', w2, ' ')) || chr(10) || repeat('-', w1) || '-+-' || repeat('-', w2) || chr(10)"
    " || (SELECT string_agg(rtrim(rpad(CAST(r_regionkey AS VARCHAR), w1, ' ') || ' | ' || r_name), chr(10) ORDER BY r_regionkey) FROM region) AS shown"
    " FROM (SELECT CAST(greatest(11, max(length(CAST(r_regionkey AS VARCHAR)))) AS INTEGER) AS w1, CAST(greatest(6, max(length(r_name))) AS INTEGER) AS w2 FROM region)"
)
def sql_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as a text table."""
    shown = Engine(spark, strict=True).register("region", load(spark, sf_dir, "region").orderBy("r_regionkey")).execute("SELECT r_regionkey, r_name FROM region")
    return spark.createDataFrame([(render(shown),)], "shown string")


@query(
    f"WITH {_LOG}, s AS (SELECT *, {_SIZE} AS n FROM log) SELECT run_id AS file_id, CAST(sum(n) OVER (PARTITION BY run_id ORDER BY seq) - n AS BIGINT) AS file_offset,"
    " seq AS ts, key, value FROM s"
)
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as binary files of records with a header, and the records with their offsets decoded from them."""
    found = binarylog.unpack(binarylog.pack(event_log(spark, sf_dir)))
    return found.select("file_id", "file_offset", "ts", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_PLACED = (
    f"placed AS (SELECT run_id, key, value, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS rn,"
    f" CAST(sum({_SIZE}) OVER (PARTITION BY run_id ORDER BY key) - {_SIZE} AS BIGINT) AS file_offset FROM runs)"
)


@query(f"WITH {_LOG}, {_RUNS}, {_PLACED} SELECT run_id, file_offset, key, value FROM placed WHERE rn // {EVERY} = 1")
def lsm_read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second block of each sorted run's file, read by the offsets of its sparse index; sizes are varints."""
    runs = keyedlog.runs(event_log(spark, sf_dir))
    index = keyedlog.sparse_index(runs, EVERY).filter("block IN (1, 2)").groupBy("run_id")
    blocks = index.agg(F.max(F.when(F.col("block") == 1, F.col("file_offset"))).alias("start"), F.max(F.when(F.col("block") == 2, F.col("file_offset"))).alias("stop"))
    return binarylog.read_blocks(binarylog.pack(runs, sorted_run=True), blocks.filter("start IS NOT NULL"))


@query("SELECT * FROM (VALUES ('1', 'a-1.csv', 1), ('2', 'b-2.csv', 2), ('10', 'c-10.csv', 10)) t(id, name, file_id)")
def file_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the number in their name, as numbers."""
    names = spark.createDataFrame([("1", "a-1.csv"), ("2", "b-2.csv"), ("10", "c-10.csv")], "id string, name string")
    return names.withColumn("file_id", text.file_number(F.col("name")).cast("int"))


_UNIFORM = "CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496"


@query(
    "WITH names AS (SELECT list(DISTINCT n_name ORDER BY n_name) AS x FROM nation),"
    f" m AS (SELECT x[CAST(floor({_UNIFORM.format(seed=42, key='id')} * len(x)) AS INTEGER) + 1] AS key, (CAST(floor({_UNIFORM.format(seed=43, key='id')} * 1999) AS BIGINT) - 999) AS tenths FROM range(10000) t(id), names)"
    " SELECT key, CAST(min(tenths) / 10.0 AS DOUBLE) AS min_value, CAST(max(tenths) / 10.0 AS DOUBLE) AS max_value, count(*) AS n, CAST(sum(tenths) AS BIGINT) AS tenths FROM m GROUP BY key"
)
def gen_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand generated measurements by station."""
    names = [r.n_name for r in load(spark, sf_dir, "nation").select("n_name").distinct().collect()]
    rows = generators.measurements(spark, 10_000, names).withColumn("value", F.col("value").cast("double"))
    return rows.groupBy("key").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10).cast("bigint")).alias("tenths"))


@query(
    f"WITH r AS (SELECT id, floor(pow({_UNIFORM.format(seed=42, key='id')} * (pow(101.0, 0.5) - 1) + 1, 2.0)) AS rank FROM range(20000) t(id))"
    f" SELECT CAST(floor({_UNIFORM.format(seed=43, key='CAST(least(rank, 100) AS BIGINT)')} * 100) AS BIGINT) AS key, count(*) AS n FROM r GROUP BY 1"
)
def gen_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrambled Zipf keys by how often they come."""
    return generators.zipf_keys(spark, 20_000, 100, exponent=0.5).groupBy("key").agg(F.count("*").alias("n"))


@query(
    f"SELECT CAST(floor({_UNIFORM.format(seed=42, key='id')} * 6) AS INTEGER) AS priority, CAST(floor({_UNIFORM.format(seed=43, key='id')} * 128) AS INTEGER) AS cohort, count(*) AS n, max(id / 250.0::DOUBLE) AS last_at FROM range(20000) t(id) GROUP BY 1, 2"
)
def gen_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages at 250 a second by priority and cohort."""
    return generators.messages(spark, 20_000, 250.0).groupBy("priority", "cohort").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


_NORMAL = f"sqrt(-2 * ln(1 - {_UNIFORM.format(seed=7, key="event_id || '|u'")})) * cos(2 * pi() * ({_UNIFORM.format(seed=7, key="event_id || '|v'")}))"


@query(f"SELECT event_id, round(greatest(0.0, 0.1 + 0.05 * ({_NORMAL})) + exp((user_id % 32) / 10.0) / 1000, 6) AS latency FROM events")
def latency_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelled service times: a normal base and a part that grows with what is in flight."""
    latency = scalars.service_time(generators.normal(7, F.col("event_id")), F.pmod("user_id", F.lit(32)))
    return load(spark, sf_dir, "events").select("event_id", F.round(latency, 6).alias("latency"))


# Text formats


@query(f"WITH {_FOLDED} SELECT array_to_string(frames, ';') AS stack, CAST(n AS DOUBLE) AS n1, CAST(n * 2 AS DOUBLE) AS n2, FALSE AS ignored FROM folded UNION ALL SELECT '', NULL, NULL, TRUE")
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded stacks with two counts, written as lines and read back; a line without a count is marked."""
    folded = catalog._folded(spark, sf_dir)
    lines = folded.select(F.concat_ws(" ", F.array_join("frames", ";"), F.col("n").cast("string"), F.concat(F.col("n") * 2, F.lit(".0"))).alias("value"))
    path = scratch_path(spark, "folded")
    lines.unionByName(spark.createDataFrame([("a line without a count",)], "value string")).write.text(path)
    return text.folded(spark, path).select(F.coalesce(F.array_join("frames", ";"), F.lit("")).alias("stack"), "n1", "n2", "ignored")


def profile_lines(folded: DataFrame) -> DataFrame:
    """pos, value: a profile dump of folded stacks, leaf first, each name under a number, with one name left out."""
    spark = folded.sparkSession
    names = folded.select(F.explode("frames").alias("name")).distinct().orderBy("name")
    places = sequences.numbered(names, [F.col("name")], "id", 1)
    shown = folded.select(F.posexplode("frames").alias("at", "name"), "frames", "n").join(places, "name")
    ids = shown.groupBy("frames", "n").agg(F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"].cast("string"))), " ").alias("ids"))
    body = sequences.numbered(ids, [F.col("ids"), F.col("n")]).select((F.col("pos") + 10).alias("pos"), F.format_string("%8d   10000000: %s ", "n", "ids").alias("value"))
    located = places.filter("name <> 'user'").select((F.col("id") + 1_000_000_000).alias("pos"), F.format_string("%6d: 0x%x M=1 %s :0 s=0", "id", F.col("id") * 4096, "name").alias("value"))
    heads = spark.createDataFrame([(0, "# made here"), (1, "PeriodType: cpu"), (2, "Samples:"), (3, "samples/count cpu/nanoseconds"), (1_000_000_000, "Locations"), (2_000_000_000, "Mappings"), (2_000_000_001, "1: 0x0/0x0 7")], "pos bigint, value string")
    return heads.unionByName(body).unionByName(located)


@query(
    f"WITH {_FOLDED}, names AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS VARCHAR) AS id FROM (SELECT DISTINCT unnest(frames) AS name FROM folded)),"
    " number AS (SELECT max(id) AS id FROM names WHERE name = 'user'),"
    " shown AS (SELECT n, list_transform(frames, lambda x: CASE WHEN x = 'user' THEN id ELSE x END) AS f FROM folded, number)"
    " SELECT array_to_string(f, ';') AS stack, CAST(sum(n) AS BIGINT) AS n FROM shown GROUP BY 1"
)
def profile_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile dump with sections, read by its headers and resolved: locations without a name keep their number."""
    samples, names = text.profile(profile_lines(catalog._folded(spark, sf_dir)))
    return stacks.resolve(samples, names).select(F.array_join("frames", ";").alias("stack"), "n")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type AS kind, '(' || user_id || '/50)' AS inflight FROM events")
def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of names and values, as a report prints them, back as columns."""
    line = F.concat(F.lit("user: "), F.col("user_id"), F.lit(", kind: "), F.col("event_type"), F.lit(",  inflight: ("), F.col("user_id"), F.lit("/50)"))
    rows = load(spark, sf_dir, "events").select("event_id", line.alias("value"))
    parsed = text.metric_lines(rows, keep=["event_id"])
    return parsed.select("event_id", *[F.col("metrics")[c].alias(c) for c in ("user", "kind", "inflight")])


@query(f"WITH {_NODES} SELECT {_ROLES} AS path, CASE WHEN len(path) > 0 AND path[-1] = 'user' THEN 'asked' ELSE '' END AS title, CASE WHEN len(path) > 0 AND path[-1] = 'user' THEN 2 ELSE 0 END AS n FROM nodes")
def flame_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the attributes of their frame, from a side file; an empty map where there are none."""
    notes = text.attributes(spark.createDataFrame([("user\ttitle=asked\thref=a=b",), ("nobody\ttitle=x",)], "value string"))
    found = stacks.with_attributes(stacks.nodes(catalog._folded(spark, sf_dir)), notes)
    return found.select(F.array_join("path", ";").alias("path"), F.coalesce(F.col("attributes")["title"], F.lit("")).alias("title"), F.size("attributes").alias("n"))


@query(
    "SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024) ELSE printf('%.1f bytes', b) END AS size,"
    " CASE WHEN s < 60 THEN printf('%.3f seconds', s) WHEN s < 3600 THEN (CAST(s AS BIGINT) // 60) || ' minutes ' || (CAST(s AS BIGINT) % 60) || ' seconds'"
    " ELSE (CAST(s AS BIGINT) // 3600) || ' hours ' || (CAST(s AS BIGINT) % 3600 // 60) || ' minutes ' || (CAST(s AS BIGINT) % 60) || ' seconds' END AS took,"
    " format('{:,}', CAST(s * 1000 AS BIGINT)) AS shown FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS DOUBLE) AS b, CAST(n_chars AS DOUBLE) AS s FROM documents WHERE text IS NOT NULL)"
)
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, times and numbers as people read them."""
    docs = load(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", scalars.bytes_text(F.octet_length("text").cast("double")).alias("size"), scalars.seconds_text(F.col("n_chars").cast("double")).alias("took"), scalars.thousands(F.col("n_chars") * 1000).alias("shown"))


@query(
    "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe, 'f' || page_id AS frame FROM pages"
)
def text_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as XML takes them, and frame names without their mark."""
    marked = F.concat(F.lit("f"), F.col("page_id"), F.element_at(F.array(*[F.lit(x) for x in ("_[k]", "_[w]", "_[i]", "_[j]", "")]), (F.pmod("page_id", F.lit(5)) + 1).cast("int")))
    return load(spark, sf_dir, "pages").select("page_id", scalars.xml_escape(F.col("html")).alias("safe"), scalars.strip_annotation(marked).alias("frame"))


@query(
    f"WITH {_FOLDED}, c AS (SELECT list_concat(frames, ['--'], frames) AS f, len(frames) + 1 AS place, n FROM folded)"
    " SELECT array_to_string(list_transform(f, lambda x, i: CASE WHEN i > place THEN x || '_[w]' ELSE x END), ';') AS stack, n FROM c"
)
def waker_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of who woke whom: frames after the separator are marked."""
    chains = catalog._folded(spark, sf_dir).withColumn("frames", F.concat("frames", F.array(F.lit("--")), "frames"))
    return chains.select(F.array_join(stacks.with_wakers(F.col("frames")), ";").alias("stack"), "n")


# Hashes


_FNV = "list_reduce(list_prepend({basis}::UBIGINT, list_transform(string_split({text}, ''), lambda x: unicode(x)::UBIGINT)), lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"


@query(
    f"WITH h AS (SELECT c_custkey, {_FNV.format(basis=scalars.FNV_BASIS, text='c_name')} AS h, {_FNV.format(basis=scalars.FNV_BASIS, text='c_name || chr(5)')} AS s FROM customer)"
    " SELECT c_custkey, lower(printf('%016x', h)) AS fnv, lower(printf('%016x', s)) AS seeded, CAST(h % 16 AS BIGINT) AS shard FROM h"
)
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of customers' names, with and without a seed byte, and the shard that it gives."""
    name = F.col("c_name")
    shown = [F.lower(F.lpad(F.hex(h), 16, "0")).alias(a) for h, a in ((scalars.fnv1a(name), "fnv"), (scalars.fnv1a(name, 5), "seeded"))]
    return load(spark, sf_dir, "customer").select("c_custkey", *shown, placement.fnv_shard(name, 16).alias("shard"))
