"""A keyed log as relational operators: latest-wins views, deletes, files, sorted runs, compaction and sparse indexes.

A log is a table log(key STRING, seq BIGINT, value STRING, tombstone BOOLEAN, run_id BIGINT); seq is its total order.
An empty value is a value; only the flag deletes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ordered import last_known, numbered, ranged, sums_before
from quarry.session import scratch_path

#: Bytes of a record's header: four 32-bit numbers, or two 64-bit lengths in a sorted run.
HEADER = 16
#: Numbers of seq that one task looks at for one key.
CHUNK = 1_000_000


def size_of(key: Column, value: Column) -> Column:
    """Bytes of a record in a file."""
    return F.lit(HEADER) + F.octet_length(key) + F.octet_length(value)


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The last row of each key (and of each by), tombstones included. Partial aggregates first, so hot keys are no matter."""
    last = F.max_by(F.struct("value", "tombstone"), "seq")
    return log.groupBy(*by, "key").agg(last.alias("last"), F.max("seq").alias("seq")).select(*by, "key", "seq", "last.value", "last.tombstone")


def snapshot(log: DataFrame) -> DataFrame:
    """key, seq, value of the live keys."""
    return latest(log).filter(~F.col("tombstone")).drop("tombstone")


def get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The value of each probed key; empty for keys that are missing or deleted."""
    live = snapshot(log.join(probes.select("key").distinct(), "key", "left_semi"))
    return probes.join(live, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.col("seq").isNotNull().alias("found"))


def fold(log: DataFrame) -> DataFrame:
    """Number of live keys and bytes of their values."""
    return snapshot(log).agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n_bytes"))


def fold_with(log: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user function over batches of the live keys and values."""
    return snapshot(log).select("key", "value").mapInPandas(function, schema)


def deleted_bytes(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, seq, n_bytes of each delete: value and header of what it removes; 0 if the key is not live then.

    What a key was before comes from its rows in the same chunk of seq, or from the last of an earlier chunk; so a key
    with any share of the log is spread over as many tasks as it has chunks.
    """
    rows = log.withColumn("chunk", F.expr(f"seq div {chunk}"))
    state = F.struct("value", "tombstone")
    last = rows.groupBy("key", "chunk").agg(F.max_by(state, "seq").alias("last"))
    carried = last.select("key", "chunk", F.lag("last").over(Window.partitionBy("key").orderBy("chunk")).alias("carried"))
    before = F.lag(state).over(Window.partitionBy("key", "chunk").orderBy("seq"))
    known = rows.withColumn("was", before).filter("tombstone").join(carried, ["key", "chunk"]).withColumn("was", F.coalesce("was", "carried"))
    removed = F.when(F.col("was").isNotNull() & ~F.col("was.tombstone"), F.octet_length("was.value") + HEADER).otherwise(0)
    return known.select("key", "seq", removed.cast("bigint").alias("n_bytes"))


def file_offsets(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Where each record lies in the file of its run: a log's index without its values.

    Bytes are summed by chunks of seq, so a run of any length is spread over tasks.
    """
    size = size_of(F.col("key"), F.col("value")).cast("bigint")
    sized = log.select("run_id", "seq", "key", F.octet_length("value").cast("bigint").alias("value_size"), size.alias("n_bytes"), F.expr(f"seq div {chunk}").alias("_chunk"))
    placed = sums_before(sized, ["run_id"], "_chunk", ["seq"], {"record_offset": F.col("n_bytes")})
    return placed.select("run_id", "seq", "key", "record_offset", (F.col("record_offset") + HEADER).alias("value_offset"), "value_size", "n_bytes")


def rotate(log: DataFrame, cap: int, writer: Column | None = None) -> DataFrame:
    """file_id and offset of each record when a writer opens a new file rather than pass cap bytes.

    Greedy packing follows the record order of a writer, so a writer's records pass through one task, in sorted
    batches of bounded size; writers are independent. A record over cap has a file of its own.
    """
    sized = log.select((F.lit(0) if writer is None else writer).cast("bigint").alias("writer"), "seq", "key", size_of(F.col("key"), F.col("value")).cast("bigint").alias("n_bytes"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, file_id, offset = None, 0, 0
        for batch in batches:
            files, offsets = [], []
            for who, size in zip(batch.writer.tolist(), batch.n_bytes.tolist()):
                if who != now:
                    now, file_id, offset = who, 0, 0
                if offset and offset + size > cap:
                    file_id, offset = file_id + 1, 0
                files.append(file_id)
                offsets.append(offset)
                offset += size
            yield batch.assign(file_id=files, file_offset=offsets)

    return sized.repartition("writer").sortWithinPartitions("writer", "seq").mapInPandas(pack, "writer bigint, seq bigint, key string, n_bytes bigint, file_id bigint, file_offset bigint")


@dataclass(frozen=True)
class StoreOptions:
    """What a store of sorted runs can be tuned by: keys from one index entry to the next, the rate of its Bloom filters, bytes of a memtable."""

    every: int = 8
    fpr: float = 0.01
    memtable_bytes: int = 4 << 20


def memtables(log: DataFrame, options: StoreOptions = StoreOptions(), writer: Column | None = None) -> DataFrame:
    """log with run_id: a memtable is flushed as a run by the record that takes it over its size, and the next one begins.

    Where a run ends depends on where the one before did, so a writer's sizes stream through one task, in sorted batches
    and constant memory; writers are independent, and their runs numbered after one another in bands of 2^32.
    """
    cap = options.memtable_bytes
    rows = log.drop("run_id").withColumns({"_writer": (F.lit(0) if writer is None else writer).cast("bigint"), "_size": size_of(F.col("key"), F.col("value")).cast("bigint")})
    schema = T.StructType([*rows.schema.fields, T.StructField("run_id", T.LongType())])

    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, run_id, held = None, 0, 0
        for batch in batches:
            runs = []
            for who, size in zip(batch["_writer"].tolist(), batch["_size"].tolist()):
                if who != now:
                    now, run_id, held = who, who << 32, 0
                runs.append(run_id)
                held += size
                if held > cap:
                    run_id, held = run_id + 1, 0
            yield batch.assign(run_id=runs)

    return rows.repartition("_writer").sortWithinPartitions("_writer", "seq").mapInPandas(flush, schema).drop("_writer", "_size")


def traverse(log: DataFrame) -> DataFrame:
    """pos, key, seq, value of the live keys in key order; numbered by ranges."""
    return numbered(snapshot(log), [F.col("key")])


def with_runs(log: DataFrame, n_runs: int) -> DataFrame:
    """log with run_id: n_runs runs of equal length by a dense seq from 0."""
    rows = log.count()
    return log.withColumn("run_id", F.expr(f"seq div {max(1, -(-rows // n_runs))}"))


def runs(log: DataFrame) -> DataFrame:
    """Sorted runs: of each run the last row of each key, tombstones kept."""
    return latest(log, "run_id")


def run_summary(log: DataFrame) -> DataFrame:
    """Items and bytes of each run."""
    return runs(log).groupBy("run_id").agg(F.count("*").alias("items"), F.sum(size_of(F.col("key"), F.col("value"))).alias("n_bytes"), F.count_if("tombstone").alias("tombstones"))


def write_runs(log: DataFrame, path: str, level: int = 0) -> None:
    """Runs as Parquet, sorted by key inside a folder for each level and run; min-max statistics and a bloom filter prune them.

    Writers take ranges of run and key, so a large run has as many files as it has ranges.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs(log).withColumn("level", F.lit(level)).repartitionByRange(parts, "run_id", "key").sortWithinPartitions("level", "run_id", "key")
    rows.write.mode("append").option("parquet.bloom.filter.enabled#key", "true").partitionBy("level", "run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a store, with level and run_id from their folders."""
    return spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("bigint"))


def multi_get(tables: DataFrame, probes: DataFrame) -> DataFrame:
    """Values of probed keys over runs(key, value, tombstone, run_id): the newest run that has a key decides; run -1 is none."""
    hit = tables.join(probes.select("key").distinct(), "key", "left_semi")
    newest = hit.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "run_id"), "run_id").alias("r"))
    found = newest.filter(~F.col("r.tombstone")).select("key", "r.value", F.col("r.run_id").alias("run_id"))
    return probes.join(found, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("run_id", F.lit(-1)).alias("run_id"))


def compact(tables: DataFrame) -> DataFrame:
    """One run out of many, sorted by key: the newest row of each key, tombstones kept to hide older levels."""
    newest = tables.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "run_id"), "run_id").alias("r"))
    return newest.select("key", "r.value", "r.tombstone", F.col("r.run_id").alias("run_id")).orderBy("key")


def compact_store(spark: SparkSession, path: str, out: str, level: int = 1, remove_old: bool = False) -> None:
    """Rewrite a store's runs as one run of a higher level in a new folder; readers of the old one are not disturbed.

    remove_old deletes the old folder once the new one is complete, as its last step.
    """
    merged = compact(read_runs(spark, path)).withColumn("level", F.lit(level)).withColumn("run_id", F.lit(0).cast("bigint"))
    merged.write.partitionBy("level", "run_id").parquet(out)
    if remove_old:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def sparse_index(tables: DataFrame, every: int) -> DataFrame:
    """run_id, block, key, file_offset: each every-th key of each run with the offset of its record.

    Runs are read in ranges of their keys, and what earlier ranges hold is carried over; no task sees a whole run.
    """
    size = size_of(F.col("key"), F.col("value")).cast("bigint")
    rows = ranged(tables.select("run_id", "key", size.alias("n_bytes")), "run_id", "key")
    placed = sums_before(rows, ["run_id"], "_part", ["key"], {"rn": F.lit(1).cast("bigint"), "file_offset": F.col("n_bytes")})
    return placed.filter(F.col("rn") % every == 0).select("run_id", F.expr(f"cast(rn div {every} AS bigint)").alias("block"), "key", "file_offset")


def range_lookup(index: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """For each probe the block whose index keys enclose it; block 0 for keys below the first.

    An as-of join by union and carry-forward in ranges of both sides' keys: no nested loop, and no task for a whole run.
    index: run_id, block, key.
    """
    both = index.select("run_id", F.col(key).alias("k"), F.lit(0).alias("is_probe"), "block").unionByName(
        probes.select("run_id", F.col(key).alias("k"), F.lit(1).alias("is_probe"), F.lit(None).cast("bigint").alias("block"))
    )
    carried = last_known(ranged(both, "run_id", "k", "is_probe"), ["run_id"], "_part", ["k", "is_probe"], "block", "at")
    return carried.filter("is_probe = 1").select("run_id", F.col("k").alias(key), F.coalesce("at", F.lit(0)).cast("bigint").alias("block"))


def read_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """run_id, key, value, tombstone of a bounded list of keys in a store of runs.

    The keys are pushed to the scan, which skips the files and row groups whose key statistics or Bloom filter exclude them.
    """
    rows = read_runs(spark, path)
    return rows.filter(F.col("key").isin(keys)).select("run_id", "key", "value", "tombstone")


def append(log: DataFrame, path: str) -> None:
    """Append records to a log on disk: immutable files, one commit."""
    log.write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A log read back from disk."""
    return spark.read.parquet(path)


def hint(spark: SparkSession, log: DataFrame) -> DataFrame:
    """The index of a log without its values, written and read back; the scan of the values is pruned."""
    path = scratch_path(spark, "hint")
    file_offsets(log).write.parquet(path)
    return spark.read.parquet(path)
