"""Structured Streaming pipelines: tumbling reports, keyed upserts as runs, and cache state with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.cache import LRU
from quarry.operators.keyedlog import latest
from quarry.session import scratch_path


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream; the schema is that of the files already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        folder, _, name = path.rpartition("/")  # a source is a folder
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling_counts(events: DataFrame, ts: str, width: str, counts: dict[str, Column], watermark: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts by tumbling event-time window. Zone-less times are read as UTC, since watermarks need instants."""
    rows = events.withColumn("_at", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_at", watermark) if watermark else rows
    found = rows.groupBy(F.window("_at", width).alias("w"), *(by or [])).agg(*[c.alias(k) for k, c in counts.items()])
    return found.select(F.col("w.start").alias("tick"), *(by or []), *counts)


def drain(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Runs a stream over what is there and returns its last result, kept in the shared folder.

    Each micro-batch is written as a table of its own; complete mode keeps the last, the others all, with column batch.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={batches[-1]}")
    return spark.read.option("basePath", out).parquet(*[f"{out}/batch={b}" for b in batches])


def keyed_latest(log: DataFrame) -> DataFrame:
    """The last record of each key of a stream log(key, seq, value, tombstone), in update mode: state is a row for each key."""
    return latest(log)


def upsert_runs(log: DataFrame, label: str = "runs") -> DataFrame:
    """A keyed store fed by a stream: each micro-batch becomes one run, and reading takes the newest row of each key."""
    runs = drain(keyed_latest(log), "update", label)
    return runs.groupBy("key").agg(F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("r")).select("key", "r.seq", "r.value", "r.tombstone")


def lru_stream(accesses: DataFrame, capacity: int, shards: int, ttl_ms: int | None = None) -> DataFrame:
    """shard, seq, key, hit, evicted of a stream accesses(seq, key) against caches, one for each shard of keys.

    State is a shard's keys by recency. With ttl_ms a shard that is not used for so long is emptied, one row for each
    key it held, with no seq.
    """
    rows = accesses.select("seq", F.col("key").cast("string").alias("key"), F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(shards)).alias("shard"))
    schema = "shard bigint, seq bigint, key string, hit boolean, evicted string"

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"shard": group[0], "seq": None, "key": None, "hit": None, "evicted": held}, columns=["shard", "seq", "key", "hit", "evicted"]).astype({"seq": "Int64"})
            return
        cache = LRU(capacity, held)
        part = pd.concat(list(parts)).sort_values("seq")
        out = [cache.access(k) for k in part.key]
        state.update((list(cache.keys),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"shard": group[0], "seq": part.seq.to_numpy(), "key": part.key.to_numpy(), "hit": [h for h, _ in out], "evicted": [e for _, e in out]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("shard").applyInPandasWithState(run, schema, "keys array<string>", "append", timeout)
