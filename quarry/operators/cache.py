"""Cache semantics as queries: least-recently-used hits and evictions, recency, expiry and statistics."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accesses of a chunk that one task replays.
CHUNK = 50_000


class LRU:
    """Keys by recency, the oldest first. Capacity 0 holds any number."""

    def __init__(self, capacity: int, keys: list | None = None) -> None:
        self.capacity = capacity
        self.keys: OrderedDict = OrderedDict.fromkeys(keys or [])

    def access(self, key) -> tuple[bool, object | None]:
        """Whether key is held, and the key that its entry drives out, if any. Afterwards key is the newest."""
        hit = key in self.keys
        self.keys[key] = None
        self.keys.move_to_end(key)
        if self.capacity and len(self.keys) > self.capacity:
            return hit, self.keys.popitem(last=False)[0]
        return hit, None

    def remove(self, key) -> bool:
        """Takes key out; whether it was held."""
        return self.keys.pop(key, self) is not self

    def head(self, n: int) -> list:
        """The n newest keys, newest first."""
        return list(reversed(self.keys))[:n]


def replay(accesses: DataFrame, capacity: int, chunk: int = CHUNK) -> DataFrame:
    """seq, key, hit, evicted for accesses(seq, key) of one cache, in seq order, seq dense or not.

    What a cache holds when a chunk of the sequence starts is the `capacity` keys used last before it. Those are known
    from each chunk's own last keys, at most capacity rows a chunk; with them every chunk replays in its own task.
    Without a capacity a key hits if it was used before, and nothing is driven out.
    """
    if not capacity:
        seen = accesses.select("seq", F.col("key").cast("string").alias("key"))
        first = seen.groupBy("key").agg(F.min("seq").alias("_first"))
        return seen.join(first, "key").select("seq", "key", (F.col("seq") > F.col("_first")).alias("hit"), F.lit(None).cast("string").alias("evicted"))
    rows = accesses.select("seq", F.col("key").cast("string").alias("key"), F.expr(f"seq div {chunk}").alias("chunk"))
    used = rows.groupBy("chunk", "key").agg(F.max("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("seq")))
    tails = used.withColumn("rank", rank).filter(F.col("rank") <= capacity).drop("rank")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, LRU(capacity)  # the content where a chunk starts, chunk by chunk, in capacity rows of memory
        for batch in batches:
            out = []
            for chunk_id, key in zip(batch.chunk.tolist(), batch.key.tolist()):
                if chunk_id != now:
                    out += [(chunk_id, age, held) for age, held in enumerate(cache.keys)]
                    now = chunk_id
                cache.access(key)
            yield pd.DataFrame(out, columns=["chunk", "age", "key"])

    warm = tails.coalesce(1).sortWithinPartitions("chunk", "seq").mapInPandas(starts, "chunk bigint, age bigint, key string")

    def run(key: tuple, part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        cache = LRU(capacity, held.sort_values("age").key.tolist())
        part = part.sort_values("seq")
        out = [cache.access(k) for k in part.key]
        return pd.DataFrame({"seq": part.seq.to_numpy(), "key": part.key.to_numpy(), "hit": [h for h, _ in out], "evicted": [e for _, e in out]})

    return rows.groupBy("chunk").cogroup(warm.groupBy("chunk")).applyInPandas(run, "seq bigint, key string, hit boolean, evicted string")


def replay_sharded(accesses: DataFrame, shard: Column, capacity: int) -> DataFrame:
    """shard, seq, key, hit for a cache of independent shards; a shard's sequence streams through its task in sorted batches."""
    rows = accesses.select(shard.cast("bigint").alias("shard"), "seq", F.col("key").cast("string").alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cache = None, LRU(capacity)
        for batch in batches:
            hits = []
            for which, key in zip(batch["shard"].tolist(), batch["key"].tolist()):
                if which != now:
                    now, cache = which, LRU(capacity)
                hits.append(cache.access(key)[0])
            yield batch.assign(hit=hits)

    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, "shard bigint, seq bigint, key string, hit boolean")


def head(accesses: DataFrame, n: int) -> DataFrame:
    """key, seq of the n keys used last, newest first."""
    return accesses.groupBy("key").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(n)


def expired(writes: DataFrame, now: Column, ttl: str) -> DataFrame:
    """key, written_at of the keys of writes(key, written_at) whose last write is ttl old or older."""
    last = writes.groupBy("key").agg(F.max("written_at").alias("written_at"))
    return last.filter(F.col("written_at") + F.expr(f"INTERVAL {ttl}") <= now)


def statistics(replayed: DataFrame, *by: str) -> DataFrame:
    """Accesses, hits, misses and hit rate."""
    found = replayed.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return found.select(*by, "n", "hits", (F.col("n") - F.col("hits")).alias("misses"), F.round(F.col("hits") / F.col("n"), 6).alias("hit_rate"))


def report(replayed: DataFrame, value: str, *by: str) -> DataFrame:
    """Hit rate, and the 99th percentile of value over hits, which read, and over misses, which write."""
    p99 = [F.percentile(F.when(which, F.col(value)), F.lit(0.99)).alias(name) for which, name in ((F.col("hit"), "read_p99"), (~F.col("hit"), "write_p99"))]
    return replayed.groupBy(*by).agg(F.round(F.count_if("hit") / F.count("*"), 6).alias("hit_rate"), *p99)
