"""Placement of keys: hash shards and jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import fnv1a, hex_slice

#: Multiplier of the 64-bit linear congruential generator of the jump hash, and the range of its upper bits.
MULTIPLIER = 2862933555777941757
RANGE = 1 << 31
#: Jumps of a key that are looked at. Their number has a mean of about ln(buckets) + 0.6 and its own logarithm's tail: more than
#: this many are less likely than 10^-50 for any number of buckets below 2^31.
JUMPS = 128


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def shard(key: Column, n: int) -> Column:
    """Shard of a key by 32 bits of its MD5."""
    return F.pmod(hex_slice(key.cast("string"), 1), F.lit(n))


def fnv_shard(key: Column, n: int) -> Column:
    """Shard of a key by the 64-bit FNV-1a hash of its text's bytes, taken without sign."""
    h = fnv1a(key.cast("string"))
    return F.pmod(F.shiftrightunsigned(h, 1) % n * 2 + h.bitwiseAND(F.lit(1)), F.lit(n)).cast("bigint")


def jump_hash(key: Column, buckets: int) -> Column:
    """Bucket of a whole-number key: it jumps ahead at random until it would pass the last bucket, and stays where it was.

    A fold inside one expression: no Python, no shuffle. The product of state and multiplier is taken in 38 digits.
    When a bucket is added, keys move to that bucket only.
    """
    size = _whole(1 << 64)

    def jump(s: Column, _: Column) -> Column:
        state = F.pmod(s["state"] * _whole(MULTIPLIER) + _whole(1), size).cast("decimal(20,0)")
        upper = ((state - F.pmod(state, _whole(1 << 33))) / _whole(1 << 33)).cast("double")
        ahead = F.floor((s["ahead"] + 1) * (F.lit(float(RANGE)) / (upper + 1))).cast("bigint")
        return F.when(s["ahead"] >= buckets, s).otherwise(F.struct(state.alias("state"), s["ahead"].alias("at"), ahead.alias("ahead")))

    seed = F.pmod(key.cast("decimal(20,0)"), size).cast("decimal(20,0)")
    start = F.struct(seed.alias("state"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("ahead"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(min(buckets, JUMPS) + 1)), start, jump, lambda s: s["at"])


def moved(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys in all, keys that move when one bucket is added, and how many of those move to the new one."""
    both = df.select(jump_hash(F.col(key), buckets).alias("old"), jump_hash(F.col(key), buckets + 1).alias("new"))
    changed = F.col("old") != F.col("new")
    return both.agg(F.count("*").alias("n_keys"), F.count_if(changed).alias("n_moved"), F.count_if(changed & (F.col("new") == buckets)).alias("n_to_new"))
