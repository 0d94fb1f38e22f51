"""Approximate membership: Bloom filters as tables of bit positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import bloom_size, double_hash
from quarry.session import scratch_path


def bits(keys: DataFrame, key: str, k: int, m: int) -> DataFrame:
    """position: the set bits of a filter; duplicates are dropped map-side first. At most m rows."""
    return keys.select(F.explode(double_hash(F.col(key), k, m)).alias("position")).distinct()


def probe(filter_bits: DataFrame, probes: DataFrame, key: str, k: int, m: int) -> DataFrame:
    """key, hit for each distinct probed key: whether all its positions are set. No member is ever missed."""
    asked = probes.select(key).distinct()
    places = asked.select(key, F.explode(F.array_distinct(double_hash(F.col(key), k, m))).alias("position"))
    found = places.join(filter_bits.withColumn("set", F.lit(1)), "position", "left")
    return found.groupBy(key).agg(F.min(F.coalesce("set", F.lit(0))).alias("hit")).select(key, (F.col("hit") == 1).alias("hit"))


def false_positive_rate(probed: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """n_members, n_members_hit, n_others, n_false of probed keys."""
    own = members.select(key).distinct().withColumn("member", F.lit(True))
    rows = probed.join(own, key, "left").withColumn("member", F.coalesce("member", F.lit(False)))
    return rows.agg(
        F.count_if("member").alias("n_members"), F.count_if(F.col("member") & F.col("hit")).alias("n_members_hit"),
        F.count_if(~F.col("member")).alias("n_others"), F.count_if(~F.col("member") & F.col("hit")).alias("n_false"),
    )


def build(keys: DataFrame, key: str, fpr: float = 0.01) -> tuple[DataFrame, int, int]:
    """Bits, k and m for the distinct keys of a table at a false-positive rate."""
    k, m = bloom_size(max(1, keys.select(key).distinct().count()), fpr)
    return bits(keys, key, k, m), k, m


def save(filter_bits: DataFrame, path: str | None = None) -> str:
    """Write a filter; the table of positions is its own format."""
    path = path or scratch_path(filter_bits.sparkSession, "bloom")
    filter_bits.write.parquet(path)
    return path
