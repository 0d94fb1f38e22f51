"""Seeded synthetic tables. Rows depend on the seed and their number only, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *salt: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and row number; the same in every SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in salt])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def normal(seed: int, *salt: Column) -> Column:
    """A standard normal number by the polar formula, from two uniform ones."""
    u, v = 1 - uniform(seed, *salt, F.lit("u")), uniform(seed, *salt, F.lit("v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def measurements(spark: SparkSession, n: int, names: list[str], seed: int = 42) -> DataFrame:
    """key, value: distinct names drawn with repetition, values uniform from -99.9 to 99.9 in tenths.

    The names are a literal of the plan, so their number is for the caller to bound.
    """
    stations = F.array(*[F.lit(x) for x in sorted(set(names))])
    rows = spark.range(n)
    pick = (F.floor(uniform(seed, F.col("id")) * F.size(stations)) + 1).cast("int")
    value = (F.floor(uniform(seed + 1, F.col("id")) * 1999) - 999) / 10
    return rows.select(F.element_at(stations, pick).alias("key"), value.cast("decimal(4,1)").alias("value"))


def zipf_keys(spark: SparkSession, n: int, n_keys: int, exponent: float = 0.99, seed: int = 42) -> DataFrame:
    """seq, key: Zipf-distributed ranks by inverse distribution, scrambled by a hash so that hot keys lie apart."""
    if exponent == 1:
        rank = F.floor(F.pow(F.lit(float(n_keys + 1)), uniform(seed, F.col("id"))))
    else:
        power = 1 - exponent
        rank = F.floor(F.pow(uniform(seed, F.col("id")) * (float(n_keys + 1) ** power - 1) + 1, F.lit(1 / power)))
    return spark.range(n).select(F.col("id").alias("seq"), F.floor(uniform(seed + 1, F.least(rank, F.lit(n_keys)).cast("bigint")) * n_keys).alias("key"))


def messages(spark: SparkSession, n: int, rps: float, seed: int = 42) -> DataFrame:
    """seq, at (seconds), priority 0-5, cohort 0-127 at a steady rate."""
    rows = spark.range(n).withColumnRenamed("id", "seq")
    return rows.select("seq", (F.col("seq") / rps).alias("at"), *_message(F.col("seq"), seed))


def _message(seq: Column, seed: int) -> list[Column]:
    return [F.floor(uniform(seed, seq) * 6).cast("int").alias("priority"), F.floor(uniform(seed + 1, seq) * 128).cast("int").alias("cohort")]


def message_stream(spark: SparkSession, rps: int, seed: int = 42) -> DataFrame:
    """An unbounded stream of messages(created_at, seq, priority, cohort) at a settable rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rps).load()
    return rows.select(F.col("timestamp").alias("created_at"), F.col("value").alias("seq"), *_message(F.col("value"), seed))
