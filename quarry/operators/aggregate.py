"""Keyed aggregation: min, mean, max and count by key, with exact sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import cents, one_decimal


def _mean(total: Column, count: Column, digits: int = 4) -> Column:
    return F.round(total.cast("double") / count / 100, digits)


def key_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, min, mean, max, count by key, sorted by key bytes. One partial and one final aggregate; null values count in none."""
    found = df.groupBy(key).agg(F.min(value).alias("min_value"), F.sum(cents(F.col(value))).alias("total"), F.max(value).alias("max_value"), F.count(value).alias("n"))
    return found.select(key, "min_value", _mean(F.col("total"), F.col("n")).alias("mean_value"), "max_value", "n").orderBy(key)


def key_stats_fixed(df: DataFrame, key: str, value: str) -> DataFrame:
    """As key_stats, in whole hundredths throughout."""
    fixed = df.select(key, cents(F.col(value)).alias("c"))
    return fixed.groupBy(key).agg(F.min("c").alias("min_cents"), F.max("c").alias("max_cents"), F.sum("c").alias("sum_cents"), F.count("c").alias("n"))


def partial_stats(df: DataFrame, part: Column, keys: list[str], value: str) -> DataFrame:
    """Mergeable statistics of each part: what a worker that sees one split knows."""
    fixed = df.select(*keys, part.alias("part"), cents(F.col(value)).alias("c"))
    return fixed.groupBy("part", *keys).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("c").alias("total"), F.count("c").alias("n"))


def merge_stats(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Final statistics from partial ones: min of min, max of max, sum of sums."""
    merged = partials.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return merged.select(*keys, (F.col("lo") / 100).alias("min_value"), _mean(F.col("total"), F.col("n")).alias("mean_value"), (F.col("hi") / 100).alias("max_value"), "n")


def report_line(stats: DataFrame, key: str) -> DataFrame:
    """One row with {key=min/mean/max,...} in key order, one decimal each, from key_stats."""
    numbers = F.concat_ws("/", *[one_decimal(F.col(c)) for c in ("min_value", "mean_value", "max_value")])
    entry = F.struct(F.col(key).alias("k"), F.concat_ws("=", F.col(key).cast("string"), numbers).alias("s"))
    entries = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["s"])
    return stats.agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("report"))


def share(df: DataFrame, key: str, size: Column) -> DataFrame:
    """Count, bytes and percentage of all bytes by key, for reports such as size by file extension."""
    found = df.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    total = found.agg(F.sum("bytes").alias("every"))
    return found.crossJoin(F.broadcast(total)).select(key, "n", "bytes", F.round(100.0 * F.col("bytes") / F.col("every"), 2).alias("percent"))  # one row


def files_by_extension(files: DataFrame) -> DataFrame:
    """share() over a file listing(path, length), as the binaryFile source gives it."""
    name = F.substring_index("path", "/", -1)
    return share(files.select(F.substring_index(name, ".", -1).alias("ext"), "length"), "ext", F.col("length"))
