"""Generators, sieves and comparisons of ordered sequences."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import batched

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.ordered import numbered
from quarry.session import materialize

#: Rows that a generator gives before they leave its task together.
BATCH = 10_000
#: Multiples of a prime that are struck out together.
STRIDE = 100_000


def counter(spark: SparkSession, n: int, start: int = 2) -> DataFrame:
    """n: start, start + 1, and so on."""
    return spark.range(start, start + n).withColumnRenamed("id", "n")


def primes(spark: SparkSession, n: int) -> DataFrame:
    """The first n primes: numbers that are no multiple of a smaller prime.

    The bound on the n-th prime sizes the sieve; the primes up to its root, which are few, are struck out on the driver
    and their multiples in tasks, some bound * log log bound rows, so no number meets a divisor that it doesn't have.
    """
    bound = max(15, int(n * (math.log(max(2, n)) + math.log(max(2.0, math.log(max(2, n)))))) + 1)  # Rosser's bound
    root = math.isqrt(bound) + 1
    free = bytearray([1]) * (root + 1)
    for p in range(2, math.isqrt(root) + 1):
        if free[p]:
            free[p * p :: p] = bytes(len(range(p * p, root + 1, p)))
    divisors = spark.createDataFrame([(p,) for p in range(2, root + 1) if free[p]], "p bigint").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    multiples = F.expr(f"explode(sequence(p * p, {bound}L, p * {STRIDE}L))")  # STRIDE of them at a time, so that 2 takes many tasks
    starts = divisors.filter(F.col("p") * F.col("p") <= bound).select("p", multiples.alias("first")).repartition("p", "first")
    struck = starts.select(F.explode(F.expr(f"sequence(first, least({bound}L, first + p * ({STRIDE}L - 1)), p)")).alias("n")).distinct()
    return counter(spark, bound - 1).join(struck, "n", "left_anti").orderBy("n").limit(n)


def same_sequence(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], value: str) -> DataFrame:
    """Whether two ordered tables have the same values position by position; one row.

    Positions come from a range-partitioned numbering, not a global window. Null equals null; lengths must agree.
    """
    a = numbered(left, left_order).select("pos", F.col(value).alias("a"))
    b = numbered(right, right_order).select("pos", F.col(value).alias("b"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "pos", "full_outer")
    equal = F.coalesce("in_a", F.lit(False)) & F.coalesce("in_b", F.lit(False)) & F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.coalesce(F.bool_and(equal), F.lit(True)).alias("same"), F.count("*").alias("n"))


def pull(df: DataFrame, generator: Callable[[Iterator[tuple]], Iterator[tuple]], schema: StructType | str) -> DataFrame:
    """A Python generator over the rows of each partition: it pulls rows and yields rows. What it raises fails the query."""

    def run(batches):
        import pandas as pd

        rows = (tuple(r) for batch in batches for r in batch.itertuples(index=False))
        for some in batched(generator(rows), BATCH):
            yield pd.DataFrame(list(some), columns=names)

    names = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).names
    return df.mapInPandas(run, schema)


def register_counter(spark: SparkSession) -> None:
    """A table function counter_from(start, n) for SQL, written as a Python generator."""

    @F.udtf(returnType="n: bigint")
    class CounterFrom:
        def eval(self, start: int, n: int):
            yield from ((i,) for i in range(start, start + n))

    spark.udtf.register("counter_from", CounterFrom)


def in_order(tree: DataFrame) -> DataFrame:
    """pos, value of trees(tree, node_id, parent_id, side, value) by in-order position, from each node's path of sides.

    Paths grow by a level a round until no node is added: as many joins as the tallest tree has levels, each over the
    written level before it.
    """
    level = materialize(tree.filter("parent_id IS NULL").select("tree", "node_id", "value", F.lit("").alias("path")), "level")
    below = tree.select("tree", F.col("node_id").alias("child"), F.col("parent_id").alias("node_id"), "side", F.col("value").alias("v"))
    step = F.when(F.col("side") == "left", "0").otherwise("2")
    done = level
    while level.limit(1).count():
        grown = level.select("tree", "node_id", "path").join(below, ["tree", "node_id"]).select("tree", F.col("child").alias("node_id"), F.col("v").alias("value"), F.concat("path", step).alias("path"))
        level = materialize(grown, "level")
        done = done.unionByName(level)
    key = F.concat("path", F.lit("1"))  # the node itself lies between its left and its right side
    return done.select("tree", (F.row_number().over(Window.partitionBy("tree").orderBy(key)) - 1).alias("pos"), "value")


def events_in_time(events: DataFrame, at: str, tie: str) -> DataFrame:
    """A simulation's events with the position pos in which they run; ties of time by tie."""
    return numbered(events, [F.col(at), F.col(tie)])


def executions(trace: DataFrame, name: str) -> DataFrame:
    """Executions by task name, sorted by it."""
    return trace.groupBy(name).agg(F.count("*").alias("n")).orderBy(name)


def shuffle_key(columns: list[Column], seed: int) -> Column:
    """A digest of seed and values, by which rows come in an order that depends on them alone, not on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a seeded random order; equal rows are neighbours."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.orderBy(shuffle_key(columns, seed), *columns)
