"""Order-dependent computations without one big window: dense numbering, prefix sums and rolling frames by chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

#: Rows of a chunk; a rolling frame is copied into the chunk that follows, so chunks should be many frames long.
CHUNK = 100_000


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of an order, numbered in column _part, written once: one task each, whatever values are common."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """df with the dense position of each row in a total order.

    Rows are range-partitioned and numbered inside their partition; only the partitions' sizes are summed up, one
    row each. The order must tell all rows apart for the numbering to be repeatable.
    """
    spread = ranged(df, *order)
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    joined = spread.withColumn("_local", local).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, (F.col("_before") + F.col("_local") - 1 + start).cast("long")).drop("_part", "_p", "_before", "_local")


def sums_before(df: DataFrame, by: list[str], bucket: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with name -> sum of a value over the rows before each one of its group `by`, in the order (bucket, order).

    Buckets are summed first and their totals accumulated, a row for each bucket of a group; the window runs inside
    buckets only, so a group of any size is spread over as many tasks as it has buckets.
    """
    rows = df.withColumns({f"_v{k}": v for k, v in enumerate(values.values())})
    totals = rows.groupBy(*by, bucket).agg(*[F.sum(f"_v{k}").alias(f"_t{k}") for k in range(len(values))])
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, bucket, *[F.coalesce(F.sum(f"_t{k}").over(ahead), F.lit(0)).alias(f"_c{k}") for k in range(len(values))])
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w{k}": F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)) for k in range(len(values))}).join(carried, [*by, bucket])
    found = rows.withColumns({name: F.col(f"_w{k}") + F.col(f"_c{k}") for k, name in enumerate(values)})
    return found.drop(*[f"_{x}{k}" for x in "vcw" for k in range(len(values))])


def last_known(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with the last value that is not null, of each row or one before it in its group `by`, in the order (bucket, order).

    What earlier buckets end with is carried over, a row for each bucket of a group.
    """
    last = df.groupBy(*by, bucket).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, bucket, F.last("_last", ignorenulls=True).over(ahead).alias("_carried"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_inside", inside).join(carried, [*by, bucket]).withColumn(name, F.coalesce("_inside", "_carried")).drop("_inside", "_carried")


def prefix_sum(df: DataFrame, bucket: str, order: list[str], value: str, name: str, exclusive: bool = False) -> DataFrame:
    """df with the running sum of value in the order (bucket, order).

    Buckets are summed first and their totals accumulated, one row a bucket; the window runs inside buckets only.
    """
    totals = df.groupBy(bucket).agg(F.sum(value).alias("_t"))
    carried = totals.select(F.col(bucket).alias("_b"), (F.sum("_t").over(Window.orderBy(bucket)) - F.col("_t")).alias("_c"))
    inside = F.sum(value).over(Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = df.withColumn("_w", inside).join(carried, F.col(bucket) == F.col("_b"))
    total = F.col("_w") + F.col("_c") - (F.col(value) if exclusive else F.lit(0))
    return joined.withColumn(name, total).drop("_w", "_b", "_c")


def dealt(df: DataFrame, position: str, frame: int, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk and _own, in chunks of a dense position: the last frame - 1 rows of a chunk also go to the next.

    There they are context: rows whose _chunk is not their _own. Each task holds chunks and their context, whatever the
    table's size. Spark does not merge the partitions, as frames cost more than their bytes tell.
    """
    chunk = max(chunk, frame)
    last = F.expr(f"pmod({position}, {chunk}) >= {chunk - frame + 1}")
    rows = df.withColumn("_own", F.expr(f"{position} div {chunk}"))
    rows = rows.withColumn("_chunk", F.explode(F.when(last, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_chunk")


def rolling(df: DataFrame, position: str, frame: int, columns: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """df with aggregates over the last `frame` rows, this one included, by a dense position.

    columns: name -> aggregate without a window.
    """
    over = Window.partitionBy("_chunk").orderBy(position).rowsBetween(1 - frame, Window.currentRow)
    rows = dealt(df, position, frame, chunk).withColumns({k: c.over(over) for k, c in columns.items()})
    return rows.filter("_chunk = _own").drop("_own", "_chunk")
