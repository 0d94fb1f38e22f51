"""Stack profiles: folding, prefix nodes on a common axis, differences, pruning, search and zoom.

Folded stacks are a table folded(frames ARRAY<STRING>, n BIGINT); nodes a table nodes(path ARRAY<STRING>, depth, value,
start, end). Frames merge by prefix, and the layout follows the order of frame arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import prefix_sum, ranged, sums_before

#: Width of a drawing and of its two margins, in pixels.
WIDTH, MARGINS = 1200, 20


def resolve(samples: DataFrame, names: DataFrame) -> DataFrame:
    """Folded stacks of samples(loc_ids ARRAY<STRING>, n): ids become names(id, name), or stay; leaf-last order.

    Samples are merged by their ids first, so each distinct stack is looked up once.
    """
    merged = samples.groupBy("loc_ids").agg(F.sum("n").alias("n")).withColumn("stack", F.xxhash64("loc_ids"))
    places = merged.select("loc_ids", F.posexplode("loc_ids").alias("at", "id"))
    named = places.join(names, "id", "left").select("loc_ids", "at", F.coalesce("name", "id").alias("frame"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "frame"))), lambda x: x["frame"])
    stacks = named.groupBy("loc_ids").agg(F.reverse(ordered).alias("frames"))
    return collapse(merged.join(stacks, "loc_ids").select("frames", "n"))


def collapse(stacks: DataFrame) -> DataFrame:
    """Sum of counts of equal stacks."""
    return stacks.groupBy("frames").agg(F.sum("n").alias("n"))


def with_wakers(frames: Column, mark: str = "--") -> Column:
    """Frames with _[w] after each one that follows a separator frame, for chains of who woke whom."""
    first = F.array_position(frames, mark)
    return F.transform(frames, lambda f, i: F.when((first > 0) & (i >= first) & (f != mark), F.concat(f, F.lit("_[w]"))).otherwise(f))


def layout(folded: DataFrame) -> DataFrame:
    """folded with start and end on the running sum of n in the order of frame arrays."""
    summed = prefix_sum(ranged(folded, "frames"), "_part", ["frames"], "n", "end")
    return summed.select("frames", "n", (F.col("end") - F.col("n")).alias("start"), "end")


def chart(samples: DataFrame, seq: str = "seq") -> DataFrame:
    """samples(frames, n, and their order) with start and end on the running sum of n in reverse order of input, as flame charts show time."""
    rows = ranged(samples.withColumn("_back", -F.col(seq)), "_back")
    placed = sums_before(rows, [], "_part", ["_back"], {"start": F.col("n")})
    return placed.select(seq, "frames", "n", "start", (F.col("start") + F.col("n")).alias("end"))


def prefixes(frames: Column) -> Column:
    """All prefixes of an array, the empty one first."""
    return F.transform(F.sequence(F.lit(0), F.size(frames)), lambda k: F.slice(frames, F.lit(1), k))


def nodes(folded: DataFrame) -> DataFrame:
    """path, depth, value, start, end, percent: one node for each prefix of a stack, the empty root included."""
    spread = layout(collapse(folded)).select(F.explode(prefixes(F.col("frames"))).alias("path"), "n", "start", "end")
    found = spread.groupBy("path").agg(F.sum("n").alias("value"), F.min("start").alias("start"), F.max("end").alias("end"))
    total = folded.agg(F.sum("n").alias("total"))
    rows = found.crossJoin(F.broadcast(total))  # one row
    return rows.select("path", F.size("path").alias("depth"), "value", "start", "end", F.round(100.0 * F.col("value") / F.col("total"), 2).alias("percent"))


def prune(tree: DataFrame, pixels: float | None = None, percent: float | None = None, width: int = WIDTH) -> DataFrame:
    """Nodes at least so many pixels of a drawing, or percent of the total, wide."""
    total = tree.agg(F.max("end").alias("total"))
    least = F.col("total") * percent / 100 if percent is not None else F.lit(float(pixels)) * F.col("total") / (width - MARGINS)
    return tree.crossJoin(F.broadcast(total)).filter(F.col("end") - F.col("start") >= least).drop("total")  # one row


def common_prefix(folded: DataFrame) -> DataFrame:
    """folded with shared: how many leading frames a stack has in common with the one before it in the layout."""
    rows = ranged(folded, "frames")
    tails = rows.groupBy("_part").agg(F.max("frames").alias("tail"))
    carried = tails.select(F.col("_part").alias("p"), F.lag("tail").over(Window.orderBy("_part")).alias("carried"))
    inside = F.lag("frames").over(Window.partitionBy("_part").orderBy("frames"))
    rows = rows.withColumn("inside", inside).join(carried, F.col("_part") == F.col("p")).withColumn("before", F.coalesce("inside", "carried"))
    same = F.transform(F.arrays_zip(F.col("frames").alias("a"), F.col("before").alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    first_other = F.array_position(same, False)
    shared = F.when(F.col("before").isNull(), 0).when(first_other > 0, first_other - 1).otherwise(F.size("frames"))
    return rows.select("frames", "n", shared.cast("int").alias("shared"))


def with_attributes(tree: DataFrame, attributes: DataFrame) -> DataFrame:
    """Nodes with the attributes(name, attributes) of their frame, an empty map where there are none."""
    frame = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(""))
    joined = tree.join(attributes, frame == F.col("name"), "left")
    return joined.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))).drop("name")


def differences(pairs: DataFrame) -> DataFrame:
    """path, delta of pairs(frames, n1, n2): second count less first, on the leaf node of each stack only."""
    return pairs.groupBy(F.col("frames").alias("path")).agg(F.sum(F.coalesce("n2", F.lit(0)) - F.coalesce("n1", F.lit(0))).alias("delta"))


def search(tree: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Nodes whose frame matches; `counted` marks those that no other match encloses."""
    name = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("all"))
    hits = tree.filter(name.rlike(f"(?i){pattern}" if ignore_case else pattern))
    inner = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))
    above = hits.filter(F.size("path") > 0).select("path", F.explode(inner).alias("up"))
    nested = above.join(hits.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct().withColumn("nested", F.lit(True))
    return hits.join(nested, "path", "left").withColumn("counted", F.col("nested").isNull()).drop("nested")


def matched_share(tree: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Percent of the root's width that matching nodes cover, nested matches once."""
    width = search(tree, pattern, ignore_case).filter("counted").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("width"))
    total = tree.agg(F.max("end").alias("total"))
    return width.crossJoin(total).select(F.round(100.0 * F.col("width") / F.col("total"), 2).alias("percent"))  # one row each


def zoom(tree: DataFrame, path: list[str]) -> DataFrame:
    """The ancestors and descendants of a node, itself included."""
    target = F.array(*[F.lit(x) for x in path]) if path else F.array().cast("array<string>")
    n = len(path)
    inside = (F.size("path") >= n) & (F.slice("path", F.lit(1), F.lit(n)) == target)
    above = (F.size("path") < n) & (F.slice(target, F.lit(1), F.size("path")) == F.col("path"))
    return tree.filter(inside | above)
