"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ordered import numbered
from quarry.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hash ranges by which a source's words are summed before the boundary range is looked at row by row.
BUCKET_BITS = 10
#: Sources up to which the table of them is broadcast; beyond, Spark's planner joins it by its size.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(key: Column, seed: int) -> Column:
    """60 uniform bits of the MD5 of seed and key; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def water_fill(totals: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """totals(source, weight, source_size) with target: shares of total by weight, none above max_epochs times its size.

    Clamps the sources above their cap, hands the excess to the others by weight and repeats until none is above.
    Each round is an aggregate of the table of sources; two numbers reach the driver.
    """
    cap = (F.col("source_size") * max_epochs).cast("double")
    clamped, rate, seen = F.lit(False), F.lit(0.0), -1
    while True:
        row = totals.agg(
            F.count(F.when(clamped, 1)).alias("n"), F.coalesce(F.sum(F.when(clamped, F.col("source_size") * max_epochs)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if row.n == seen or not row.free:
            return totals.withColumn("target", F.when(clamped, cap).otherwise(rate))
        seen = row.n
        rate = F.col("weight") * F.lit(float(total - int(row.fixed))) / F.lit(float(row.free))
        clamped = rate > cap


def repetitions(rows: DataFrame, weights: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row for each source, saying how often the mix takes its documents.

    rows: source, size, h (a seeded hash). weights: source, weight > 0 for each source. Result: source, source_size,
    target, whole (times that every document is taken), last_h, last_size, part. Documents whose (h, size) is below
    (last_h, last_size) are taken once more; of those equal to it, part words more; so a source's words come to its
    target, rounded. Null is a source like others. Sizes of a source may all be 0: nothing is taken of it.
    """
    bucket = F.shiftright("h", 60 - BUCKET_BITS).alias("bucket")
    by_bucket = materialize(rows.groupBy("source", bucket).agg(F.sum("size").alias("words")), "buckets")
    sizes = by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    same = sizes["source"].eqNullSafe(weights["source"])
    totals = materialize(sizes.join(weights, same).select(sizes["source"], F.col("weight").cast("double").alias("weight"), "source_size"), "sources")
    total = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filled = water_fill(totals, int(total), max_epochs)
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", F.least(whole, F.lit(max_epochs))).withColumn("extra", words - F.col("whole") * F.col("source_size"))
    filled = materialize(filled, "targets")

    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    runs = by_bucket.withColumn("before", before).withColumnRenamed("source", "s")
    edge = runs.join(filled, runs["s"].eqNullSafe(filled["source"])).filter("before <= extra AND extra < before + words")
    edge = edge.select("s", F.col("bucket").alias("b"), "before", "extra")
    edge = F.broadcast(edge) if totals.count() <= BROADCAST_SOURCES else edge
    inside = rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (bucket == edge["b"]))
    ties = inside.groupBy("s", "before", "extra", "h", "size").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    start = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("h", "size")) - F.col("words")
    last = ties.withColumn("start", start).filter("start <= extra AND extra < start + words")
    last = last.select("s", F.col("h").alias("last_h"), F.col("size").alias("last_size"), F.expr("(extra - start) div n").alias("part"))
    info = filled.join(last, filled["source"].eqNullSafe(last["s"]), "left")
    return materialize(info.select("source", "source_size", "target", "whole", "last_h", "last_size", "part"), "repetitions")


#: What repetitions() says of a source, under names that no table of documents should have.
_INFO = {c: f"_q_{c}" for c in ("source", "source_size", "target", "whole", "last_h", "last_size", "part")}


def taken(size: Column, h: Column, whole_documents: bool = False) -> Column:
    """Words that the mix takes of a document, from its size and hash and its source's row of repetitions() under _INFO.

    whole_documents rounds the one document at the boundary to a whole or none.
    """
    whole, last_h, last_size, part = (F.col(_INFO[c]) for c in ("whole", "last_h", "last_size", "part"))
    below = (h < last_h) | ((h == last_h) & (size < last_size))
    at = (h == last_h) & (size == last_size)
    part = F.when(part * 2 >= size, size).otherwise(0) if whole_documents else part
    return (whole * size + F.when(below, size).when(at, part).otherwise(0)).cast("long")


def by_rank(sources: DataFrame, cycle: list[float]) -> DataFrame:
    """Weights for the distinct values of column source: in code point order, null last, the cycle again and again.

    Sources are numbered by ranges, so any number of them, such as one for each host, is spread over tasks.
    """
    ranked = numbered(sources.select("source").distinct(), [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod("rank", F.lit(len(cycle))) + 1).cast("int"))
    return materialize(ranked.select("source", weight.alias("weight")), "weights")


def _with_info(rows: DataFrame, source: Column, weighed: DataFrame, weights: DataFrame, max_epochs: int) -> DataFrame:
    """rows with what repetitions() says of their source; weighed(source, size, h) are all documents."""
    info = repetitions(weighed, weights, max_epochs).select(*[F.col(c).alias(name) for c, name in _INFO.items()])
    info = F.broadcast(info) if info.count() <= BROADCAST_SOURCES else info
    return rows.join(info, source.eqNullSafe(F.col(_INFO["source"])))


def mix(rows: DataFrame, weights: DataFrame, max_epochs: int = 3) -> DataFrame:
    """rows(source, size, h, more) with source_size, target and taken, in place of columns of these names.

    A null source is one like others; null sizes or hashes are for the caller to fill. Documents of a source with equal h
    and size share alike; repeated rows keep a row each; an empty table gives an empty one. Names that begin with _q_ are
    taken.
    """
    joined = _with_info(rows, rows["source"], rows.select("source", "size", "h"), weights, max_epochs)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("source_size", "target", "taken")]
    added = [F.col(_INFO["source_size"]).alias("source_size"), F.col(_INFO["target"]).alias("target"), taken(F.col("size"), F.col("h")).alias("taken")]
    return joined.select(*kept, *added)


def repeat_documents(docs: DataFrame, weights: DataFrame | None = None, cycle: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 0,
                     id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row as often as the mix takes it, whole documents only, columns as they are.

    Rows with equal ids share their luck if their sizes are equal too. Null, empty and blank texts have no words: they are
    kept once, as they cost the mix nothing. A null source is one like others, a null id counts as empty. An empty table
    gives an empty one. Columns may have any names but those that begin with _q_.
    """
    extra = {"_q_key": F.col(f"`{source_col}`"), "_q_size": word_count(F.col(f"`{text_col}`")), "_q_h": seeded_hash(F.col(f"`{id_col}`"), seed)}
    names = {"_q_key": "source", "_q_size": "size", "_q_h": "h"}
    slim = materialize(docs.select(*[c.alias(names[k]) for k, c in extra.items()]), "sizes")
    weights = by_rank(slim, list(cycle)) if weights is None else weights
    joined = _with_info(docs.withColumns(extra), F.col("_q_key"), slim, weights, max_epochs)
    times = F.when(F.col("_q_size") == 0, 1).otherwise(taken(F.col("_q_size"), F.col("_q_h"), True) / F.col("_q_size")).cast("int")
    again = joined.withColumn("_q_times", times).filter("_q_times > 0").withColumn("_q_copy", F.explode(F.sequence(F.lit(1), "_q_times")))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
