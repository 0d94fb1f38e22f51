"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, host_rules, language, licenses, mixing, pii, sharding, simhash, spans, sql, toxicity
from quarry.session import load, materialize


#: Shards of the sharding query and of the pipeline.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and licences of every document."""
    found = licenses.scan(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_sentences",
        F.array_join(F.transform("identifiers", lambda x: F.concat_ws(":", x["position"].cast("string"), x["name"])), ",").alias("identifiers"),
        F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"), x["licence"])), ",").alias("licences"),
    )


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document; its source is its host."""
    found = host_rules.judge(load(spark, sf_dir, "documents"), F.col("source"))
    return found.select(F.col("id").alias("doc_id"), *host_rules.METRICS, "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    found = decontaminate.scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), window=10)
    hit = F.expr("aggregate(spans, struct(0L AS n, 0L AS e), (s, x) -> struct(s.n + greatest(0L, x.end - greatest(x.start, s.e)) AS n, greatest(s.e, x.end) AS e), s -> s.n)")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each: sources weigh 5, 2, 1, repeating, and stop at 3 epochs."""
    docs = load(spark, sf_dir, "documents")
    size, h = mixing.word_count(F.col("text")), mixing.seeded_hash(F.col("doc_id"), 0)
    rows = materialize(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "sizes")
    return mixing.mix(rows, mixing.by_rank(rows, [5, 2, 1]), max_epochs=3).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.components(load(spark, sf_dir, "documents"), words=3, max_distance=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated spans, and the first document that has one of its lost spans first, itself if it lost none."""
    found = spans.dedup(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_sentences", "n_removed", "n_words", "n_kept_words", "words_sha256", F.coalesce("first_id", "id").alias("first_doc_id"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(load(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network that learned from the documents outside the held-out quarter."""
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs, train=language.bucket("doc_id", 4) != 2)
    found = language.identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), (language.bucket("id", 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(load(spark, sf_dir, "documents"))
    base = F.expr("filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS long) AS n_{k}") for k in pii.KINDS[:4]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels outside the held-out fifth."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, train=toxicity.bucket("doc_id", 5) != 0)
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (toxicity.bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name, for __spark_entry__.py."""
    return {f.__name__: f for f in (op1_licenses, op2_host_rules, op3_decontamination, op4_mixing, op5_simhash, op6_spans, op7_sharding, op8_language, op9_pii, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    return {"op1_licenses": sql.OP1, "op2_host_rules": sql.OP2, "op3_decontamination": sql.OP3, "op4_mixing": sql.OP4, "op6_spans": sql.OP6, "op7_sharding": sql.op7(SHARDS, sharding.SLOTS)}
