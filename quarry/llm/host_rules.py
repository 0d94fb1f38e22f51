"""Host-level quality rules: rule failures by domain, shrunk rates, and verdicts joined back to documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import map_batches
from quarry.session import materialize

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules by name: a document fails if the expression over its metrics is true.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * word_chars",
    "dup_lines": "4 * n_dup_lines > n_words",
}
#: The rules by which a document fails on its own.
BASE_RULES = ("short", "repetitive")
#: A host is rejected if its shrunk failure rate of some rule is above this: twice as many of its documents fail as pass.
MAX_RATE = 2 / 3
#: Strength of the prior, as a number of documents: at least that of a uniform one, and what it is if hosts don't differ.
LEAST_STRENGTH, MAX_STRENGTH = 2.0, 1e6


def metrics(text: str | None) -> tuple[int, ...]:
    """The METRICS of a text: words are runs without ASCII white space; a null text has none of anything."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def domain(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def document_metrics(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, host and the METRICS of every row, in one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(metrics(x.as_py()) for x in batch.column(2)))) or [()] * len(METRICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["id", "host", *METRICS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), host.cast("string").alias("host"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, host string, " + ", ".join(f"{m} long" for m in METRICS))


def host_rates(measured: DataFrame) -> DataFrame:
    """host, rule, n, failed, rate: each host's failure rate of each rule, shrunk towards an empirical beta prior.

    The prior of a rule comes from the hosts by the method of moments: its mean is the rate of all documents, its
    strength follows from how much more the hosts' rates vary, weighted by their documents, than rates of so many draws
    would by chance. So a host of one document says little, and noise is not taken for a difference between hosts.
    Documents are counted by host map-side first, so a host with any share of the rows costs one task no more than
    others. Rows without a host are in no host.
    """
    failed = [F.count(F.when(F.expr(rule), 1)).alias(name) for name, rule in RULES.items()]
    counts = measured.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *failed)
    pairs = ", ".join(f"'{name}', {name}" for name in RULES)
    rows = materialize(counts.selectExpr("host", "n", f"stack({len(RULES)}, {pairs}) AS (rule, failed)"), "hosts")
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = rows.groupBy("rule").agg(F.count("*").alias("hosts"), F.sum("n").alias("all"), F.sum(n * n).alias("squares"), F.sum("failed").alias("bad"), F.sum(f * f / n).alias("spread"))
    mean = F.col("bad") / F.col("all")
    excess = (F.col("spread") - F.col("all") * mean * mean) / F.nullif(mean * (1 - mean), F.lit(0.0)) - (F.col("hosts") - 1)
    alike = excess / F.nullif(F.col("all") - F.col("squares") / F.col("all") - (F.col("hosts") - 1), F.lit(0.0))  # of two documents of a host
    strength = F.when(alike > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MAX_STRENGTH), 1 / alike - 1))).otherwise(F.lit(MAX_STRENGTH))
    prior = sums.select("rule", mean.alias("mean"), strength.alias("strength"))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return rows.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))  # a row for each rule


def judge(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """id, host, METRICS, base_failed, host_rejected, kept: one row for each row of docs.

    base_failed: the document fails one of BASE_RULES. kept: it does not, and its host's shrunk rate of every rule is
    at most max_rate; a rate of just max_rate passes. Null and empty texts have no words and fail; a text of any length is
    read whole; a null host has no verdict; repeated rows count and return as often as they occur; an empty table gives
    no rows; other columns of docs, whatever their names, are not read.
    """
    rows = materialize(document_metrics(docs, host, id_col, text_col), "metrics")
    rejected = materialize(host_rates(rows).filter(F.col("rate") > max_rate).select("host").distinct(), "rejected")
    verdicts = rejected.select(F.col("host").alias("bad"), F.lit(True).alias("host_rejected"))
    base = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE_RULES))
    joined = rows.join(verdicts, F.col("host") == F.col("bad"), "left").drop("bad")
    joined = joined.withColumn("base_failed", base).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
