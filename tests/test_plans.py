"""Physical plans: what reaches the scan, what is aggregated before it is dealt, and what must not appear."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.plans.catalog import QUERIES
from quarry.session import load
from quarry.streaming import pipelines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["sql_filter_text"](spark, sf))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text
    text = plan(QUERIES["sql_int_add"](spark, sf))
    assert "ReadSchema: struct<n_nationkey:int,n_name:string>" in text


@pytest.mark.parametrize("name", ["key_stats", "key_stats_fixed", "key_stats_two_phase", "log_snapshot", "lsm_runs", "shard_stats", "size_share"])
def test_partial_aggregates_come_before_the_exchange(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "partial_" in text and "Window" not in text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_report", "stream_keyed_latest"}))
def test_no_cartesian_product(spark, sf, name):
    """Nested loops are left for one-row sides and the sieve only."""
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    if "BroadcastNestedLoopJoin" in text:
        assert name in {"size_share", "ext_share", "flame_nodes", "flame_prune", "flame_search", "flame_zoom", "flame_attributes"}


@pytest.mark.parametrize("name", ["shed_threshold", "lru_hits", "log_delete_bytes", "running_histogram", "log_file_offsets"])
def test_rows_are_not_gathered_in_one_partition(spark, sf, name):
    """A window over everything appears only over one row for each chunk or bucket."""
    for line in plan(QUERIES[name](spark, sf)).splitlines():
        if "SinglePartition" in line:
            assert name == "running_histogram"
        if re.search(r"\bWindow \[", line):
            assert "windowspecdefinition(" in line


def test_sorted_runs_prune_by_key(spark, sf):
    from quarry.operators import keyedlog
    from quarry.plans.catalog import event_log
    from quarry.session import scratch_path

    path = scratch_path(spark, "store")
    keyedlog.write_runs(event_log(spark, sf), path)
    text = plan(keyedlog.read_runs(spark, path).filter("key = '7' AND level = 0").select("value"))
    assert "EqualTo(key,7)" in text and "PartitionFilters: [isnotnull(level" in text


def test_watermarked_windows_in_append_mode(spark, sf):
    """Closed windows come out once and are right; open ones are withheld."""
    stream = pipelines.file_stream(spark, f"{sf}/events.parquet")
    counts = {"n": F.count("*")}
    got = pipelines.drain(pipelines.tumbling_counts(stream, "ts", "1 day", counts, watermark="1 hour"), "append", "days").collect()
    want = {r.d: r.n for r in load(spark, sf, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).agg(F.count("*").alias("n")).collect()}
    found = {r.tick: r.n for r in got}
    assert len(found) == len(got) and 0 < len(found) <= len(want)
    assert all(want[k] == n for k, n in found.items())
