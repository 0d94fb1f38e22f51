"""Every registered core query against its SQL, and golden values of the recipes that are easy to get wrong."""

import os

import pytest
from conftest import DATA, duck, same_rows
from pyspark.sql import functions as F

from quarry.functions.scalars import bloom_size
from quarry.plans.catalog import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), duck(sf), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_golden(spark):
    sf = f"{DATA}/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    assert QUERIES["lru_hits"](spark, sf).filter("hit").count() == 523
    assert QUERIES["log_rotate"](spark, sf).agg(F.max("file_id")).first()[0] == 66
    assert QUERIES["log_snapshot"](spark, sf).count() == 120
    assert QUERIES["jump_assign"](spark, sf).agg(F.sum("bucket")).first()[0] == 11182
    assert tuple(QUERIES["jump_moved"](spark, sf).first())[1:] == (85, 85)
    assert bloom_size(750, 0.01) == (7, 7189)
    assert bloom_size(10_000, 0.01) == (7, 95851)
    members, hit, others, false = QUERIES["bloom_fpr"](spark, sf).first()
    assert (members, hit, others) == (750, 750, 750) and false <= 15  # 1 % are expected


def test_closed_loop_follows_the_controller(spark, sf):
    """The streamed fold equals a plain loop over the ticks."""
    import numpy as np

    from quarry.operators import shedder
    from quarry.plans.catalog import _messages

    rows = _messages(spark, sf)
    tick = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    got = shedder.closed_loop(rows, 10, tick).orderBy("tick").toPandas()
    loop = shedder.Controller(10)
    plain = rows.select(tick.alias("tick"), "seq", "pos").orderBy("seq").toPandas()
    want = [loop.tick(part.pos.to_numpy(float)) for _, part in plain.groupby("tick")]
    assert got.n_out.tolist() == [n for n, _ in want]
    assert np.allclose(got.ratio, [r for _, r in want])


def test_sketch_is_near_the_exact_quantile(spark, sf):
    exact = {r.day: r.p90 for r in QUERIES["latency_p90"](spark, sf).collect()}
    for r in QUERIES["latency_sketch"](spark, sf).collect():
        assert abs(r.p90 - exact[r.day]) <= 0.2 * exact[r.day]
