"""One session for all tests, and helpers that hold a query against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("QUARRY_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf(request):
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


def duck(path):
    """A DuckDB connection with the tables of a data folder."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def canonical(frame):
    """Rows of a pandas frame as sorted text, columns by name, floats to nine digits."""
    frame = frame[sorted(frame.columns)]

    def text(v):
        if isinstance(v, float) or type(v).__name__ == "Decimal":
            return f"{float(v):.9g}"
        return str(v)

    return sorted(tuple(text(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def same_rows(df, con, sql):
    """Asserts that a DataFrame has the rows and columns that SQL gives."""
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
