"""Every query that SQL can express against its DuckDB statement, on the smallest data."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def joins_on_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    assert joins_on_keys(df)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cur.fetchall(), columns)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    assert joins_on_keys(df) and df.count() >= 0 and df.columns
