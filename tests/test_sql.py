"""Every query that has SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name, tmp_path):
    QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    got = con.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    pick = ", ".join(f'"{c}"' for c in columns)
    a = sorted([cell(v) for v in r] for r in con.sql(f"SELECT {pick} FROM ({SQL[name]}) t").fetchall())
    b = sorted([cell(v) for v in r] for r in con.sql(f"SELECT {pick} FROM '{tmp_path}/out/*.parquet'").fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns
