"""Every tabular query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from lakemill import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(x):
    return round(float(x), 9) + 0.0 if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted((tuple(value(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert sorted(df.columns) == columns
    assert sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=str) == want
