"""Every query of the catalogue that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from barloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_duckdb(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toArrow(), duck.sql(catalogue.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    rows = [sorted(map(repr, zip(*[t[c].to_pylist() for c in columns]))) for t in (got, want)]
    assert rows[0] == rows[1]


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
