"""The operators' queries against their SQL over the test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from barloom.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_like_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns and want.num_rows > 0
    rows = [sorted(map(repr, zip(*[t[c].to_pylist() for c in columns]))) for t in (got, want)]
    assert rows[0] == rows[1]
