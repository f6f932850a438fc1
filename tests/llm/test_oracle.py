"""Operators that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from lumenframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf_dir)
    names = sorted(frame.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    found = [x[0] for x in cursor.description]
    assert sorted(found) == names
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got == sorted(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
