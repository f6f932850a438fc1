"""Every catalogue query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from lumenframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, duck, sf_dir):
    frame = registry.queries()[name](spark, sf_dir)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    cursor = duck.execute(ORACLE[name])
    found = [x[0] for x in cursor.description]
    assert sorted(found) == names
    assert got == sorted(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
