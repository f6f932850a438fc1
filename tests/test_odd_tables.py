"""Queries against their SQL on tables that the test tables don't contain."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.plans import registry


def changed(sf_dir, folder: Path, **tables: str) -> str:
    """The test tables, some of them replaced by what a query gives."""
    for file in Path(sf_dir).glob("*.parquet"):
        if file.stem in tables:
            duckdb.sql(f"COPY ({tables[file.stem].format(f"'{file}'")}) TO '{folder / file.name}' (FORMAT PARQUET)")
        else:
            (folder / file.name).symlink_to(file)
    return str(folder)


def both(spark, name: str, folder: str) -> tuple[list, list]:
    frame = registry.queries()[name](spark, folder)
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    return plain(frame.collect()), plain(found)


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """Sizes half way between two texts, and as many persons as larger tables have."""
    tie = "SELECT * REPLACE (CAST((o_orderkey % 40 * 256 + 256) / 100.0 AS DOUBLE) AS o_totalprice) FROM {}"
    more = "SELECT s_suppkey + k * 8996 AS s_suppkey, * EXCLUDE (s_suppkey, k) FROM {}, range(2) t(k)"
    return changed(sf_dir, tmp_path_factory.mktemp("odd"), orders=tie, supplier=more)


@pytest.mark.parametrize("name", ["size_text", "rename_cluster"])
def test_same_rows_on_odd_tables(spark, odd, name):
    got, want = both(spark, name, odd)
    assert got == want and got


def test_sizes_half_way(spark):
    sizes = {256: "0.2 KB", 768: "0.8 KB", 1048576: "1024.0 KB", 1048576 * 9 // 4: "2.2 MB", 1048576 * 11 // 4: "2.8 MB", None: None}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.size_text(F.col("n").cast("double")).alias("x"))
    assert {r.n: r.x for r in rows.collect()} == sizes
