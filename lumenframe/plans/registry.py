"""All catalogue queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.catalog import Catalog
from lumenframe.plans import changes, reads, scalars, similarity
from lumenframe.sources.fixtures import SQL, catalog
from lumenframe.storage import new_path, shuffles_dropped

_PARTS = (reads, scalars, changes, similarity)
_ingested: dict[tuple[str, str], Catalog] = {}


def ingested(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue of a folder of test tables, brought into tables of its own in the shared folder once per application.

    Queries read those, as they would read a catalogue that is kept; the first one pays for the ingest.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        folder = new_path(spark, "catalog")
        with shuffles_dropped(spark):
            catalog(spark, sf_dir).save(folder)
        _ingested[key] = Catalog.load(spark, folder)
    return _ingested[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for part in _PARTS:
        for name, (query, _) in part.QUERIES.items():
            found[name] = lambda spark, d, q=query: q(ingested(spark, d), spark, d)
    return found


def oracle_sql() -> dict[str, str]:
    return {name: SQL + sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
