"""The catalogue: seven tables as DataFrames, and the functions that change it.

A catalogue is immutable; a mutation returns a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: Sentinels of ``cluster_id`` in media queries.
NO_FACES, DUPLICATES, CORRUPTED = -1, -2, -3


@dataclass(frozen=True)
class Catalog:
    media: DataFrame
    faces: DataFrame
    clusters: DataFrame
    locations: DataFrame
    groups: DataFrame
    features: DataFrame
    settings: DataFrame

    def having(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)

    def apply(self, change: Callable[..., Catalog], *args, **kwargs) -> Catalog:
        return change(self, *args, **kwargs)

    def save(self, folder: str) -> None:
        """Write every table as Parquet below ``folder``."""
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Catalog:
        return cls(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(cls)})


class CatalogError(Exception):
    """Base of the engine's errors."""


class UnknownAction(CatalogError, ValueError):
    """No such category, level or action."""
