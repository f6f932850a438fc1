"""The shared folder: where lineage is cut and files are exchanged."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lumenframe import jobs

SETTING = "spark.checkpoint.dir"
ROWS_PER_FILE = 250_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, as in local tests, a folder below the temp folder is
    named once for the session.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"lumenframe-{os.getpid()}")
        os.makedirs(found, exist_ok=True)
        found = f"file://{found}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: each is done with them when its own files stand, and a chain of writes would keep all of them."""
    last = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, last)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenframe/{name}-{uuid.uuid4().hex}"


_open: dict[str, list[str]] = {}
_scope: list[str] = []


def cut_lineage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows restarts from the files, whichever executor is lost.  ``rows``,
    if the caller knows about how many there are, keeps small tables in few
    files: one for each ROWS_PER_FILE.
    """
    jobs.check()
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if _scope:
        _open.setdefault(_scope[-1], []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for frames that no later result reads."""
    for df in frames:
        _delete(df.sparkSession, df.scratch_path)


@contextmanager
def scratch(spark: SparkSession, scope: str) -> Iterator[None]:
    """Delete the files of earlier uses of ``scope`` and collect those that are written inside.

    For chains whose every step is written before the next begins.
    """
    for path in _open.pop(scope, []):
        _delete(spark, path)
    _scope.append(scope)
    try:
        yield
    finally:
        _scope.pop()
