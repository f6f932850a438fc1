"""File listings and delimited sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.storage import cut_lineage


def _closed(folder: Column, include_trash: bool) -> Column:
    """Whether a scan doesn't enter a folder of this name: WORK_FOLDERS by exact name and, unless ``include_trash``,
    TRASH_FOLDERS in any case and hidden ones. Names that only hold such a word are entered.
    """
    work = folder.isin(*T.WORK_FOLDERS)
    return work if include_trash else work | F.upper(folder).isin(*T.TRASH_FOLDERS) | F.startswith(folder, F.lit("."))


def _scanned(name: Column, include_trash: bool) -> Column:
    """Whether a scan takes a file of this name: media by extension, not hidden unless ``include_trash``."""
    media = F.lower(name).rlike(rf"\.({'|'.join(T.SCANNED_EXTENSIONS)})$")
    return media if include_trash else media & ~F.startswith(name, F.lit("."))


def keep_scanned(paths: DataFrame, include_trash: bool = False) -> DataFrame:
    """Of a listing (``file_path``), the files that a scan from its root would give."""
    names = F.split(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")), "/")
    inside = F.exists(F.slice(names, 1, F.size(names) - 1), lambda f: _closed(f, include_trash))
    return paths.where(_scanned(F.element_at(names, -1), include_trash) & ~inside).distinct()


def _store(whole: str) -> tuple[str, str, str]:
    """Of a qualified path: the address for pyarrow, the path in that store, and what stands before it."""
    uri = whole.replace("s3a://", "s3://", 1) if whole.startswith("s3a://") else f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole
    path = FileSystem.from_uri(uri)[1]
    return uri, path, whole[: len(whole) - len(path)]


def _list_pass(uri: str):
    """What each folder holds, one level deep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FileSystem.from_uri(uri)[0]
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = store.get_file_info(FileSelector(folder, allow_not_found=True))
                columns = [[x.path for x in found], [x.base_name for x in found], [x.type == FileType.Directory for x in found], [x.size for x in found], [(x.mtime_ns or 0) / 1e9 for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64()))], names=["path", "name", "folder", "size", "last_modified"])

    return run


def _content_pass(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = FileSystem.from_uri(uri)[0]
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):
                with store.open_input_stream(path) as file:
                    yield batch.slice(k, 1).append_column("content", pa.array([file.read()], pa.binary()))

    return run


def scan_files(spark: SparkSession, root: str, include_trash: bool = False, with_content: bool = False) -> DataFrame:
    """``file_path, last_modified, size`` (``content``) of every media file below ``root``.

    Executors list the folders level by level; those that are closed to a scan
    are never entered, and the driver sees no listing.  The store is one that
    pyarrow opens by its address (files, HDFS, S3, GCS).  Names above ``root``
    don't count; contents are read only if asked for, a file at a time.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri, path, before = _store(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    folders, levels, n = spark.createDataFrame([(path,)], "path string"), [], 1
    while n:
        spread = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
        level = cut_lineage(spread.mapInArrow(_list_pass(uri), "path string, name string, folder boolean, size long, last_modified double"), "folder-level")
        levels.append(level.where(~F.col("folder") & _scanned(F.col("name"), include_trash)))
        folders = level.where(F.col("folder") & ~_closed(F.col("name"), include_trash)).select("path")
        n = folders.count()
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    found = found.select("path", "last_modified", "size")
    if with_content:
        found = found.mapInArrow(_content_pass(uri), "path string, last_modified double, size long, content binary")
    return found.withColumn("path", F.concat(F.lit(before), "path")).withColumnRenamed("path", "file_path")


GAZETTEER = ", ".join(f"c{i} string" for i in range(19))


def read_gazetteer(spark: SparkSession, path: str, admin: DataFrame | None = None) -> DataFrame:
    """Cities of a tab-separated gazetteer: name, coordinates, country code, region; rows that are too short are skipped.

    ``admin`` (``code, region``) names regions by ``country.code``.
    """
    rows = spark.read.option("sep", "\t").option("quote", "").schema(GAZETTEER).csv(path).where("c10 is not null")
    rows = rows.select(F.col("c1").alias("city"), F.col("c4").try_cast("double").alias("lat"), F.col("c5").try_cast("double").alias("lon"), F.col("c8").alias("country"), F.concat_ws(".", "c8", "c10").alias("code"))
    return rows if admin is None else rows.join(admin, "code", "left")


def write_audit(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
