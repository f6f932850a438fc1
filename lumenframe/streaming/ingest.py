"""Incremental ingest: a folder of listings as a stream whose batches change the catalogue on disk.

An extension; the batch functions do the work.  Every batch reads the newest
catalogue version, applies the change and writes the next version, named by the
batch, so a batch that is run again after a failure writes the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.catalog import Catalog
from lumenframe.functions import text as T
from lumenframe.operators.mutations import upsert_media
from lumenframe.operators.sync import cache_valid, new_media_records
from lumenframe.storage import cut_lineage, drop
from lumenframe.versions import Store

LISTING = "file_path string, last_modified double"


def version_path(root: str, batch: int) -> str:
    return f"{root}/v{batch:08d}"


def ingest_listings(spark: SparkSession, listings: str, root: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Upsert JSON listings below ``listings`` into the catalogue whose first version lies at ``root``/v00000000."""

    def apply(batch: DataFrame, number: int) -> None:
        before = Catalog.load(spark, version_path(root, number))
        last = batch.groupBy("file_path").agg(F.max("last_modified").alias("last_modified"))
        upsert_media(before, new_media_records(last)).save(version_path(root, number + 1))

    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).json(listings)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def stale_files(c: Catalog, listing: DataFrame, thumbnails: DataFrame, force: bool = False) -> DataFrame:
    """``file_path, last_modified`` of listed files whose record is missing, of another time, or without hash or thumbnail."""
    keyed = listing.groupBy(T.normalize_path(F.col("file_path")).alias("path_key"))
    last = keyed.agg(F.max(F.struct("last_modified", "file_path")).alias("f")).select("path_key", "f.*")
    work = cache_valid(last, c, thumbnails, force).where("not valid").select("path_key")
    return last.join(work, "path_key", "left_semi").select("file_path", "last_modified")


def analyse_listings(
    store: Store, listings: str, checkpoint: str, thumbnails: DataFrame, analyse: Callable[[DataFrame], DataFrame] = new_media_records, files_per_batch: int = 100, force: bool = False
) -> StreamingQuery:
    """Analyse the listed files that changed since their last analysis, and publish a version for each batch.

    ``analyse`` makes media records of ``file_path, last_modified``; files that
    are still valid never reach it.  A version notes its batch, so one that is
    run again after a failure is published once; ``stop`` on the query leaves
    the last version as it is.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if store.manifest()["notes"].get(checkpoint, -1) >= number:
            return
        batch = cut_lineage(batch, "listed-files")

        def change(c: Catalog) -> Catalog:
            work = cut_lineage(stale_files(c, batch, thumbnails, force), "stale-files")
            return c if work.isEmpty() else upsert_media(c, analyse(work))

        store.change(change, batch.select("file_path"), {checkpoint: number})
        drop(batch)

    stream = store.spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).json(listings)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of ``ts, event_type`` per tumbling window; later events than the watermark allows are left out in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    counts = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")
