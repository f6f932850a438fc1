"""Keeping the catalogue in step with a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog
from lumenframe.functions import text as T
from lumenframe.operators import mutations as M
from lumenframe.operators.numbering import numbered
from lumenframe.operators.vectors import nearest_city


def keyed(listing: DataFrame) -> DataFrame:
    return listing.select("file_path", T.normalize_path(F.col("file_path")).alias("path_key")).dropDuplicates(["path_key"])


def catalogue_orphans(c: Catalog, listing: DataFrame, folder: str | None = None) -> DataFrame:
    """Catalogue rows, of a folder if given, that the listing lacks."""
    rows = c.media if not folder else c.media.where(T.under_folder(F.col("path_key"), folder))
    return rows.select("file_path", "path_key").join(keyed(listing).select("path_key"), "path_key", "left_anti").select("file_path")


def new_files(c: Catalog, listing: DataFrame) -> DataFrame:
    return keyed(listing).join(c.media.select("path_key"), "path_key", "left_anti").select("file_path")


def path_variants(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Raw paths by key: the one to keep, those to merge into it, and whether the file is gone."""
    by = paths.withColumn("path_key", T.normalize_path(F.col("file_path"))).groupBy("path_key")
    rows = by.agg(F.max("file_path").alias("keep"), F.array_sort(F.collect_set("file_path")).alias("all"))
    rows = rows.join(keyed(listing).select("path_key", F.lit(True).alias("there")), "path_key", "left")
    return rows.select("path_key", "keep", F.array_except("all", F.array("keep")).alias("merge"), F.col("there").isNull().alias("orphan")).where("orphan or size(merge) > 0")


def sync_catalogue(c: Catalog, listing: DataFrame) -> Catalog:
    """Orphans go with faces and features, new files come in as bare records."""
    gone = c.media.select("path_key").join(keyed(listing).select("path_key"), "path_key", "left_anti")
    feats = c.features.withColumn("path_key", T.normalize_path(F.col("file_path"))).join(gone, "path_key", "left_anti")
    kept = c.having(media=c.media.join(gone, "path_key", "left_anti").select(*c.media.columns), faces=c.faces.join(gone, "path_key", "left_anti").select(*c.faces.columns), features=feats.select(*c.features.columns))
    return M.upsert_media(kept, new_media_records(listing.join(new_files(c, listing), "file_path", "left_semi")))


def new_media_records(listing: DataFrame) -> DataFrame:
    """Bare records of a listing: no metadata yet, thumbnail key, trash flag by path, content hash if the content is there."""
    content = F.md5("content") if "content" in listing.columns else F.lit(None).cast("string")
    modified = F.col("last_modified") if "last_modified" in listing.columns else F.lit(None).cast("double")
    return listing.select(
        "file_path",
        modified.cast("double").alias("last_modified"),
        F.lit("{}").alias("metadata_json"),
        F.concat(F.lit("/thumbs/"), T.thumbnail_key(F.col("file_path")), F.lit(".jpg")).alias("thumbnail_path"),
        T.in_trash_by_path(F.col("file_path")).cast("int").alias("is_in_trash"),
        content.alias("file_hash"),
    )


def analysed_media_records(metadata: DataFrame) -> DataFrame:
    """Full records from parsed metadata: year and month default to 0 and the date to empty; unreadable metadata marks the row corrupted."""
    taken = F.get_json_object("metadata_json", "$.date_taken")
    year, month = T.year_text(taken), T.month_text(taken)
    broken = F.try_parse_json("metadata_json").isNull()
    return metadata.select(
        "file_path", "last_modified", "metadata_json", broken.cast("int").alias("is_corrupted"), F.coalesce(taken, F.lit("")).alias("capture_date"),
        F.coalesce(year, F.lit(0)).alias("year"), F.coalesce(month, F.lit(0)).alias("month"),
    )


def cache_valid(listing: DataFrame, c: Catalog, thumbnails: DataFrame, force: bool = False) -> DataFrame:
    """``valid``: unchanged since the last analysis, with hash, thumbnail and vector; the rest is the work list."""
    rows = listing.alias("l").join(c.media.alias("m"), F.expr("l.path_key = m.path_key"), "left")
    rows = rows.join(thumbnails.select(F.col("thumbnail_path").alias("t")), F.expr("m.thumbnail_path = t"), "left")
    same = F.expr("l.last_modified = m.last_modified and m.file_hash is not null and t is not null")
    return rows.select("l.path_key", F.coalesce(same & F.lit(not force), F.lit(False)).alias("valid"))


def thumbnail_preload(c: Catalog, thumbnails: DataFrame, batch: int = 25) -> DataFrame:
    """Rows with an existing thumbnail, dealt to batches by path."""
    rows = c.media.where("thumbnail_path is not null").join(thumbnails.select("thumbnail_path"), "thumbnail_path", "left_semi")
    return numbered(rows.select("file_path", "thumbnail_path"), "file_path").select("file_path", "thumbnail_path", F.floor((F.col("n") - 1) / batch).cast("int").alias("batch"))


def resolve_location(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """A city for rows with coordinates that changed since the stored ones; null otherwise."""
    ask = rows.where("(lat <> 0 or lon <> 0) and not (lat <=> cached_lat)")
    return rows.join(nearest_city(ask.select("id", "lat", "lon"), cities), "id", "left").select("id", "city")
