"""Catalogue reads over faces and persons, and the integrity audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog, UnknownAction
from lumenframe.functions import text as T


def known(faces: DataFrame) -> DataFrame:
    """Faces without a person count as unknown, -1."""
    return faces.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def in_category(faces: DataFrame, category: str, person: int | None = None) -> DataFrame:
    """Faces of a person, unknown or ignored ones."""
    tests = {
        "person": (F.col("cluster_id") == F.lit(person)) & (F.col("is_ignored") == 0),
        "unknown": (F.col("cluster_id") == -1) & (F.col("is_ignored") == 0),
        "ignored": F.col("is_ignored") == 1,
    }
    if category not in tests:
        raise UnknownAction(category)
    return faces.where(tests[category])


def face_order() -> list[Column]:
    return [F.col("capture_date").desc_nulls_last(), F.col("face_id").desc()]


def seek_faces(rows: DataFrame, last_date: str | None, last_face: int | None = None) -> DataFrame:
    if last_date is None:
        return rows
    older = F.col("capture_date") < last_date
    return rows.where(older if last_face is None else older | ((F.col("capture_date") == last_date) & (F.col("face_id") < last_face)))


def faces_joined(c: Catalog, faces: DataFrame) -> DataFrame:
    """Faces with date and place of their file; the order and the cursor use one date."""
    m = c.media.select("path_key", F.col("capture_date").alias("media_date"), "location_id")
    rows = faces.join(m, "path_key", "left").join(c.locations, "location_id", "left")
    return rows.withColumn("capture_date", F.coalesce("media_date", "capture_date")).drop("media_date")


def faces_page(c: Catalog, category: str, person: int | None = None, limit: int | None = 100, last_date: str | None = None, last_face: int | None = None) -> DataFrame:
    rows = seek_faces(faces_joined(c, in_category(known(c.faces), category, person)), last_date, last_face)
    rows = rows.orderBy(*face_order())
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("face_id", "file_path", "cluster_id", "is_ignored", "frame_index", "capture_date", F.struct("city", "prefecture", "country").alias("place"))


def faces_by_ids(c: Catalog, ids: list[int], long_list: int = 1000) -> DataFrame:
    """Faces of a list of ids: a filter that reaches the scan, or a semi join for a long list."""
    spark = c.faces.sparkSession
    if len(ids) <= long_list:
        rows = c.faces.where(F.col("face_id").isin(ids))
    else:
        rows = c.faces.join(spark.createDataFrame([(i,) for i in ids], "face_id long"), "face_id", "left_semi")
    return faces_joined(c, rows).select("face_id", "file_path", "cluster_id", "is_ignored", "capture_date", "city", "prefecture", "country")


def face_counts(c: Catalog) -> DataFrame:
    """Faces per bucket: ``unknown``, ``ignored`` or a person's id."""
    per = known(c.faces).groupBy("cluster_id", "is_ignored").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("is_ignored") == 1, "ignored").when(F.col("cluster_id") == -1, "unknown").otherwise(F.col("cluster_id").cast("string"))
    return per.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def person_order() -> list[Column]:
    return [F.col("custom_name").isNull(), F.coalesce("custom_name", F.lit("")), F.col("cluster_id")]


def person_list(c: Catalog, include_ignored: bool = False) -> DataFrame:
    """Persons with at least one face that isn't ignored, named ones first."""
    per = c.faces.where("is_ignored = 0 and cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("faces"))
    rows = per.join(c.clusters, "cluster_id", "left")
    if not include_ignored:
        rows = rows.where("coalesce(is_ignored, 0) = 0")
    return rows.orderBy(*person_order()).select("cluster_id", "custom_name", "faces")


def person_photo_counts(c: Catalog) -> DataFrame:
    """Distinct photos per person."""
    return c.faces.where("is_ignored = 0 and cluster_id >= 0").groupBy("cluster_id").agg(F.count_distinct("path_key").alias("photos"))


def person_list_fast(c: Catalog) -> DataFrame:
    """Registered persons without counting."""
    return c.clusters.where("is_ignored = 0").orderBy(*person_order()).select("cluster_id", "custom_name", F.lit(0).cast("long").alias("faces"))


def multi_face_files(c: Catalog, folder: str | None = None) -> DataFrame:
    rows = c.faces if not folder else c.faces.where(T.under_folder(F.col("path_key"), folder))
    return rows.groupBy("file_path").agg(F.count("*").alias("n")).where("n > 1")


def next_cluster_id(c: Catalog, first: int = 1000) -> DataFrame:
    """The id that a new person gets."""
    return c.clusters.agg(F.coalesce(F.when(F.max("cluster_id") >= 0, F.max("cluster_id") + 1), F.lit(first)).alias("next_id"))


def orphan_faces_media(c: Catalog) -> DataFrame:
    return c.faces.join(c.media.select("path_key"), "path_key", "left_anti")


def orphan_faces_clusters(c: Catalog) -> DataFrame:
    return c.faces.where("cluster_id >= 0").join(c.clusters.select("cluster_id"), "cluster_id", "left_anti")


def empty_clusters(c: Catalog) -> DataFrame:
    return c.clusters.join(c.faces.where("cluster_id is not null").select("cluster_id"), "cluster_id", "left_anti")


def orphaned_media(c: Catalog, listing: DataFrame) -> DataFrame:
    """Media rows whose file is gone from ``listing`` (``path_key``)."""
    return c.media.join(listing.select("path_key"), "path_key", "left_anti")


def missing_thumbnails(c: Catalog, listing: DataFrame) -> DataFrame:
    wanted = c.media.where("thumbnail_path is not null and is_in_trash = 0")
    return wanted.join(listing.select(F.col("thumbnail_path")), "thumbnail_path", "left_anti")


def full_audit(c: Catalog, listing: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row of counts; all zero means healthy."""
    found = {
        "orphaned_media": orphaned_media(c, listing),
        "orphaned_faces": orphan_faces_media(c).select("face_id").union(orphan_faces_clusters(c).select("face_id")),
        "missing_thumbnails": missing_thumbnails(c, thumbnails),
        "empty_clusters": empty_clusters(c),
    }
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, rows in found.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.union(p)
    return all_.groupBy().agg(*[F.sum(F.when(F.col("check") == name, F.col("n"))).alias(name) for name in found])


def ghost_groups(c: Catalog) -> DataFrame:
    """Groups with fewer than two members."""
    rows = c.groups.join(c.media.select("group_id", "file_path"), "group_id", "left")
    return rows.groupBy("group_id").agg(F.count("file_path").alias("members")).where("members < 2")


def methods_distribution(c: Catalog) -> DataFrame:
    return c.groups.groupBy("discovery_method").agg(F.count("*").alias("n"))


def top_groups(c: Catalog, n: int = 10) -> DataFrame:
    per = c.media.where("group_id is not null").groupBy("group_id").agg(F.count("*").alias("members"))
    return per.orderBy(F.desc("members"), "group_id").limit(n)


def hash_dups(c: Catalog) -> DataFrame:
    per = c.media.where("coalesce(file_hash, '') <> ''").groupBy("file_hash").agg(F.count("*").alias("members"))
    return per.where("members > 1").orderBy(F.desc("members"), "file_hash")


def visible_groups_in_root(c: Catalog, root: str) -> DataFrame:
    """Groups that are duplicated anywhere and touch a folder."""
    seen = c.media.where("group_id is not null and is_in_trash = 0")
    big = seen.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    return big.join(seen.where(T.under_folder(F.col("path_key"), root)).select("group_id"), "group_id", "left_semi")


def settings_map(settings: DataFrame) -> DataFrame:
    """All settings as one map."""
    return settings.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("settings"))


def setting_get(settings: DataFrame, key: str, default: str | None = None) -> DataFrame:
    return settings.agg(F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default)).alias("value"))


def setting_put(settings: DataFrame, key: str, value: object) -> DataFrame:
    """The last writer wins; values are text."""
    new = settings.sparkSession.createDataFrame([(key, str(value))], "key string, value string")
    return settings.where(F.col("key") != key).unionByName(new)
