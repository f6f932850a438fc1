"""Catalogue reads: name -> (query of (catalog, spark, sf_dir), SQL twin after the catalogue's tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import media as M
from lumenframe.operators import people as P
from lumenframe.operators import sync as S
from lumenframe.sources.files import keep_scanned, read_gazetteer, write_audit
from lumenframe.storage import new_path
from lumenframe.streaming.ingest import events_per_window

PERSON, ROOT = 1, "/lib/p1/c_7"
_SOUND = "coalesce(m.is_corrupted, 0) = 0"
_SEEN = "coalesce(m.is_in_trash, 0) = 0"
_UNDER = f"starts_with(m.path_key, '{ROOT}/')"
_CURSOR = ("1996:06:01 00:00:00", "/lib/p3")
_IDS = [1001, 2001, 5002, 7001, 33001]
_TAGS = """tags AS (
  SELECT path_key, string_agg(tag, ',' ORDER BY tag) AS tags FROM (
    SELECT DISTINCT f.path_key, concat(coalesce(f.cluster_id, -1), ':', coalesce(c.custom_name, '')) AS tag
    FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.cluster_id WHERE coalesce(c.is_ignored, 0) = 0) GROUP BY path_key)"""
_FLAG = "CASE WHEN m.group_id IS NOT NULL AND EXISTS (SELECT 1 FROM media o WHERE o.group_id = m.group_id AND o.file_path <> m.file_path AND o.is_in_trash = 0) THEN 1 ELSE 0 END"
_LISTED = "media_no % 41 <> 0"


def _page_sql(where: str, order: str, tail: str) -> str:
    return f""", {_TAGS}
SELECT m.file_path, m.last_modified, m.capture_date, m.size, m.is_in_trash, m.group_id, {_FLAG} AS is_duplicate, g.discovery_method, l.country, l.prefecture, l.city, t.tags
FROM media m LEFT JOIN locations l ON m.location_id = l.location_id LEFT JOIN groups g ON m.group_id = g.group_id LEFT JOIN tags t ON m.path_key = t.path_key
WHERE {where} ORDER BY {order} {tail}"""


_NEWEST = "m.capture_date DESC NULLS LAST, m.file_path DESC NULLS LAST"
_PERSON = f"EXISTS (SELECT 1 FROM faces f WHERE f.path_key = m.path_key AND f.cluster_id = {PERSON})"


def _listing(c) -> DataFrame:
    """A file listing that lacks some catalogued files and has new ones."""
    there = c.media.where(_LISTED).select("file_path", "path_key", "last_modified")
    new = c.media.where("media_no % 100 = 1").selectExpr("replace(file_path, '.jpg', '_new.jpg') as file_path", "replace(path_key, '.jpg', '_new.jpg') as path_key", "last_modified")
    return there.union(new.where("file_path like '%new%'"))


def _thumbnails(c) -> DataFrame:
    return c.media.where("media_no % 9 <> 0 and thumbnail_path is not null").select("thumbnail_path")


_LISTING = f"""listing AS (SELECT file_path, path_key, last_modified FROM media WHERE {_LISTED}
  UNION ALL SELECT replace(file_path, '.jpg', '_new.jpg'), replace(path_key, '.jpg', '_new.jpg'), last_modified FROM media WHERE media_no % 100 = 1 AND file_path LIKE '%.jpg'),
thumbs AS (SELECT thumbnail_path FROM media WHERE media_no % 9 <> 0 AND thumbnail_path IS NOT NULL)"""


def _page(c, **options) -> DataFrame:
    return M.media_page(c, **options)


def _facet_sql(column: str, where: str, extra: str = "") -> str:
    return f" SELECT m.{column}, count(*) AS n FROM media m WHERE {_SEEN} AND {_SOUND} AND {where} {extra} GROUP BY m.{column} HAVING m.{column} IS NOT NULL"


_DAY = "CASE WHEN coalesce(capture_date, '') = '' THEN 'Unknown Date' ELSE replace(split_part(capture_date, ' ', 1), '-', '/') END"
_LABEL = """coalesce(nullif(concat_ws(', ', CASE WHEN coalesce(nullif(country, '') IN ('JP', 'Japan', '日本'), false) THEN nullif(prefecture, '') ELSE nullif(country, '') END, nullif(city, '')), ''), 'Unknown Location')"""

#: Files put into folders that a scan enters and such that it doesn't, and given names, by their number.
_PLACED = {
    11: ("'/lib/', '/lib/.hidden/'", "replace"),
    13: ("'/lib/', '/lib/Trash/'", "replace"),
    17: ("'$', '.txt'", "regexp_replace"),
    19: ("'/lib/', '/lib/trashcan-band/'", "replace"),
    23: ("'/([^/]*)$', '/Trashed-{0}1'", "regexp_replace"),
    29: ("'/lib/', '/lib/.git/'", "replace"),
    31: ("'/lib/', '/lib/__pycache__/'", "replace"),
    37: ("'/lib/', '/lib/$Recycle.Bin/'", "replace"),
}


def _placed(group: str, no: str) -> str:
    """CASE of the file's path; ``group`` is the sign of a group in a replacement."""
    ways = " ".join(f"WHEN {no} % {n} = 0 THEN {f}(file_path, {a.format(group)})" for n, (a, f) in _PLACED.items())
    return f"CASE {ways} ELSE file_path END"


def _scanned_paths(c) -> DataFrame:
    return c.media.select(F.expr(_placed("$", "media_no")).alias("file_path"))


_SCANNED_SQL = f", listing AS (SELECT {_placed(chr(92), 'media_no')} AS file_path, CASE {' '.join(f'WHEN media_no % {n} = 0 THEN {n}' for n in _PLACED)} ELSE 0 END AS kind FROM media)"

QUERIES = {
    # scans
    "all_media_paths": (lambda c, s, d: c.media.select("file_path"), " SELECT file_path FROM media"),
    "paths_in_folder": (lambda c, s, d: c.media.where(M.T.under_folder(F.col("path_key"), ROOT)).select("file_path"), f" SELECT file_path FROM media m WHERE {_UNDER}"),
    "media_by_path": (
        lambda c, s, d: _by_number(c, 33),
        """ SELECT m.file_path, m.last_modified, m.group_id, m.location_id, m.thumbnail_path, m.is_corrupted, m.is_in_trash, m.capture_date, m.file_hash,
  CAST(substr(m.capture_date, 1, 4) AS INTEGER) AS year, CAST(substr(m.capture_date, 6, 2) AS INTEGER) AS month, country, prefecture, city
FROM media m LEFT JOIN locations l ON m.location_id = l.location_id WHERE m.media_no = 33""",
    ),
    "faces_by_ids": (
        lambda c, s, d: P.faces_by_ids(c, _IDS),
        f" SELECT f.face_id, f.file_path, f.cluster_id, f.is_ignored, coalesce(m.capture_date, f.capture_date) AS capture_date, city, prefecture, country FROM faces f LEFT JOIN media m ON f.path_key = m.path_key LEFT JOIN locations l ON m.location_id = l.location_id WHERE f.face_id IN ({', '.join(map(str, _IDS))})",
    ),
    "faces_for_file": (
        lambda c, s, d: c.faces.join(c.media.where("media_no = 5").select("path_key"), "path_key", "left_semi").select("face_id", "file_path", "cluster_id"),
        " SELECT face_id, file_path, cluster_id FROM faces WHERE path_key = (SELECT path_key FROM media WHERE media_no = 5)",
    ),
    "faces_for_clustering": (lambda c, s, d: c.faces.select("face_id", "file_path", "cluster_id", "is_ignored"), " SELECT face_id, file_path, cluster_id, is_ignored FROM faces"),
    "ignored_faces": (lambda c, s, d: c.faces.where("is_ignored = 1").select("face_id"), " SELECT face_id FROM faces WHERE is_ignored = 1"),
    "salient_feature": (lambda c, s, d: c.features.where("file_path = 'vec/7'").select("file_path", F.size("vector").alias("n")), " SELECT file_path, CAST(len(vector) AS INTEGER) AS n FROM features WHERE file_path = 'vec/7'"),
    "media_signatures": (
        lambda c, s, d: M.signatures(c).select("file_path", "file_hash", "size", "discovery_method", "group_id"),
        " SELECT m.file_path, m.file_hash, m.size, g.discovery_method, CAST(NULL AS VARCHAR) AS group_id FROM media m LEFT JOIN features f ON m.file_path = f.file_path LEFT JOIN groups g ON m.group_id = g.group_id WHERE coalesce(m.file_hash, '') <> '' AND m.is_in_trash = 0",
    ),
    "settings_all": (lambda c, s, d: c.settings, " SELECT key, value FROM settings"),
    "setting_get": (lambda c, s, d: P.setting_get(c.settings, "theme", "light").union(P.setting_get(c.settings, "none", "light")), " SELECT value FROM settings WHERE key = 'theme' UNION ALL SELECT 'light'"),
    "setting_put": (lambda c, s, d: P.setting_put(c.settings, "theme", 3), " SELECT key, value FROM settings WHERE key <> 'theme' UNION ALL SELECT 'theme', '3'"),
    "scan_files": (lambda c, s, d: keep_scanned(_scanned_paths(c)), f"{_SCANNED_SQL} SELECT DISTINCT file_path FROM listing WHERE kind IN (0, 19, 23)"),
    "scan_files_trash": (lambda c, s, d: keep_scanned(_scanned_paths(c), include_trash=True), f"{_SCANNED_SQL} SELECT DISTINCT file_path FROM listing WHERE kind NOT IN (17, 29, 31)"),
    # filters
    "filter_media": (
        lambda c, s, d: M.filter_media(c, None, 1995, 6, include_trash=True, root="/lib/p1").select("file_path", "city"),
        f" SELECT m.file_path, city FROM media m LEFT JOIN locations l ON m.location_id = l.location_id WHERE {_SOUND} AND m.year = 1995 AND m.month = 6 AND starts_with(m.path_key, '/lib/p1/')",
    ),
    "filter_media_person": (
        lambda c, s, d: M.filter_media(c, PERSON, 1996).select("file_path"),
        f" SELECT m.file_path FROM media m WHERE m.is_in_trash = 0 AND m.year = 1996 AND {_PERSON}",
    ),
    "trash_predicates": (
        lambda c, s, d: c.media.agg(F.count_if(F.col("is_in_trash") == 0).alias("strict"), F.count_if(F.coalesce("is_in_trash", F.lit(0)) == 0).alias("lenient"), F.count_if(F.expr("is_corrupted = 1")).alias("corrupted"), F.count_if(F.expr(M.SOUND)).alias("sound")),
        " SELECT count(*) FILTER (is_in_trash = 0) AS strict, count(*) FILTER (coalesce(is_in_trash, 0) = 0) AS lenient, count(*) FILTER (is_corrupted = 1) AS corrupted, count(*) FILTER (coalesce(is_corrupted, 0) = 0) AS sound FROM media",
    ),
    "under_folder": (lambda c, s, d: c.faces.where(M.T.under_folder(F.col("path_key"), ROOT)).select("face_id"), f" SELECT face_id FROM faces m WHERE {_UNDER}"),
    "by_location": (
        lambda c, s, d: M.filter_media(c, location="CITY_3").select("file_path").union(M.filter_media(c, location="EUROPE").select("file_path")),
        f", j AS (SELECT * FROM media m JOIN locations l ON m.location_id = l.location_id WHERE m.is_in_trash = 0 AND {_SOUND}) SELECT file_path FROM j WHERE city = 'CITY_3' OR prefecture = 'CITY_3' OR country = 'CITY_3' UNION ALL SELECT file_path FROM j WHERE city = 'EUROPE' OR prefecture = 'EUROPE' OR country = 'EUROPE'",
    ),
    "by_discovery": (
        lambda c, s, d: M.filter_media(c, M.DUPLICATES, discovery="ai_local").select("file_path", "discovery_method"),
        f" SELECT m.file_path, discovery_method FROM media m JOIN groups g ON m.group_id = g.group_id WHERE m.is_in_trash = 0 AND {_SOUND} AND starts_with(discovery_method, 'ai_')",
    ),
    "faces_by_category": (
        lambda c, s, d: P.in_category(P.known(c.faces), "unknown").select("face_id"),
        " SELECT face_id FROM faces WHERE coalesce(cluster_id, -1) = -1 AND is_ignored = 0",
    ),
    "seek_media": (
        lambda c, s, d: M.seek_media(c.media, *_CURSOR).select("file_path"),
        f" SELECT file_path FROM media WHERE capture_date < '{_CURSOR[0]}' OR (capture_date = '{_CURSOR[0]}' AND file_path < '{_CURSOR[1]}')",
    ),
    "seek_faces": (
        lambda c, s, d: P.seek_faces(c.faces, _CURSOR[0], 500).select("face_id"),
        f" SELECT face_id FROM faces WHERE capture_date < '{_CURSOR[0]}' OR (capture_date = '{_CURSOR[0]}' AND face_id < 500)",
    ),
    "trash_by_path": (
        lambda c, s, d: c.media.where(M.T.in_trash_by_path(F.concat(F.expr("case when media_no % 5 = 0 then '/$Recycle.Bin' when media_no % 7 = 0 then '/my_trash' else '' end"), F.col("file_path")))).select("file_path"),
        " SELECT file_path FROM media WHERE media_no % 5 = 0 OR media_no % 7 = 0",
    ),
    "is_video": (lambda c, s, d: c.media.where(M.T.is_video(F.col("file_path"))).select("file_path"), " SELECT file_path FROM media WHERE file_path LIKE '%.mp4'"),
    "cache_valid": (
        lambda c, s, d: S.cache_valid(_listing(c), c, _thumbnails(c)),
        f", {_LISTING} SELECT l.path_key, coalesce(l.last_modified = m.last_modified AND m.file_hash IS NOT NULL AND t.thumbnail_path IS NOT NULL, false) AS valid FROM listing l LEFT JOIN media m ON l.path_key = m.path_key LEFT JOIN thumbs t ON m.thumbnail_path = t.thumbnail_path",
    ),
    "select_where": (lambda c, s, d: M.select_where(c.media, F.col("year") > 1995).groupBy("selected").count().withColumnRenamed("count", "n"), " SELECT coalesce(year > 1995, false) AS selected, count(*) AS n FROM media GROUP BY 1"),
    "select_by_threshold": (
        lambda c, s, d: M.select_where(c.faces.withColumn("similarity", F.expr("case when face_id % 7 <> 0 then det_score * 5 end")), F.col("similarity") >= 0.5).where("selected").select("face_id"),
        " SELECT face_id FROM faces WHERE face_id % 7 <> 0 AND det_score * 5 >= 0.5",
    ),
    "skip_assigned": (lambda c, s, d: c.faces.where(~F.col("cluster_id").eqNullSafe(F.lit(PERSON))).select("face_id"), f" SELECT face_id FROM faces WHERE cluster_id IS DISTINCT FROM {PERSON}"),
    "face_places": (
        lambda c, s, d: P.faces_joined(c, c.faces).groupBy("country", "prefecture", "city").agg(F.count("*").alias("n")),
        " SELECT country, prefecture, city, count(*) AS n FROM faces f LEFT JOIN media m ON f.path_key = m.path_key LEFT JOIN locations l ON m.location_id = l.location_id GROUP BY ALL",
    ),
    "sidebar_fast_then_full": (
        lambda c, s, d: P.person_list_fast(c).withColumn("phase", F.lit(1)).unionByName(P.person_list(c).withColumn("phase", F.lit(2))),
        " SELECT cluster_id, custom_name, CAST(0 AS BIGINT) AS faces, 1 AS phase FROM clusters WHERE is_ignored = 0 UNION ALL SELECT f.cluster_id, c.custom_name, count(*) AS faces, 2 FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.cluster_id WHERE f.is_ignored = 0 AND f.cluster_id >= 0 AND coalesce(c.is_ignored, 0) = 0 GROUP BY ALL",
    ),
    "capped_scan": (lambda c, s, d: c.faces.orderBy("face_id").limit(3000).select("face_id"), " SELECT face_id FROM faces ORDER BY face_id LIMIT 3000"),
    # joins
    "media_with_location": (lambda c, s, d: c.media.join(c.locations, "location_id", "left").select("file_path", "country", "city"), " SELECT file_path, country, city FROM media m LEFT JOIN locations l ON m.location_id = l.location_id"),
    "media_with_group": (lambda c, s, d: c.media.alias("m").join(c.groups.alias("g"), F.expr("lower(m.group_id) = lower(g.group_id)"), "left").select("file_path", "discovery_method"), " SELECT file_path, discovery_method FROM media m LEFT JOIN groups g ON lower(m.group_id) = lower(g.group_id)"),
    "media_with_features": (
        lambda c, s, d: c.features.join(c.media.selectExpr("concat('vec/', media_no) as file_path", "file_hash"), "file_path", "left").select("file_path", "file_hash"),
        " SELECT f.file_path, m.file_hash FROM features f LEFT JOIN media m ON f.file_path = concat('vec/', m.media_no)",
    ),
    "locations_inner": (lambda c, s, d: c.media.join(c.locations, "location_id").groupBy("prefecture").agg(F.count("*").alias("n")), " SELECT prefecture, count(*) AS n FROM media m JOIN locations l ON m.location_id = l.location_id GROUP BY 1"),
    "media_of_person": (lambda c, s, d: M.media_of_person(c, c.media, PERSON).select("file_path"), f" SELECT file_path FROM media m WHERE {_PERSON}"),
    "media_without_faces": (lambda c, s, d: M.filter_media(c, M.NO_FACES).select("file_path"), f" SELECT file_path FROM media m WHERE m.is_in_trash = 0 AND {_SOUND} AND NOT EXISTS (SELECT 1 FROM faces f WHERE f.path_key = m.path_key)"),
    "is_duplicate_flag": (lambda c, s, d: M.duplicate_flag(c.media).select("file_path", "is_duplicate"), f" SELECT m.file_path, {_FLAG} AS is_duplicate FROM media m"),
    "person_tags": (lambda c, s, d: M.person_tags(c), f", {_TAGS} SELECT path_key, tags FROM tags"),
    "faces_media_left": (lambda c, s, d: c.faces.join(c.media.select("path_key", "year"), "path_key", "left").groupBy("year").agg(F.count("*").alias("n")), " SELECT year, count(*) AS n FROM faces f LEFT JOIN media m ON f.path_key = m.path_key GROUP BY 1"),
    "faces_media_clusters": (
        lambda c, s, d: c.faces.join(c.media.select("path_key", "year"), "path_key", "left").join(c.clusters.select("cluster_id", "custom_name"), "cluster_id", "left").groupBy("custom_name", "year").agg(F.count("*").alias("n")),
        " SELECT custom_name, year, count(*) AS n FROM faces f LEFT JOIN media m ON f.path_key = m.path_key LEFT JOIN clusters c ON f.cluster_id = c.cluster_id GROUP BY ALL",
    ),
    "orphan_faces_media": (
        lambda c, s, d: P.orphan_faces_media(c.having(media=c.media.where(_LISTED))).select("face_id"),
        " SELECT face_id FROM faces WHERE path_key IN (SELECT path_key FROM media WHERE media_no % 41 = 0)",
    ),
    "orphan_faces_clusters": (lambda c, s, d: P.orphan_faces_clusters(c).select("face_id"), " SELECT face_id FROM faces WHERE cluster_id >= 0 AND cluster_id NOT IN (SELECT cluster_id FROM clusters)"),
    "empty_clusters": (lambda c, s, d: P.empty_clusters(c).select("cluster_id"), " SELECT cluster_id FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM faces WHERE cluster_id IS NOT NULL)"),
    # aggregates
    "years_facet": (lambda c, s, d: M.years_facet(c), _facet_sql("year", "true")),
    "years_facet_person": (lambda c, s, d: M.years_facet(c, PERSON), _facet_sql("year", _PERSON)),
    "months_facet": (lambda c, s, d: M.months_facet(c, None, 1995), _facet_sql("month", "m.year = 1995")),
    "locations_facet": (
        lambda c, s, d: M.locations_facet(c, M.DUPLICATES, 1995),
        f" SELECT city, count(*) AS n FROM media m JOIN locations l ON m.location_id = l.location_id WHERE {_SEEN} AND {_SOUND} AND m.group_id IS NOT NULL AND m.year = 1995 AND city IS NOT NULL GROUP BY 1",
    ),
    "facet_dispatch": (lambda c, s, d: M.facet(c, "months", None, 1996), _facet_sql("month", "m.year = 1996")),
    "drill_down": (
        lambda c, s, d: M.drill_down(c),
        f" SELECT 2 - grouping(month) - grouping(city) AS level, year, month, city, count(*) AS n FROM media m LEFT JOIN locations l ON m.location_id = l.location_id WHERE {_SEEN} AND {_SOUND} GROUP BY GROUPING SETS ((year), (year, month), (year, month, city))",
    ),
    "root_category_counts": (
        lambda c, s, d: M.root_counts(c),
        f", f AS (SELECT DISTINCT path_key FROM faces) SELECT count(*) AS total, count(*) FILTER (f.path_key IS NULL AND {_SOUND}) AS no_faces, count(*) FILTER (m.group_id IS NOT NULL AND {_SOUND}) AS duplicates, count(*) FILTER (m.is_corrupted = 1) AS corrupted FROM media m LEFT JOIN f ON m.path_key = f.path_key WHERE m.is_in_trash = 0",
    ),
    "duplicate_stats": (lambda c, s, d: M.duplicate_stats(c), f" SELECT count(DISTINCT group_id) AS groups, count(*) AS files FROM media m WHERE m.is_in_trash = 0 AND {_SOUND} AND group_id IS NOT NULL"),
    "duplicate_groups": (
        lambda c, s, d: M.duplicate_members(c),
        " SELECT m.group_id, count(*) OVER (PARTITION BY m.group_id) AS members, m.file_path, discovery_method FROM media m JOIN groups g ON m.group_id = g.group_id WHERE coalesce(m.file_hash, '') <> '' QUALIFY members > 1",
    ),
    "face_counts": (
        lambda c, s, d: P.face_counts(c),
        " SELECT CASE WHEN is_ignored = 1 THEN 'ignored' WHEN coalesce(cluster_id, -1) = -1 THEN 'unknown' ELSE CAST(cluster_id AS VARCHAR) END AS bucket, CAST(count(*) AS BIGINT) AS n FROM faces GROUP BY 1",
    ),
    "person_list": (
        lambda c, s, d: P.person_list(c),
        " SELECT f.cluster_id, c.custom_name, count(*) AS faces FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.cluster_id WHERE f.is_ignored = 0 AND f.cluster_id >= 0 AND coalesce(c.is_ignored, 0) = 0 GROUP BY ALL",
    ),
    "person_photo_counts": (lambda c, s, d: P.person_photo_counts(c), " SELECT cluster_id, count(DISTINCT path_key) AS photos FROM faces WHERE is_ignored = 0 AND cluster_id >= 0 GROUP BY 1"),
    "person_list_fast": (lambda c, s, d: P.person_list_fast(c), " SELECT cluster_id, custom_name, CAST(0 AS BIGINT) AS faces FROM clusters WHERE is_ignored = 0"),
    "multi_face_files": (lambda c, s, d: P.multi_face_files(c), " SELECT file_path, count(*) AS n FROM faces GROUP BY 1 HAVING n > 1"),
    "max_cluster_id": (lambda c, s, d: P.next_cluster_id(c), " SELECT max(cluster_id) + 1 AS next_id FROM clusters"),
    "orphan_counts": (
        lambda c, s, d: P.full_audit(c, _listing(c), _thumbnails(c)),
        f", {_LISTING} SELECT (SELECT count(*) FROM media WHERE path_key NOT IN (SELECT path_key FROM listing)) AS orphaned_media, (SELECT count(*) FROM faces WHERE cluster_id >= 0 AND cluster_id NOT IN (SELECT cluster_id FROM clusters)) AS orphaned_faces, (SELECT count(*) FROM media WHERE thumbnail_path IS NOT NULL AND is_in_trash = 0 AND thumbnail_path NOT IN (SELECT thumbnail_path FROM thumbs)) AS missing_thumbnails, (SELECT count(*) FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM faces WHERE cluster_id IS NOT NULL)) AS empty_clusters",
    ),
    "orphaned_media": (lambda c, s, d: P.orphaned_media(c, _listing(c)).agg(F.count("*").alias("n")), f", {_LISTING} SELECT count(*) AS n FROM media WHERE path_key NOT IN (SELECT path_key FROM listing)"),
    "missing_thumbnails": (
        lambda c, s, d: P.missing_thumbnails(c, _thumbnails(c)).agg(F.count("*").alias("n")),
        f", {_LISTING} SELECT count(*) AS n FROM media WHERE thumbnail_path IS NOT NULL AND is_in_trash = 0 AND thumbnail_path NOT IN (SELECT thumbnail_path FROM thumbs)",
    ),
    "ghost_groups": (
        lambda c, s, d: P.ghost_groups(c.having(media=c.media.where("media_no % 3 <> 0"))),
        " SELECT g.group_id, count(m.file_path) AS members FROM groups g LEFT JOIN (SELECT * FROM media WHERE media_no % 3 <> 0) m ON g.group_id = m.group_id GROUP BY 1 HAVING members < 2",
    ),
    "methods_distribution": (lambda c, s, d: P.methods_distribution(c), " SELECT discovery_method, count(*) AS n FROM groups GROUP BY 1"),
    "top_groups": (lambda c, s, d: P.top_groups(c), " SELECT group_id, count(*) AS members FROM media WHERE group_id IS NOT NULL GROUP BY 1 ORDER BY members DESC, group_id LIMIT 10"),
    "hash_dups": (lambda c, s, d: P.hash_dups(c), " SELECT file_hash, count(*) AS members FROM media GROUP BY 1 HAVING members > 1"),
    "visible_groups_in_root": (
        lambda c, s, d: P.visible_groups_in_root(c, "/lib/p1"),
        " SELECT group_id, count(*) AS members FROM media m WHERE group_id IS NOT NULL AND is_in_trash = 0 GROUP BY 1 HAVING members > 1 AND bool_or(starts_with(path_key, '/lib/p1/'))",
    ),
    # pages
    "media_page": (lambda c, s, d: _page(c, cluster_id=PERSON), _page_sql(f"m.is_in_trash = 0 AND {_PERSON}", _NEWEST, "LIMIT 100")),
    "media_page_all": (lambda c, s, d: _page(c, limit=50, offset=30), _page_sql(f"m.is_in_trash = 0 AND {_SOUND}", _NEWEST, "LIMIT 50 OFFSET 30")),
    "media_page_seek": (
        lambda c, s, d: _page(c, limit=60, last_date=_CURSOR[0], last_path=_CURSOR[1]),
        _page_sql(f"m.is_in_trash = 0 AND {_SOUND} AND (m.capture_date < '{_CURSOR[0]}' OR (m.capture_date = '{_CURSOR[0]}' AND m.file_path < '{_CURSOR[1]}'))", _NEWEST, "LIMIT 60"),
    ),
    "duplicates_page": (
        lambda c, s, d: _page(c, cluster_id=M.DUPLICATES, limit=80),
        _page_sql(f"m.is_in_trash = 0 AND {_SOUND} AND m.group_id IS NOT NULL", f"m.group_id ASC NULLS FIRST, m.is_in_trash ASC NULLS FIRST, {_NEWEST}", "LIMIT 80"),
    ),
    "corrupted_page": (lambda c, s, d: _page(c, cluster_id=M.CORRUPTED), _page_sql("m.is_in_trash = 0 AND m.is_corrupted = 1", _NEWEST, "LIMIT 100")),
    "page_result": (
        lambda c, s, d: M.page_result(_page(c, cluster_id=PERSON), 100),
        f" SELECT count(*) >= 100 AS has_more, arg_min(capture_date, k) AS next_date, arg_min(file_path, k) AS next_key FROM (SELECT capture_date, file_path, concat(coalesce(capture_date, ''), '|', file_path) AS k FROM media m WHERE m.is_in_trash = 0 AND {_PERSON} ORDER BY {_NEWEST} LIMIT 100)",
    ),
    "faces_page": (
        lambda c, s, d: P.faces_page(c, "person", PERSON, 100).select("face_id", "file_path", "cluster_id", "capture_date", F.col("place.city").alias("city")),
        f" SELECT f.face_id, f.file_path, f.cluster_id, f.capture_date, l.city FROM faces f LEFT JOIN media m ON f.path_key = m.path_key LEFT JOIN locations l ON m.location_id = l.location_id WHERE f.cluster_id = {PERSON} AND f.is_ignored = 0 ORDER BY f.capture_date DESC NULLS LAST, f.face_id DESC LIMIT 100",
    ),
    "section_headers": (
        lambda c, s, d: M.section_headers(_page(c, limit=200), M.page_order(None)).select("file_path", "day", "label", "is_header", "section"),
        f""", page AS (SELECT m.file_path, m.capture_date, l.country, l.prefecture, l.city FROM media m LEFT JOIN locations l ON m.location_id = l.location_id WHERE m.is_in_trash = 0 AND {_SOUND} ORDER BY {_NEWEST} LIMIT 200),
k AS (SELECT *, {_DAY} AS day, {_LABEL} AS label FROM page),
h AS (SELECT *, CASE WHEN lag(concat(day, '|', label)) OVER (ORDER BY capture_date DESC NULLS LAST, file_path DESC) IS DISTINCT FROM concat(day, '|', label) THEN 1 ELSE 0 END AS is_header FROM k)
SELECT file_path, day, label, is_header, CAST(sum(is_header) OVER (ORDER BY capture_date DESC NULLS LAST, file_path DESC) AS BIGINT) AS section FROM h""",
    ),
    "group_display_ids": (
        lambda c, s, d: M.group_display_ids(_page(c, limit=120), M.page_order(None)).select("file_path", "group_id", "display_id"),
        f""", page AS (SELECT m.file_path, m.group_id, row_number() OVER (ORDER BY {_NEWEST}) AS pos FROM media m WHERE m.is_in_trash = 0 AND {_SOUND} QUALIFY pos <= 120),
f AS (SELECT group_id, min(pos) AS first FROM page WHERE group_id IS NOT NULL GROUP BY 1), n AS (SELECT group_id, row_number() OVER (ORDER BY first) AS display_id FROM f)
SELECT p.file_path, p.group_id, CAST(n.display_id AS INTEGER) AS display_id FROM page p LEFT JOIN n ON p.group_id = n.group_id""",
    ),
    "contiguous_selection": (
        lambda c, s, d: M.section_headers(_page(c, limit=200), M.page_order(None)).where("section = 5").select("file_path"),
        f""", page AS (SELECT m.file_path, m.capture_date, l.country, l.prefecture, l.city FROM media m LEFT JOIN locations l ON m.location_id = l.location_id WHERE m.is_in_trash = 0 AND {_SOUND} ORDER BY {_NEWEST} LIMIT 200),
k AS (SELECT *, {_DAY} AS day, {_LABEL} AS label FROM page),
h AS (SELECT *, CASE WHEN lag(concat(day, '|', label)) OVER (ORDER BY capture_date DESC NULLS LAST, file_path DESC) IS DISTINCT FROM concat(day, '|', label) THEN 1 ELSE 0 END AS is_header FROM k),
s AS (SELECT file_path, sum(is_header) OVER (ORDER BY capture_date DESC NULLS LAST, file_path DESC) AS section FROM h) SELECT file_path FROM s WHERE section = 5""",
    ),
    "chunked_emit": (
        lambda c, s, d: M.chunk_numbers(_page(c, limit=200), M.page_order(None)).select("file_path", "chunk"),
        f" SELECT file_path, CAST(CASE WHEN pos <= 10 THEN 0 WHEN pos <= 40 THEN 1 ELSE 2 + floor((pos - 41) / 50) END AS INTEGER) AS chunk FROM (SELECT m.file_path, row_number() OVER (ORDER BY {_NEWEST}) AS pos FROM media m WHERE m.is_in_trash = 0 AND {_SOUND} QUALIFY pos <= 200)",
    ),
    "survivor_rank": (
        lambda c, s, d: M.survivor_rank(c.media.where("group_id is not null")).select("group_id", "file_path", "rank"),
        " SELECT group_id, file_path, CAST(row_number() OVER (PARTITION BY group_id ORDER BY (has_exif_date OR has_location) DESC, size DESC, file_path) AS INTEGER) AS rank FROM media WHERE group_id IS NOT NULL",
    ),
    "facet_order_string": (
        lambda c, s, d: M.months_facet(c, None, 1995).withColumn("place", F.row_number().over(M.Window.orderBy(F.col("month").cast("string")))).select("month", "place"),
        f", f AS ({_facet_sql('month', 'm.year = 1995')}) SELECT month, CAST(row_number() OVER (ORDER BY CAST(month AS VARCHAR)) AS INTEGER) AS place FROM f",
    ),
    "sort_by_date": (
        lambda c, s, d: c.faces.orderBy(F.coalesce("capture_date", F.lit("")).desc(), F.col("face_id").desc()).select("face_id", "capture_date"),
        " SELECT face_id, capture_date FROM faces",
    ),
    # files
    "read_gazetteer": (
        lambda c, s, d: _gazetteer(c, s),
        " SELECT prefecture AS city, location_id + 0.5::DOUBLE AS lat, -location_id - 0.25::DOUBLE AS lon, country, CASE WHEN location_id % 2 = 0 THEN concat('Region ', location_id) END AS region FROM locations WHERE location_id % 5 <> 4",
    ),
    "write_audit": (
        lambda c, s, d: _audited(c, s),
        " SELECT (SELECT count(*) FROM faces WHERE path_key NOT IN (SELECT path_key FROM media)) AS faces_media, (SELECT count(*) FROM faces f WHERE cluster_id >= 0 AND cluster_id NOT IN (SELECT cluster_id FROM clusters)) AS faces_clusters, (SELECT count(*) FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM faces WHERE cluster_id IS NOT NULL)) AS empty_clusters",
    ),
    # sets
    "catalogue_orphans": (lambda c, s, d: S.catalogue_orphans(c, _listing(c), "/lib/p1"), f", {_LISTING} SELECT file_path FROM media m WHERE starts_with(m.path_key, '/lib/p1/') AND path_key NOT IN (SELECT path_key FROM listing)"),
    "new_files": (lambda c, s, d: S.new_files(c, _listing(c)), f", {_LISTING} SELECT file_path FROM listing WHERE path_key NOT IN (SELECT path_key FROM media)"),
    "path_variants": (
        lambda c, s, d: S.path_variants(c.media.select("file_path").union(c.media.where("media_no % 20 = 3").select(F.upper("file_path"))), _listing(c)).select("path_key", "keep", F.array_join("merge", ",").alias("merge"), "orphan"),
        f""", {_LISTING}, p AS (SELECT file_path FROM media UNION ALL SELECT upper(file_path) FROM media WHERE media_no % 20 = 3),
g AS (SELECT lower(file_path) AS path_key, max(file_path) AS keep, list_distinct(list(file_path)) AS every FROM p GROUP BY 1)
SELECT path_key, keep, array_to_string(list_sort(list_filter(every, lambda x : x <> keep)), ',') AS merge, path_key NOT IN (SELECT path_key FROM listing) AS orphan FROM g WHERE len(every) > 1 OR path_key NOT IN (SELECT path_key FROM listing)""",
    ),
    "distinct_faces_paths": (lambda c, s, d: c.faces.select("file_path").distinct(), " SELECT DISTINCT file_path FROM faces"),
    "selected_paths_distinct": (lambda c, s, d: c.faces.where("det_score > 0.15").select("file_path").distinct(), " SELECT DISTINCT file_path FROM faces WHERE det_score > 0.15"),
    "events_per_window": (
        lambda c, s, d: events_per_window(s.read.parquet(f"{d}/events.parquet")),
        " SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "thumbnail_preload": (
        lambda c, s, d: S.thumbnail_preload(c, _thumbnails(c)),
        f", {_LISTING} SELECT file_path, thumbnail_path, CAST(floor((row_number() OVER (ORDER BY file_path) - 1) / 25) AS INTEGER) AS batch FROM media WHERE thumbnail_path IN (SELECT thumbnail_path FROM thumbs)",
    ),
}


def _by_number(c, number: int) -> DataFrame:
    """The row of a path, looked up as a caller would."""
    path = c.media.where(F.col("media_no") == number).select("file_path").first()
    return M.media_by_path(c, path[0] if path else "").drop("vector", "metadata_json")


def _gazetteer(c, spark) -> DataFrame:
    """Places written as a tab-separated gazetteer, some lines too short, and read again with region names."""
    path = new_path(spark, "gazetteer")
    blank = ["''"] * 19
    blank[1], blank[4], blank[5], blank[8], blank[10] = "prefecture", "location_id + 0.5", "-location_id - 0.25", "country", "concat('A', location_id)"
    line = F.expr(f"case when location_id % 5 = 4 then concat_ws('\\t', prefecture, country) else concat_ws('\\t', {', '.join(blank)}) end")
    c.locations.select(line.alias("value")).write.text(path)
    admin = c.locations.where("location_id % 2 = 0").select(F.expr("concat(country, '.A', location_id)").alias("code"), F.expr("concat('Region ', location_id)").alias("region"))
    return read_gazetteer(spark, path, admin).select("city", "lat", "lon", "country", "region")


def _audited(c, spark) -> DataFrame:
    """The audit's counts, written as JSON and read again."""
    path = new_path(spark, "audit")
    counts = [rows.agg(F.count("*").alias(name)) for name, rows in (("faces_media", P.orphan_faces_media(c)), ("faces_clusters", P.orphan_faces_clusters(c)), ("empty_clusters", P.empty_clusters(c)))]
    write_audit(counts[0].join(counts[1]).join(counts[2]), path)  # one row each
    return spark.read.schema("faces_media long, faces_clusters long, empty_clusters long").json(path)
