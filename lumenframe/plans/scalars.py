"""Scalar functions over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import dates as D
from lumenframe.functions import geo as G
from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators import media as M
from lumenframe.operators.blocks import chamfer_pairs
from lumenframe.operators.vectors import centroids
from lumenframe.sources.blobs import decode_vectors, encode_vectors

_DOT = "list_sum(list_transform(list_zip(a.vector, b.vector), lambda p : CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _vec(c):
    return c.features.select(F.col("vec_id").alias("id"), "vector")


def _vec_pairs(c):
    """Every vector with the one of the next id."""
    a = _vec(c).select(F.col("id").alias("a"), F.col("vector").alias("va"))
    b = _vec(c).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, "a")


def _windows_path(c):
    return c.media.select("media_no", F.expr("concat('C:', replace(file_path, '/', '\\\\'))").alias("raw"))


_PAIRS = " FROM features a JOIN features b ON a.vec_id + 1 = b.vec_id"

QUERIES = {
    "normalize_path": (
        lambda c, s, d: c.media.select("media_no", T.normalize_path(F.expr("concat(replace(upper(file_path), '/', '//'), case when media_no % 2 = 0 then '/' else '' end)")).alias("key")),
        " SELECT media_no, path_key AS key FROM media",
    ),
    "escape_like": (lambda c, s, d: c.media.select("media_no", T.escape_like(F.concat("file_path", F.lit("|%"))).alias("x")), " SELECT media_no, replace(replace(replace(concat(file_path, '|%'), '|', '||'), '_', '|_'), '%', '|%') AS x FROM media"),
    "substr_year_month": (
        lambda c, s, d: c.media.select("media_no", T.year_text(F.coalesce("capture_date", F.lit(""))).alias("y"), T.month_text(F.col("capture_date")).alias("m")),
        " SELECT media_no, TRY_CAST(substr(coalesce(capture_date, ''), 1, 4) AS INTEGER) AS y, TRY_CAST(substr(capture_date, 6, 2) AS INTEGER) AS m FROM media",
    ),
    "parse_tags": (
        lambda c, s, d: M.person_tags(c).select("path_key", F.array_join(F.transform(T.parse_tags(F.col("tags")), lambda x: F.concat(x["label"], F.lit("="), x["id"])), ";").alias("labels")),
        """, t AS (SELECT DISTINCT f.path_key, CAST(coalesce(f.cluster_id, -1) AS VARCHAR) AS id, coalesce(c.custom_name, '') AS name FROM faces f LEFT JOIN clusters c ON f.cluster_id = c.cluster_id WHERE coalesce(c.is_ignored, 0) = 0),
n AS (SELECT path_key, id, CASE WHEN name <> '' THEN name WHEN id = '-1' THEN 'Unknown' ELSE concat('Person ', id) END AS label FROM t)
SELECT path_key, string_agg(concat(label, '=', id), ';' ORDER BY label, id) AS labels FROM n GROUP BY 1""",
    ),
    "location_label": (
        lambda c, s, d: c.locations.select("location_id", T.location_label(F.expr("case when location_id % 4 = 0 then 'JP' when location_id % 4 = 1 then '' else country end"), F.col("prefecture"), F.col("city")).alias("label")),
        """ SELECT location_id, CASE WHEN location_id % 4 = 0 THEN concat_ws(', ', prefecture, city) WHEN location_id % 4 = 1 THEN coalesce(city, 'Unknown Location') ELSE concat_ws(', ', country, city) END AS label FROM locations""",
    ),
    "date_header": (
        lambda c, s, d: c.media.select("media_no", T.date_header(F.expr("case when media_no % 2 = 0 then replace(capture_date, ':', '-') else capture_date end")).alias("day")),
        " SELECT media_no, CASE WHEN capture_date IS NULL THEN 'Unknown Date' WHEN media_no % 2 = 0 THEN replace(split_part(capture_date, ' ', 1), ':', '/') ELSE split_part(capture_date, ' ', 1) END AS day FROM media",
    ),
    "size_text": (
        lambda c, s, d: c.media.select("media_no", T.size_text(F.col("size").cast("double")).alias("x")),
        " SELECT media_no, CASE WHEN size > 1048576 THEN printf('%.1f MB', size / 1048576.0) ELSE printf('%.1f KB', size / 1024.0) END AS x FROM media",
    ),
    "path_parts": (
        lambda c, s, d: c.media.select("media_no", T.base_name(F.col("file_path")).alias("base"), T.stem(F.col("file_path")).alias("stem"), T.extension(F.col("file_path")).alias("ext")),
        " SELECT media_no, split_part(file_path, '/', -1) AS base, CAST(media_no AS VARCHAR) AS stem, CASE WHEN media_no % 10 = 0 THEN '.mp4' ELSE '.jpg' END AS ext FROM media",
    ),
    "restore_path": (
        lambda c, s, d: c.media.select("media_no", T.restore_path(F.expr("concat('/root/.Trash/x/', media_no, '.jpg')")).alias("x")),
        " SELECT media_no, concat('/root/restore/', media_no, '.jpg') AS x FROM media",
    ),
    "collision_names": (
        lambda c, s, d: c.media.select("file_path", F.concat(F.lit("f"), (F.col("media_no") % 10).cast("string")).alias("stem"), F.row_number().over(M.Window.partitionBy(F.col("media_no") % 10).orderBy("file_path")).alias("n")).select(
            "file_path", F.when(F.col("n") == 1, F.concat("stem", F.lit(".jpg"))).otherwise(F.concat("stem", F.lit("_"), (F.col("n") - 1).cast("string"), F.lit(".jpg"))).alias("name")
        ),
        " SELECT file_path, CASE WHEN n = 1 THEN concat('f', k, '.jpg') ELSE concat('f', k, '_', n - 1, '.jpg') END AS name FROM (SELECT file_path, media_no % 10 AS k, row_number() OVER (PARTITION BY media_no % 10 ORDER BY file_path) AS n FROM media)",
    ),
    "person_names": (
        lambda c, s, d: c.clusters.select("cluster_id", T.person_name(F.col("custom_name"), F.col("cluster_id")).alias("shown"), T.person_name(F.lit(None).cast("string"), F.col("cluster_id"), 1).alias("made")),
        " SELECT cluster_id, coalesce(custom_name, concat('Person ', cluster_id)) AS shown, concat('Person ', cluster_id + 1) AS made FROM clusters",
    ),
    "exif_date": (
        lambda c, s, d: c.media.select("media_no", D.exif_date(F.expr("case when media_no % 3 = 0 then capture_date when media_no % 3 = 1 then 'broken' end"), F.col("last_modified")).alias("x")),
        " SELECT media_no, CASE WHEN media_no % 3 = 0 AND capture_date IS NOT NULL THEN capture_date ELSE strftime(to_timestamp(last_modified) AT TIME ZONE 'UTC', '%Y:%m:%d %H:%M:%S') END AS x FROM media",
    ),
    "iso_date": (
        lambda c, s, d: c.media.where("capture_date is not null").select("media_no", D.iso_date(F.expr("concat(translate(substr(capture_date, 1, 10), ':', '-'), 'T', substr(capture_date, 12), case when media_no % 2 = 0 then 'Z' else '.000000Z' end)")).alias("x")),
        " SELECT media_no, capture_date AS x FROM media WHERE capture_date IS NOT NULL",
    ),
    "year_backfill": (
        lambda c, s, d: c.media.select("media_no", D.backfill_year(F.expr("case when media_no % 2 = 0 then 0 else year end"), F.expr("case when media_no % 4 = 0 then 1990 end"), F.coalesce("capture_date", F.lit("x"))).alias("y")),
        " SELECT media_no, coalesce(CASE WHEN media_no % 2 <> 0 THEN year END, CASE WHEN media_no % 4 = 0 THEN 1990 END, TRY_CAST(substr(coalesce(capture_date, 'x'), 1, 4) AS INTEGER)) AS y FROM media",
    ),
    "dms_to_decimal": (
        lambda c, s, d: c.media.select("media_no", F.round(G.dms_to_decimal(F.expr("cast(case when media_no % 9 <> 0 then media_no % 90 end as double)"), F.expr("cast(media_no % 60 as double)"), F.expr("cast(media_no % 59 as double)"), F.expr("case when media_no % 2 = 0 then 'S' else 'N' end")), 9).alias("x")),
        " SELECT media_no, round(coalesce((media_no % 90 + (media_no % 60) / 60.0 + (media_no % 59) / 3600.0) * CASE WHEN media_no % 2 = 0 THEN -1 ELSE 1 END * CASE WHEN media_no % 9 <> 0 THEN 1 END, 0.0), 9) AS x FROM media",
    ),
    "iso6709": (
        lambda c, s, d: c.media.select("media_no", G.iso6709(F.expr("concat(case when media_no % 2 = 0 then '+' else '-' end, media_no % 90, '.5+', media_no % 180, '.25+010/')")).alias("p")).select("media_no", "p.lat", "p.lon"),
        " SELECT media_no, CASE WHEN media_no % 2 = 0 THEN 1 ELSE -1 END * (media_no % 90 + 0.5::DOUBLE) AS lat, media_no % 180 + 0.25::DOUBLE AS lon FROM media",
    ),
    "degree_distance": (
        lambda c, s, d: c.media.select("media_no", F.round(G.degree_distance(F.expr("cast(media_no % 90 as double)"), F.lit(1.5), F.lit(2.25), F.expr("cast(media_no % 180 as double)")), 9).alias("x")),
        " SELECT media_no, round(sqrt(pow(media_no % 90 - 2.25, 2) + pow(1.5 - media_no % 180, 2)), 9) AS x FROM media",
    ),
    "box_iou": (
        lambda c, s, d: c.faces.alias("a").join(c.faces.alias("b"), F.expr("a.path_key = b.path_key and a.face_id < b.face_id")).select(
            F.col("a.face_id").alias("a"), F.col("b.face_id").alias("b"), F.round(G.iou({k: F.col(f"a.{k}") for k in ("x1", "y1", "x2", "y2")}, {k: F.col(f"b.{k}") for k in ("x1", "y1", "x2", "y2")}), 9).alias("iou")
        ),
        """ SELECT a.face_id AS a, b.face_id AS b, round(CASE WHEN u > 0 THEN i / u ELSE 0.0 END, 9) AS iou FROM (
  SELECT a, b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
         (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i AS u
  FROM faces a JOIN faces b ON a.path_key = b.path_key AND a.face_id < b.face_id)""",
    ),
    "padded_box": (
        lambda c, s, d: c.faces.select("face_id", *[v.alias(k) for k, v in G.padded_box(*[F.floor(F.col(k)).cast("double") for k in ("x1", "y1", "x2", "y2")], 60.0, 60.0, 0.25).items()]),
        " SELECT face_id, CAST(floor(greatest(0.0, floor(x1) - (floor(x2) - floor(x1)) * 0.25)) AS INTEGER) AS \"left\", CAST(floor(greatest(0.0, floor(y1) - (floor(y2) - floor(y1)) * 0.25)) AS INTEGER) AS top, CAST(floor(least(60.0, floor(x2) + (floor(x2) - floor(x1)) * 0.25)) AS INTEGER) AS \"right\", CAST(floor(least(60.0, floor(y2) + (floor(y2) - floor(y1)) * 0.25)) AS INTEGER) AS bottom FROM faces",
    ),
    "thumb_scale": (
        lambda c, s, d: c.media.select("media_no", F.round(G.thumb_scale(F.expr("cast(media_no % 4000 + 1 as double)"), F.lit(1000.0)), 9).alias("x")),
        " SELECT media_no, round(least(256.0 / (media_no % 4000 + 1), 0.256), 9) AS x FROM media",
    ),
    "frame_positions": (
        lambda c, s, d: c.media.select("media_no", F.array_join(G.frame_positions(F.col("media_no"), 4), ",").alias("x")),
        " SELECT media_no, concat_ws(',', media_no * 1 // 5, media_no * 2 // 5, media_no * 3 // 5, media_no * 4 // 5) AS x FROM media",
    ),
    "vec_normalize": (lambda c, s, d: _vec(c).select("id", F.round(F.get(V.vec_normalize(F.transform("vector", lambda x: x * 3)), F.lit(0)), 5).alias("x")), " SELECT vec_id AS id, round(CAST(vector[1] AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda x : pow(CAST(x AS DOUBLE), 2)))), 5) AS x FROM features"),
    "vec_dot": (lambda c, s, d: _vec_pairs(c).select("a", "b", F.round(V.vec_dot(F.col("va"), F.col("vb")), 6).alias("x")), f" SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS x{_PAIRS}"),
    "vec_l2sq": (
        lambda c, s, d: _vec_pairs(c).select("a", "b", F.round(V.vec_l2sq(F.col("va"), F.col("vb")), 6).alias("x")),
        f" SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.vector, b.vector), lambda p : pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 6) AS x{_PAIRS}",
    ),
    "chamfer": (
        lambda c, s, d: chamfer_pairs(c.features.select(F.col("vec_id").alias("id"), V.patches(F.col("vector")).alias("patches"))).select("a", "b", F.round("similarity", 6).alias("x")),
        """, patch AS (SELECT vec_id AS id, i, list_transform(vector[i * 8 + 1 : i * 8 + 8], lambda x : CAST(x AS DOUBLE)) AS r FROM features, range(0, 8) t(i)),
u AS MATERIALIZED (SELECT id, i, list_transform(r, lambda x : x / sqrt(list_dot_product(r, r))) AS r FROM patch),
dots AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.i, b.i AS j, list_dot_product(a.r, b.r) AS x FROM u a JOIN u b ON a.id < b.id),
there AS (SELECT a, b, avg(x) AS x FROM (SELECT a, b, i, max(x) AS x FROM dots GROUP BY ALL) GROUP BY 1, 2),
back AS (SELECT a, b, avg(x) AS x FROM (SELECT a, b, j, max(x) AS x FROM dots GROUP BY ALL) GROUP BY 1, 2)
SELECT t.a, t.b, round((t.x + k.x) / 2, 6) AS x FROM there t JOIN back k ON t.a = k.a AND t.b = k.b""",
    ),
    "topk_patches": (
        lambda c, s, d: _vec(c).select("id", V.topk_patches(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("vector", i * 8 + 1, 8)), 3).alias("top")).select("id", F.size("top").alias("n"), F.round(F.aggregate("top", F.lit(0.0), lambda a, x: a + V.vec_norm(x)), 5).alias("x")),
        """, p AS (SELECT vec_id AS id, list_transform(range(0, 8), lambda i : sqrt(list_sum(list_transform(vector[i * 8 + 1 : i * 8 + 8], lambda x : pow(CAST(x AS DOUBLE), 2))))) AS l FROM features)
SELECT id, 3 AS n, round(list_sum(list_sort(l, 'DESC')[1:3]), 5) AS x FROM p""",
    ),
    "mean_pool": (
        lambda c, s, d: centroids(c.features.withColumn("file", F.col("vec_id") % 7), "file").select("file", "members", F.round(F.get("centroid", F.lit(0)), 5).alias("x")),
        """, u AS (SELECT vec_id % 7 AS file, list_transform(vector, lambda x : CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda y : CAST(y AS DOUBLE) * y)))) AS v FROM features),
p AS (SELECT file, i, avg(v[i]) AS x, count(*) AS members FROM u, range(1, 65) r(i) GROUP BY ALL)
SELECT file, CAST(max(members) AS BIGINT) AS members, round(max(x) FILTER (i = 1) / sqrt(sum(x * x)), 5) AS x FROM p GROUP BY 1""",
    ),
    "blob_codec": (lambda c, s, d: _blob(_vec(c)), " SELECT vec_id AS id, round(CAST(vector[1] AS DOUBLE), 6) AS x, CAST(256 AS INTEGER) AS bytes FROM features"),
    "json_decode": (
        lambda c, s, d: c.media.select("media_no", F.from_json("metadata_json", "size bigint, has_exif_date boolean, has_location boolean").alias("m")).select("media_no", "m.*"),
        " SELECT media_no, size, has_exif_date, has_location FROM media",
    ),
    "json_encode": (lambda c, s, d: c.media.select("media_no", F.to_json(F.struct("media_no", "is_corrupted")).alias("j")), " SELECT media_no, concat('{\"media_no\":', media_no, ',\"is_corrupted\":', is_corrupted, '}') AS j FROM media"),
    "json_field": (
        lambda c, s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("?")).alias("none")),
        " SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, '?' AS none FROM events",
    ),
    "content_hash": (lambda c, s, d: c.media.select("media_no", F.md5("file_path").alias("m"), T.thumbnail_key(F.col("file_path")).alias("k")), " SELECT media_no, md5(file_path) AS m, substr(sha256(file_path), 1, 16) AS k FROM media"),
    "pct_coerce": (lambda c, s, d: c.settings.select("key", T.pct_coerce(F.col("value"), 0.5).alias("x")), " SELECT key, CASE WHEN TRY_CAST(value AS DOUBLE) > 1 THEN TRY_CAST(value AS DOUBLE) / 100 ELSE coalesce(TRY_CAST(value AS DOUBLE), 0.5) END AS x FROM settings"),
    "to_bool": (lambda c, s, d: c.settings.select("key", T.to_bool(F.col("value")).alias("x")), " SELECT key, lower(value) = 'true' AS x FROM settings"),
}


def _blob(rows):
    """Vectors to little-endian bytes and back, at the ingest edge."""
    blobs = encode_vectors(rows, "vector", "blob")
    return decode_vectors(blobs, "blob", "back").select("id", F.round(F.get("back", F.lit(0)).cast("double"), 6).alias("x"), F.length("blob").alias("bytes"))
