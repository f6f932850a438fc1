"""The catalogue over the star-schema test tables, and the same mapping as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog

SETTINGS = (("face_eps", "0.42"), ("face_min_samples", "2"), ("merge_threshold", "60"), ("show_trash", "True"), ("theme", "dark"))
_FACE_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr(
        "n_nationkey as location_id", "r_name as country", "n_name as prefecture", "case when n_nationkey % 6 = 5 then null else concat('CITY_', n_nationkey) end as city"
    )


def media(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    dated = "o_orderkey % 97 <> 0"
    rows = raw.selectExpr(
        "concat('/lib/p', substr(o_orderpriority, 1, 1), '/c_', o_custkey % 50, '/', o_orderkey, case when o_orderkey % 10 = 0 then '.mp4' else '.jpg' end) as file_path",
        "o_orderkey as media_no",
        "cast(unix_timestamp(o_orderdate) as double) as last_modified",
        "cast(floor(o_totalprice * 100) as bigint) as size",
        "o_orderkey % 3 = 0 as has_exif_date",
        "o_orderkey % 7 <> 0 as has_location",
        "case when o_orderkey % 7 <> 0 then c_nationkey end as location_id",
        "case when o_orderkey % 53 = 0 then 1 else 0 end as is_corrupted",
        "case when o_orderstatus = 'P' and o_orderkey % 4 = 0 then 1 else 0 end as is_in_trash",
        f"case when {dated} then date_format(o_orderdate, 'yyyy:MM:dd HH:mm:ss') end as capture_date",
        f"case when {dated} then year(o_orderdate) end as year",
        f"case when {dated} then month(o_orderdate) end as month",
        "md5(concat(o_custkey, '|', year(o_orderdate))) as file_hash",
        "case when o_orderkey % 5 <> 0 then concat('/thumbs/', substr(sha2(cast(o_orderkey as string), 256), 1, 16), '.jpg') end as thumbnail_path",
    )
    rows = rows.withColumn("path_key", F.lower("file_path"))
    meta = F.to_json(F.struct("size", "has_exif_date", "has_location"))
    held = F.count("*").over(Window.partitionBy("file_hash"))
    return rows.withColumn("metadata_json", meta).withColumn("group_id", F.when(held > 1, F.col("file_hash")))


def faces(spark: SparkSession, d: str, media_rows: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_FACE_ORDER))
    raw = table(spark, d, "lineitem").withColumn("face_id", F.col("l_orderkey") * 1000 + number)
    return raw.join(media_rows.select("media_no", "file_path", "path_key", "capture_date"), F.expr("l_orderkey = media_no")).selectExpr(
        "face_id",
        "file_path",
        "path_key",
        "case when l_suppkey % 10 = 0 then -1 when l_suppkey % 17 = 0 then null when l_suppkey % 13 = 0 then l_suppkey + 1000 else l_suppkey end as cluster_id",
        "case when l_returnflag = 'R' and l_linestatus = 'F' and l_suppkey % 3 = 0 then 1 else 0 end as is_ignored",
        "l_linenumber as frame_index",
        "l_quantity as x1",
        "100 * l_discount as y1",
        "l_quantity + 10 + l_linenumber as x2",
        "100 * l_discount + 10 + 100 * l_tax as y2",
        "l_discount + l_tax as det_score",
        "capture_date",
    )


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey as cluster_id", "case when s_suppkey % 5 <> 0 then s_name end as custom_name", "case when s_suppkey % 11 = 0 then 1 else 0 end as is_ignored"
    )


def groups(media_rows: DataFrame) -> DataFrame:
    found = media_rows.where("group_id is not null").select("group_id").distinct()
    first = F.substring("group_id", 1, 1)
    return found.withColumn("discovery_method", F.when(first <= "9", "exact").when(first <= "c", "ai_local").otherwise("ai_local_video"))


def features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("concat('vec/', vec_id) as file_path", "vec_id", "embedding as vector", "label")


def numbered_faces(c: Catalog) -> DataFrame:
    """Faces with ``vec_id``: every face gets one of the test embeddings; frames of a file share some."""
    held = c.features.agg(F.count("*").alias("held"))
    number = F.expr("(face_id div 1000 * 7 + face_id % 1000 div 2) % held")
    return c.faces.join(F.broadcast(held)).withColumn("vec_id", number).drop("held")  # one row


def face_vectors(c: Catalog) -> DataFrame:
    """``face_id, vector``."""
    return numbered_faces(c).select("face_id", "vec_id").join(c.features.select("vec_id", "vector"), "vec_id").select("face_id", "vector")


def catalog(spark: SparkSession, d: str) -> Catalog:
    m = media(spark, d)
    return Catalog(
        media=m,
        faces=faces(spark, d, m),
        clusters=clusters(spark, d),
        locations=locations(spark, d),
        groups=groups(m),
        features=features(spark, d),
        settings=spark.createDataFrame(list(SETTINGS), "key string, value string"),
    )


#: The same tables for DuckDB; a query is appended to them.
SQL = """
WITH RECURSIVE locations AS (
  SELECT n_nationkey AS location_id, r_name AS country, n_name AS prefecture,
         CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE concat('CITY_', n_nationkey) END AS city
  FROM nation JOIN region ON n_regionkey = r_regionkey),
media_rows AS (
  SELECT concat('/lib/p', substr(o_orderpriority, 1, 1), '/c_', o_custkey % 50, '/', o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '.mp4' ELSE '.jpg' END) AS file_path,
         o_orderkey AS media_no, CAST(epoch(o_orderdate) AS DOUBLE) AS last_modified, CAST(floor(o_totalprice * 100) AS BIGINT) AS size,
         o_orderkey % 3 = 0 AS has_exif_date, o_orderkey % 7 <> 0 AS has_location,
         CASE WHEN o_orderkey % 7 <> 0 THEN c_nationkey END AS location_id,
         CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END AS is_corrupted,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_in_trash,
         CASE WHEN o_orderkey % 97 <> 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS capture_date,
         CASE WHEN o_orderkey % 97 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
         CASE WHEN o_orderkey % 97 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
         md5(concat(o_custkey, '|', year(o_orderdate))) AS file_hash,
         CASE WHEN o_orderkey % 5 <> 0 THEN concat('/thumbs/', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16), '.jpg') END AS thumbnail_path
  FROM orders JOIN customer ON o_custkey = c_custkey),
media AS (
  SELECT *, lower(file_path) AS path_key, CASE WHEN count(*) OVER (PARTITION BY file_hash) > 1 THEN file_hash END AS group_id FROM media_rows),
faces AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS face_id,
         file_path, path_key,
         CASE WHEN l_suppkey % 10 = 0 THEN -1 WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_suppkey % 13 = 0 THEN l_suppkey + 1000 ELSE l_suppkey END AS cluster_id,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS is_ignored,
         l_linenumber AS frame_index, l_quantity AS x1, 100 * l_discount AS y1, l_quantity + 10 + l_linenumber AS x2,
         100 * l_discount + 10 + 100 * l_tax AS y2, l_discount + l_tax AS det_score, capture_date
  FROM lineitem JOIN media ON l_orderkey = media_no),
clusters AS (
  SELECT s_suppkey AS cluster_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS custom_name, CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS is_ignored FROM supplier),
groups AS (
  SELECT DISTINCT group_id, CASE WHEN substr(group_id, 1, 1) <= '9' THEN 'exact' WHEN substr(group_id, 1, 1) <= 'c' THEN 'ai_local' ELSE 'ai_local_video' END AS discovery_method
  FROM media WHERE group_id IS NOT NULL),
features AS (SELECT concat('vec/', vec_id) AS file_path, vec_id, embedding AS vector, label FROM embeddings),
settings(key, value) AS (VALUES ('face_eps', '0.42'), ('face_min_samples', '2'), ('merge_threshold', '60'), ('show_trash', 'True'), ('theme', 'dark'))
"""
