"""Changes of the catalogue as functions from one catalogue to the next.

Each is a join of the table with its changes, so a batch of any size is one
plan; a list of ids that a caller types is broadcast, as it is as small as the
call itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog, UnknownAction
from lumenframe.functions import text as T
from lumenframe.operators.numbering import numbered
from lumenframe.operators.people import person_list

_UPDATED = ("last_modified", "metadata_json", "is_corrupted", "is_in_trash", "capture_date", "year", "month")
_KEPT = ("group_id", "location_id", "thumbnail_path", "file_hash")


def _listed(df: DataFrame, ids: list, name: str) -> DataFrame:
    kind = df.schema[name].dataType
    return F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], f"{name} {kind.simpleString()}"))


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each ``key``: the last by ``order``, of equal ones the greatest by the other columns."""
    rest = [F.desc_nulls_last(x.name) for x in batch.schema if x.name not in (key, order) and x.dataType.typeName() not in ("map", "variant")]
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), *rest)
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_media(c: Catalog, batch: DataFrame) -> Catalog:
    """Insert rows; on a known path overwrite, but keep what the batch leaves null of group, place, thumbnail and hash."""
    new = last_of_batch(batch.withColumn("path_key", T.normalize_path(F.col("file_path"))), "path_key", "last_modified")
    old, n = c.media.alias("o"), new.alias("n")
    both = old.join(n, F.expr("o.path_key = n.path_key"), "full")
    hit = F.col("n.path_key").isNotNull()
    columns = []
    for name in c.media.columns:
        if name not in new.columns:
            columns.append(F.col(f"o.{name}").alias(name))
        elif name in _KEPT or name in ("path_key", "file_path") or name not in _UPDATED:
            columns.append(F.coalesce(f"n.{name}", f"o.{name}").alias(name))
        else:
            columns.append(F.when(hit, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name))
    return c.having(media=both.select(*columns))


def upsert_features(c: Catalog, batch: DataFrame) -> Catalog:
    """New vectors win where they aren't null."""
    both = c.features.alias("o").join(batch.alias("n"), F.expr("o.file_path = n.file_path"), "full")
    columns = [F.coalesce(f"n.{x}", f"o.{x}").alias(x) if x in batch.columns else F.col(f"o.{x}").alias(x) for x in c.features.columns]
    return c.having(features=both.select(*columns))


def _place_key() -> Column:
    return F.concat_ws("\x01", *[F.coalesce(x, F.lit("")) for x in ("country", "prefecture", "city")])


def get_or_create_locations(c: Catalog, places: DataFrame) -> tuple[Catalog, DataFrame]:
    """Adds unseen places; returns ``country, prefecture, city, location_id`` of the given ones. Null equals empty; all-empty ones have no id."""
    wanted = places.select("country", "prefecture", "city").distinct().withColumn("key", _place_key()).where("replace(key, '\x01', '') <> ''")
    have = c.locations.withColumn("key", _place_key())
    new = wanted.join(have.select("key"), "key", "left_anti").dropDuplicates(["key"])
    top = c.locations.agg(F.coalesce(F.max("location_id"), F.lit(0)).alias("top"))
    new = numbered(new, "key").join(F.broadcast(top))  # one row
    added = new.select((F.col("top") + F.col("n")).cast("int").alias("location_id"), "country", "prefecture", "city")
    all_ = c.locations.unionByName(added)
    found = wanted.join(all_.withColumn("key", _place_key()).select("key", "location_id"), "key", "left").drop("key")
    return c.having(locations=all_), found


def merge_paths(c: Catalog, mapping: DataFrame) -> Catalog:
    """``old_key -> new_key``: faces and features move, old media rows go; a target's own features win."""
    m = F.broadcast(mapping) if mapping.count() <= 100_000 else mapping
    faces = c.faces.join(m, F.col("path_key") == F.col("old_key"), "left")
    faces = faces.withColumn("path_key", F.coalesce("new_key", "path_key")).drop("old_key", "new_key").select(*c.faces.columns)
    feats = c.features.join(m, F.col("file_path") == F.col("old_key"), "left").withColumn("own", F.col("new_key").isNull())
    feats = feats.withColumn("file_path", F.coalesce("new_key", "file_path"))
    w = Window.partitionBy("file_path").orderBy(F.col("own").desc(), F.col("old_key"))
    feats = feats.withColumn("n", F.row_number().over(w)).where("n = 1").select(*c.features.columns)
    media = c.media.join(m.select(F.col("old_key").alias("path_key")), "path_key", "left_anti")
    return c.having(media=media.select(*c.media.columns), faces=faces, features=feats)


def delete_media(c: Catalog, keys: list[str] | DataFrame) -> Catalog:
    """Rows, their features and their faces; of typed keys, or of a table of any size with ``path_key``."""
    gone = keys.select("path_key").distinct() if isinstance(keys, DataFrame) else _listed(c.media, [k.lower() for k in keys], "path_key")
    feats = c.features.join(gone, F.lower("file_path") == gone["path_key"], "left_anti")
    return c.having(media=c.media.join(gone, "path_key", "left_anti").select(*c.media.columns), faces=c.faces.join(gone, "path_key", "left_anti").select(*c.faces.columns), features=feats)


def release_from_groups(c: Catalog, keys: list[str]) -> Catalog:
    return c.having(media=c.media.withColumn("group_id", F.when(~F.col("path_key").isin([k.lower() for k in keys]), F.col("group_id"))))


def clear_ai_groups(c: Catalog, root: str | None = None) -> Catalog:
    """Ungroup what similarity grouped, in a folder or everywhere; everywhere, the groups go too. Exact groups stay."""
    ai = c.groups.where(F.startswith("discovery_method", F.lit("ai_"))).select("group_id", F.lit(1).alias("ai"))
    here = T.under_folder(F.col("path_key"), root) if root else F.lit(True)
    media = c.media.join(ai, "group_id", "left").withColumn("group_id", F.when(~(F.col("ai").isNotNull() & here), F.col("group_id"))).drop("ai")
    left = c.groups if root else c.groups.where(~F.startswith("discovery_method", F.lit("ai_")))
    return c.having(media=media.select(*c.media.columns), groups=left)


def persist_groups(c: Catalog, members: DataFrame) -> Catalog:
    """Store found groups (``component, path_key, method, rank, file_hash``); the best member's hash names a group."""
    best = members.where("rank = 1").select("component", F.coalesce("file_hash", F.concat(F.lit("ai_"), F.md5("path_key"))).alias("new_group"), F.col("method").alias("discovery_method"))
    named = members.select("component", "path_key").join(best, "component")
    media = c.media.join(named.select("path_key", "new_group"), "path_key", "left").withColumn("group_id", F.coalesce("new_group", "group_id")).drop("new_group")
    fresh = best.select(F.col("new_group").alias("group_id"), "discovery_method").join(c.groups.select("group_id"), "group_id", "left_anti").distinct()
    return c.having(media=media.select(*c.media.columns), groups=c.groups.unionByName(fresh))


def rename_cluster(c: Catalog, cluster_id: int, name: str) -> Catalog:
    """Rename, or register under that id."""
    spark = c.clusters.sparkSession
    new = spark.createDataFrame([(cluster_id, name)], "cluster_id long, new_name string")
    rows = c.clusters.join(F.broadcast(new), "cluster_id", "full")
    rows = rows.withColumn("custom_name", F.coalesce("new_name", "custom_name")).withColumn("is_ignored", F.coalesce("is_ignored", F.lit(0)))
    return c.having(clusters=rows.select(*c.clusters.columns))


def rename_person(c: Catalog, label: str, name: str) -> Catalog:
    """Rename the person whom lists show under ``label``: the first of several, and nobody if there is none."""
    shown = T.person_name(F.col("custom_name"), F.col("cluster_id"))
    hit = person_list(c).where(shown == label).limit(1).select("cluster_id", F.lit(name).alias("new_name"))
    rows = c.clusters.join(F.broadcast(hit), "cluster_id", "full")  # one row at most
    rows = rows.withColumns({"custom_name": F.coalesce("new_name", "custom_name"), "is_ignored": F.coalesce("is_ignored", F.lit(0))})
    return c.having(clusters=rows.select(*c.clusters.columns))


def create_cluster(c: Catalog, name: str, first: int = 1000) -> Catalog:
    """A person of this name: the one there is, or a new one under the next id."""
    same = c.clusters.agg(F.count_if(F.col("custom_name") == name).alias("same"), F.max("cluster_id").alias("top"))
    new = same.where("same = 0").select(F.coalesce(F.when(F.col("top") >= 0, F.col("top") + 1), F.lit(first)).cast("long").alias("cluster_id"), F.lit(name).alias("custom_name"), F.lit(0).alias("is_ignored"))
    return c.having(clusters=c.clusters.unionByName(new))


def assign_faces(c: Catalog, ids: list[int], cluster_id: int | None, ignored: int = 0) -> Catalog:
    hit = F.col("face_id").isin(ids)
    faces = c.faces.withColumns({"cluster_id": F.when(hit, F.lit(cluster_id).cast("long")).otherwise(F.col("cluster_id")), "is_ignored": F.when(hit, F.lit(ignored)).otherwise(F.col("is_ignored"))})
    return c.having(faces=faces)


def set_cluster_ignored(c: Catalog, cluster_id: int, ignored: int = 1) -> Catalog:
    hit = F.col("cluster_id") == cluster_id
    change = lambda df: df.withColumn("is_ignored", F.when(hit, F.lit(ignored)).otherwise(F.col("is_ignored")))
    return c.having(clusters=change(c.clusters), faces=change(c.faces))


def remove_faces(c: Catalog, ids: list[int]) -> Catalog:
    return c.having(faces=c.faces.join(_listed(c.faces, ids, "face_id"), "face_id", "left_anti").select(*c.faces.columns))


def delete_cluster(c: Catalog, cluster_id: int) -> Catalog:
    """The person goes; its faces belong to none (null, not unknown)."""
    faces = c.faces.withColumn("cluster_id", F.when(F.col("cluster_id") == cluster_id, F.lit(None)).otherwise(F.col("cluster_id")))
    return c.having(clusters=c.clusters.where(F.col("cluster_id") != cluster_id), faces=faces)


def delete_empty_clusters(c: Catalog) -> Catalog:
    return c.having(clusters=c.clusters.join(c.faces.select("cluster_id"), "cluster_id", "left_semi").select(*c.clusters.columns))


def clear_faces(c: Catalog, root: str | None = None) -> Catalog:
    """Faces below a folder, or all faces and persons."""
    if root:
        return c.having(faces=c.faces.where(~T.under_folder(F.col("path_key"), root)))
    return c.having(faces=c.faces.limit(0), clusters=c.clusters.limit(0))


def clear_all(c: Catalog) -> Catalog:
    """Everything but the settings."""
    return Catalog(*[getattr(c, n).limit(0) for n in ("media", "faces", "clusters", "locations", "groups", "features")], c.settings)


def clear_faces_for_file(c: Catalog, path: str) -> Catalog:
    return c.having(faces=c.faces.where(F.col("path_key") != path.lower()))


def ensure_clusters(c: Catalog, labels: DataFrame) -> Catalog:
    """Register labels that are no persons yet as ``Person n+1``."""
    new = labels.where("label >= 0").select(F.col("label").cast("long").alias("cluster_id")).distinct().join(c.clusters.select("cluster_id"), "cluster_id", "left_anti")
    new = new.select("cluster_id", T.person_name(F.lit(None).cast("string"), F.col("cluster_id"), 1).alias("custom_name"), F.lit(0).alias("is_ignored"))
    return c.having(clusters=c.clusters.unionByName(new))


def sync_capture_dates(c: Catalog) -> Catalog:
    dates = c.media.select("path_key", F.col("capture_date").alias("media_date"))
    faces = c.faces.join(dates, "path_key", "left").withColumn("capture_date", F.coalesce("capture_date", "media_date"))
    return c.having(faces=faces.select(*c.faces.columns))


def standardise_unknown(c: Catalog) -> Catalog:
    return c.having(faces=c.faces.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))))


def audit_cleanup(c: Catalog) -> Catalog:
    """Drop faces without file or person, then persons without faces."""
    faces = c.faces.join(c.media.select("path_key"), "path_key", "left_semi")
    lost = (F.col("cluster_id") >= 0) & F.col("known").isNull()
    faces = faces.join(c.clusters.select("cluster_id", F.lit(1).alias("known")), "cluster_id", "left").where(~F.coalesce(lost, F.lit(False)))
    return delete_empty_clusters(c.having(faces=faces.select(*c.faces.columns)))


def move_records(c: Catalog, moves: DataFrame, in_trash: int) -> Catalog:
    """``old_key, new_path``: rows live on under a new path with the trash flag set or cleared."""
    moved = c.media.join(moves, F.col("path_key") == F.col("old_key"), "left")
    hit = F.col("new_path").isNotNull()
    moved = moved.withColumns({"file_path": F.coalesce("new_path", "file_path"), "path_key": F.when(hit, F.lower("new_path")).otherwise(F.col("path_key")), "is_in_trash": F.when(hit, F.lit(in_trash)).otherwise(F.col("is_in_trash"))})
    return c.having(media=moved.select(*c.media.columns))


def cleanup_plan(ranked: DataFrame) -> DataFrame:
    """``file_path, action``: a group's best file is restored if it lies in the trash, the others go there."""
    action = F.when((F.col("rank") == 1) & (F.col("is_in_trash") == 1), "restore").when((F.col("rank") > 1) & (F.col("is_in_trash") == 0), "trash")
    return ranked.select("group_id", "file_path", action.alias("action")).where("action is not null")


def batch_delete_plan(c: Catalog, keys: list[str]) -> DataFrame:
    hit = c.media.where(F.col("path_key").isin([k.lower() for k in keys]) & (F.col("is_in_trash") == 0))
    return hit.select("file_path", F.lit("trash").alias("action"))


def normalise_all_paths(media: DataFrame) -> DataFrame:
    """Rewrite keys; of rows that meet, the last modified stays."""
    keyed = media.withColumn("path_key", T.normalize_path(F.col("file_path")))
    w = Window.partitionBy("path_key").orderBy(F.desc_nulls_last("last_modified"), F.desc("file_path"))
    return keyed.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def person_action(c: Catalog, action: str, ids: list[int] | None = None, cluster_id: int | None = None, name: str | None = None) -> Catalog:
    """Dispatch of what a user may do to faces and persons."""
    actions = {
        "register": lambda: assign_faces(rename_cluster(c, cluster_id, name), ids, cluster_id),
        "associate": lambda: assign_faces(c, ids, cluster_id),
        "ignore": lambda: assign_faces(c, ids, -1, 1),
        "unignore": lambda: assign_faces(c, ids, -1, 0),
        "ignore_person": lambda: set_cluster_ignored(c, cluster_id, 1),
        "rename": lambda: rename_cluster(c, cluster_id, name),
        "delete": lambda: delete_cluster(c, cluster_id),
        "delete_empty": lambda: delete_empty_clusters(c),
        "unregister": lambda: assign_faces(c, ids, -1),
        "merge": lambda: merge_clusters(c, ids, cluster_id),
    }
    if action not in actions:
        raise UnknownAction(action)
    return actions[action]()


def merge_clusters(c: Catalog, sources: list[int], target: int) -> Catalog:
    """All faces of ``sources`` go to ``target``, which takes the first name if it has none."""
    gone = [s for s in sources if s != target]
    hit = F.col("cluster_id").isin(gone)
    faces = c.faces.withColumn("cluster_id", F.when(hit, F.lit(target).cast("long")).otherwise(F.col("cluster_id")))
    name = c.clusters.where(hit & F.col("custom_name").isNotNull()).agg(F.min_by("custom_name", "cluster_id").alias("spare"))
    kept = c.clusters.where(~hit).join(F.broadcast(name))  # one row
    kept = kept.withColumn("custom_name", F.when(F.col("cluster_id") == target, F.coalesce("custom_name", "spare")).otherwise(F.col("custom_name"))).drop("spare")
    return c.having(faces=faces, clusters=kept.select(*c.clusters.columns))


def numbered_faces(c: Catalog, batch: DataFrame) -> DataFrame:
    """``batch`` with ``path_key`` and the next ids as ``face_id``."""
    top = c.faces.agg(F.coalesce(F.max("face_id"), F.lit(0)).alias("top"))
    new = numbered(batch, "file_path", "frame_index", "x1", "y1", "x2", "y2").join(F.broadcast(top))  # one row
    return new.withColumns({"face_id": F.col("top") + F.col("n"), "path_key": T.normalize_path(F.col("file_path"))}).drop("top", "n")


def add_faces(c: Catalog, batch: DataFrame) -> Catalog:
    """Append faces under the next ids."""
    return c.having(faces=c.faces.unionByName(numbered_faces(c, batch), allowMissingColumns=True).select(*c.faces.columns))
