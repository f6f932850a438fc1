"""Whole runs of the engine, composed of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog
from lumenframe.functions import text as T
from lumenframe.operators import mutations as X
from lumenframe.operators import vectors as V
from lumenframe.storage import cut_lineage


def regroup(c: Catalog, vectors: DataFrame, radius: float = 0.6, rerank: float | None = None, include_trash: bool = False) -> Catalog:
    """Clear similarity groups, find groups again from hashes and ``vectors`` (``id, file_path, vector``), and store them."""
    cleared = X.clear_ai_groups(c)
    media = cleared.media if include_trash else cleared.media.where("is_in_trash = 0")
    found = V.media_groups(media, vectors.join(media.select("file_path"), "file_path", "left_semi"), radius, rerank)
    return X.persist_groups(cleared, found.join(media.select("file_path", "path_key"), "file_path"))


def face_pipeline(
    c: Catalog,
    vectors: DataFrame,
    detections: DataFrame,
    folder: str,
    eps: float = 0.42,
    min_samples: int = 2,
    iou_limit: float = 0.45,
    similarity_limit: float = 0.88,
) -> tuple[Catalog, DataFrame]:
    """Detections of a folder become faces, its faces are clustered, and stored repeats go.

    ``vectors``: ``face_id, vector`` of stored faces; ``detections``: ``id,
    file_path, path_key, frame_index, x1, y1, x2, y2, det_score, vector``, new
    ids and unknown person given here.  Returns the next catalogue and the
    vectors of its faces.
    """
    kept = V.detected_faces(detections, iou_limit, similarity_limit)
    fresh = X.numbered_faces(c, kept.drop("id", "path_key").withColumns({"cluster_id": F.lit(-1).cast("long"), "is_ignored": F.lit(0)}))
    fresh = cut_lineage(fresh, "new-faces")
    faces = c.faces.unionByName(fresh.drop("vector"), allowMissingColumns=True).select(*c.faces.columns)
    vectors = vectors.select("face_id", "vector").union(fresh.select("face_id", "vector"))

    here = faces.where(T.under_folder(F.col("path_key"), folder))
    # names of faces meet before vectors do: a semi join goes below what makes the vectors, so those of other folders never move
    own = cut_lineage(vectors.join(here.select("face_id"), "face_id", "left_semi"), "folder-vectors")
    rows = lambda df, of: of.join(df.select("face_id"), "face_id", "left_semi").select(F.col("face_id").alias("id"), "vector")
    plan = V.cluster_faces(rows(here.where("coalesce(is_ignored, 0) = 0"), own), rows(faces.where("is_ignored = 1"), vectors), eps, min_samples)
    plan = cut_lineage(plan.where("label >= 0"), "face-labels")
    named = X.ensure_clusters(c.having(faces=faces), plan)
    label = plan.select(F.col("id").alias("face_id"), F.col("label").cast("long").alias("label"))
    faces = named.faces.join(label, "face_id", "left").withColumn("cluster_id", F.coalesce("label", "cluster_id")).select(*c.faces.columns)

    here = faces.where(T.under_folder(F.col("path_key"), folder))
    gone = cut_lineage(V.stored_face_dedup(here, own, iou_limit, similarity_limit), "repeated-faces")
    left = faces.join(gone, "face_id", "left_anti").select(*c.faces.columns)
    return named.having(faces=left), vectors.join(gone, "face_id", "left_anti")
