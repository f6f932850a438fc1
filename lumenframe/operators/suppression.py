"""Greedy suppression: in each group and in order, an item stays if it conflicts with none that stayed before.

Groups of up to FEW items, as a frame's faces are, are folded in one row.  Larger
ones go in rounds, each of three steps that give the sequential result: the first
HEAD live items of every group are settled among themselves by tiles of matrix
operations; those that stay meet the group's other items in blocks, which are
spread over tasks; items that conflict with one of them go, the rest live on.  A
task holds two blocks at most, however large the group is, and no pairs are
written.  A round takes at least HEAD - HEAD / STEPS live items of a group (or all),
so rounds are few where much conflicts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import geo
from lumenframe.functions import text as T
from lumenframe.functions import vectors as V
from lumenframe.operators.blocks import matrix
from lumenframe.operators.numbering import ranked
from lumenframe.storage import cut_lineage, drop, shuffles_dropped

FEW = 64
HEAD = 8192
STEPS = 16
_TILE = 256
_PARTS = 32


@dataclass(frozen=True)
class Conflict:
    """When two items conflict, by what is compared (an array of doubles): as a column, and of two blocks as a matrix.

    Nulls and NaN conflict with nothing.
    """

    what: Column
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


def overlap(limit: float) -> Conflict:
    """Boxes x1, y1, x2, y2 with an intersection over union beyond ``limit``."""

    def box(p: Column) -> dict[str, Column]:
        return {k: F.get(p, i) for i, k in enumerate(("x1", "y1", "x2", "y2"))}

    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = a.T[:, :, None], b.T[:, None, :]
        w = np.maximum(0, np.minimum(p[2], q[2]) - np.maximum(p[0], q[0]))
        h = np.maximum(0, np.minimum(p[3], q[3]) - np.maximum(p[1], q[1]))
        union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(union > 0, w * h / union, 0) > limit

    return Conflict(F.array(*[F.col(k).cast("double") for k in ("x1", "y1", "x2", "y2")]), lambda a, b: geo.iou(box(a), box(b)) > limit, block)


def alike(limit: float, slack: float = 0.0) -> Conflict:
    """Vectors whose cosine is beyond ``limit``; ``slack`` is added to their lengths."""

    def length(p: Column) -> Column:
        return V.vec_norm(p) + slack

    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        norm = lambda x: np.sqrt((x * x).sum(axis=1)) + slack
        with np.errstate(invalid="ignore", divide="ignore"):
            return a @ b.T / (norm(a)[:, None] * norm(b)[None, :]) > limit

    return Conflict(F.col("vector").cast("array<double>"), lambda a, b: V.vec_dot(a, b) / (length(a) * length(b)) > limit, block)


def settle(items: np.ndarray, conflict: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which of the items, in their order, stay."""
    live = np.ones(len(items), dtype=bool)
    for start in range(0, len(items), _TILE):
        tile = start + np.flatnonzero(live[start : start + _TILE])
        meets = conflict(items[tile], items[tile])
        for i in range(len(tile)):
            if live[tile[i]]:
                live[tile[i + 1 :][meets[i, i + 1 :]]] = False
        _drop_rivals(items[tile[live[tile]]], items, live, conflict, start + _TILE)
    return live


def _drop_rivals(stay: np.ndarray, items: np.ndarray, live: np.ndarray, conflict, start: int = 0) -> None:
    """Items from ``start`` on that conflict with one of ``stay`` live no more."""
    for at in range(start, len(items), 4 * _TILE):
        left = at + np.flatnonzero(live[at : at + 4 * _TILE])
        for tile in range(0, len(stay), _TILE):
            if not len(left):
                break
            hit = conflict(stay[tile : tile + _TILE], items[left]).any(axis=0)
            live[left[hit]] = False
            left = left[~hit]


def _folded(rows: DataFrame, by: str, order: list[Column], item: str, conflict: Conflict) -> DataFrame:
    """A fold over the places of each group's sorted items; only places are remembered."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(item).alias("item"), conflict.what.alias("what"))
    groups = rows.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("items"))
    what = lambda i: F.get("items", i)["what"]

    def step(kept: Column, i: Column) -> Column:
        return F.when(F.exists(kept, lambda k: conflict.column(what(k), what(i))), kept).otherwise(F.array_append(kept, i))

    places = F.aggregate(F.sequence(F.lit(0), F.size("items") - 1), F.array().cast("array<int>"), step)
    kept = groups.withColumn("places", places)
    out = kept.select(by, F.explode(F.transform("items", lambda s, i: F.struct(s["item"].alias(item), F.array_contains("places", i).alias("kept")))).alias("item"))
    return out.select(by, "item.*")


def _beside(rows: DataFrame, other: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """A join on ``by`` in which null is a group like any other."""
    met = rows.join(other.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), how)
    return met.drop("__by")


def _in_rounds(rows: DataFrame, by: str, order: list[Column], item: str, conflict: Conflict, head: int) -> DataFrame:
    kind = f"`{by}` {rows.schema[by].dataType.simpleString()}, item {rows.schema[item].dataType.simpleString()}"
    narrow = rows.select(by, *[c.alias(f"__o{i}") for i, c in enumerate(order)], F.col(item).alias("item"), conflict.what.alias("what"))
    placed = ranked(narrow, by, *[f"__o{i}" for i in range(len(order))], "item", name="n").select(by, "n", "item", "what")
    first = live = cut_lineage(placed, "suppression-live")
    ends = []
    step, block = max(1, head // STEPS), conflict.block

    def settled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        return table.select([by, "item", "what"]).append_column("kept", pa.array(settle(matrix(table.column("what")), block)))

    def rivals(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        still = np.ones(left.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            _drop_rivals(matrix(right.column("what")), matrix(left.column("what")), still, block)
        return left.select([by, "n", "item", "what"]).append_column("live", pa.array(still))

    while True:
        # places are counted by steps, so that the bound of a head comes from few rows
        held = live.groupBy(by, F.floor(F.col("n") / step).alias("at")).agg(F.count("*").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(by).orderBy("at"))
        bounds = held.withColumn("upto", upto).groupBy(by).agg(F.min(F.when(F.col("upto") > head, F.col("at") * step)).alias("until"))
        bounds = cut_lineage(bounds, "suppression-bounds")
        bound = _beside(live, bounds, by)
        heads = bound.where("until is null or n < until").select(by, "n", "item", "what")
        heads = cut_lineage(heads.groupBy(by).applyInArrow(settled, f"{kind}, what array<double>, kept boolean"), "suppression-heads")
        ends.append(heads.select(by, F.col("item").alias(item), "kept"))
        if bounds.where("until is not null").isEmpty():
            drop(bounds)
            break
        rest = bound.where("n >= until").withColumn("block", F.floor(F.col("n") / head)).select(by, "block", "n", "item", "what")
        part = F.pmod(F.xxhash64("item"), F.lit(_PARTS))
        blocks = cut_lineage(rest.select(by, "block").distinct(), "suppression-blocks")
        targets = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
        near = heads.where("kept").select(F.col(by).alias("__by"), part.alias("__part"), "what")
        near = targets.join(near, F.col(by).eqNullSafe(F.col("__by")) & (F.col("part") == F.col("__part"))).select(by, "block", "what")
        met = rest.groupBy(by, "block").cogroup(near.groupBy(by, "block")).applyInArrow(rivals, f"{kind.replace(', item', ', n long, item')}, what array<double>, live boolean")
        met = cut_lineage(met, "suppression-met")
        ends.append(met.where("not live").select(by, F.col("item").alias(item), F.lit(False).alias("kept")))
        drop(bounds, blocks)
        live = met.where("live").drop("live")
        if live.isEmpty():
            break
    drop(first)  # heads and what met them are read by the result
    out = ends[0]
    for more in ends[1:]:
        out = out.union(more)
    return out


def large_groups(rows: DataFrame, by: str, few: int = FEW) -> DataFrame | None:
    """``by`` of groups of over ``few`` rows, if there are any."""
    large = cut_lineage(rows.groupBy(by).agg(F.count("*").alias("__size")).where(F.col("__size") > few).select(by), "suppression-large")
    if large.isEmpty():
        drop(large)
        return None
    return large


def greedy_keep(rows: DataFrame, by: str, order: list[Column], item: str, conflict: Conflict, large: DataFrame | None, head: int = HEAD) -> DataFrame:
    """``by, item, kept`` for all items; null is a group of its own. ``large`` groups go in rounds."""
    if large is None:
        return _folded(rows, by, order, item, conflict)
    return _folded(_beside(rows, large, by, "left_anti"), by, order, item, conflict).union(_in_rounds(_beside(rows, large, by, "left_semi"), by, order, item, conflict, head))


def spatial_nms(faces: DataFrame, limit: float = 0.45, few: int = FEW, head: int = HEAD) -> DataFrame:
    """Overlapping boxes of one frame: the better detection stays. ``frame, face_id, kept``."""
    rows = faces.withColumn("frame", F.concat_ws("#", "path_key", "frame_index"))
    return greedy_keep(rows, "frame", [-F.col("det_score"), F.col("face_id")], "face_id", overlap(limit), large_groups(rows, "frame", few), head)


def temporal_nms(rows: DataFrame, limit: float = 0.88, by: str = "file", few: int = FEW, head: int = HEAD) -> DataFrame:
    """Similar faces of one file's frames: the better detection stays. Zero vectors are dropped. ``by, id, kept``."""
    large = large_groups(rows, by, few)
    rows = rows.where(V.vec_norm(F.col("vector")) > 0)
    return greedy_keep(rows, by, [-F.col("det_score"), F.col("id")], "id", alike(limit), large, head)


def stored_face_dedup(faces: DataFrame, vectors: DataFrame, iou_limit: float = 0.45, similarity_limit: float = 0.88, few: int = FEW, head: int = HEAD) -> DataFrame:
    """Stored faces to remove: those that overlap (photos) or resemble (videos) an earlier one of their file.

    ``vectors``: ``face_id, vector``; a face without one is left alone.
    """
    large = large_groups(faces, "path_key", few)
    rows = faces.join(vectors.select("face_id", "vector").where("vector is not null"), "face_id")
    photo = greedy_keep(rows.where(~T.is_video(F.col("path_key"))), "path_key", [F.col("face_id")], "face_id", overlap(iou_limit), large, head)
    video = greedy_keep(rows.where(T.is_video(F.col("path_key"))), "path_key", [F.col("face_id")], "face_id", alike(similarity_limit, 1e-6), large, head)
    return photo.where("not kept").select("face_id").union(video.where("not kept").select("face_id"))


def _kept_in_frames(detections: DataFrame, limit: float) -> DataFrame:
    """``ids, keys`` of each file's detections that stay in their frames, the better first; without a key they are left out.

    A file is one row: an overlap counts inside a frame only, and both kinds of suppression go by one order.
    """
    sides = "x1", "y1", "x2", "y2"
    box = lambda p: {k: p[k] for k in sides}
    item = F.struct((-F.col("det_score")).alias("o"), "id", "key", F.col("frame_index").alias("frame"), *[F.col(k).cast("double").alias(k) for k in sides])
    files = detections.groupBy("path_key").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(kept: Column, p: Column) -> Column:
        hit = F.exists(kept, lambda k: k["frame"].eqNullSafe(p["frame"]) & (geo.iou(box(k), box(p)) > limit))
        return F.when(hit, kept).otherwise(F.array_append(kept, p))

    none = F.filter("items", lambda p: F.lit(False))
    alone = F.size(F.array_distinct(F.transform("items", lambda p: p["frame"]))) == F.size("items")
    stay = files.select(F.when(alone, F.col("items")).otherwise(F.aggregate("items", none, step)).alias("items"))
    stay = stay.select(F.filter("items", lambda p: p["key"].isNotNull()).alias("items")).where(F.size("items") > 0)
    return stay.select(F.transform("items", lambda p: p["id"]).alias("ids"), F.transform("items", lambda p: p["key"]).alias("keys"))


def _key_pairs(keys: str) -> Column:
    """Every two keys of a file, each with itself too, as ``a <= b``."""
    one = F.array_distinct(keys)
    two = lambda x: F.transform(F.filter(one, lambda y: x <= y), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.explode(F.flatten(F.transform(one, two))).alias("p")


def detected_ids(detections: DataFrame, vectors: DataFrame, iou_limit: float = 0.45, similarity_limit: float = 0.88, few: int = FEW, head: int = HEAD) -> DataFrame:
    """``id`` of detections that survive suppression inside a frame and across a file's frames.

    ``detections``: ``id, path_key, frame_index, x1, y1, x2, y2, det_score, key``; ``vectors``: ``key, vector``, a row for
    each key, which many detections may share.  Detections move once and without vectors; a vector goes to each
    other one that it meets in some file, once however many files that are.  Without a vector, or with a zero one,
    a detection goes after its frame was judged.
    """
    detections = detections.select("id", "path_key", "frame_index", "x1", "y1", "x2", "y2", "det_score", "key")
    large = large_groups(detections, "path_key", few)
    small = detections if large is None else _beside(detections, large, "path_key", "left_anti")
    conflict = alike(similarity_limit)
    with shuffles_dropped(detections.sparkSession):
        files = cut_lineage(_kept_in_frames(small, iou_limit), "frames-kept")
        pairs = files.select(_key_pairs("keys")).select("p.*").distinct()
        side = lambda k: vectors.select(F.col("key").alias(k), conflict.what.alias(f"v{k}"))
        met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        good = (V.vec_norm(F.col("va")) > 0) & (V.vec_norm(F.col("vb")) > 0)
        # a key is alike itself and no other one; what isn't so is told
        met = met.select("a", "b", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(F.when(good, conflict.column(F.col("va"), F.col("vb"))), F.lit(False)).alias("hit"))
        told = cut_lineage(met.where(F.when(F.col("a") == F.col("b"), ~F.col("hit")).otherwise(F.col("hit"))), "key-pairs")
        first = F.transform(F.array_distinct("keys"), lambda k: F.get("ids", (F.array_position("keys", k) - 1).cast("int")))
        if told.isEmpty():
            out = files.select(F.explode(first).alias("id"))
        else:
            here = files.select(F.get("ids", F.lit(0)).alias("file"), _key_pairs("keys")).select("file", "p.*").join(told, ["a", "b"])
            here = cut_lineage(here.groupBy("file").agg(F.collect_list(F.struct("a", "b", "good")).alias("told")), "files-told")
            out = files.withColumn("file", F.get("ids", F.lit(0))).join(here, "file", "left")
            out = out.select(F.explode(F.when(F.col("told").isNull(), first).otherwise(_kept_as_told())).alias("id"))
    if large is None:
        return out
    many = _beside(detections, large, "path_key", "left_semi")
    inside = spatial_nms(many.withColumnRenamed("id", "face_id"), iou_limit, few, head).where("kept").select(F.col("face_id").alias("id"))
    many = many.join(inside, "id", "left_semi").join(vectors, "key").withColumn("file", F.col("path_key"))
    return out.union(temporal_nms(many, similarity_limit, few=few, head=head).where("kept").select("id"))


def _kept_as_told() -> Column:
    """Of ``ids, keys`` the ids that stay where ``told`` has what isn't usual: keys that are alike, keys not alike themselves, keys without a vector."""
    at = lambda a, b: F.exists("told", lambda t: (t["a"] == F.least(a, b)) & (t["b"] == F.greatest(a, b)))
    gone = lambda x: F.exists("told", lambda t: (t["a"] == x) & (t["b"] == x) & ~t["good"])
    key = lambda i: F.get("keys", i)

    def step(kept: Column, i: Column) -> Column:
        hit = F.exists(kept, lambda k: (key(k) == key(i)) != at(key(k), key(i)))
        return F.when(gone(key(i)) | hit, kept).otherwise(F.array_append(kept, i))

    places = F.aggregate(F.sequence(F.lit(0), F.size("keys") - 1), F.array().cast("array<int>"), step)
    return F.transform(places, lambda i: F.get("ids", i))
