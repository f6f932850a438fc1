"""Greedy suppression of large groups, and ranks of large components, against plain loops."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumenframe.operators import suppression as S
from lumenframe.operators import vectors as V
from lumenframe.operators.numbering import ranked
from lumenframe.plans import similarity
from lumenframe.sources.fixtures import catalog


def greedy(rows, conflict):
    """``rows``: (group, order, item, what) -> {item: kept}."""
    kept, out = {}, {}
    for group, _, item, what in sorted(rows, key=lambda r: r[1]):
        out[item] = not any(conflict(k, what) for k in kept.get(group, []))
        if out[item]:
            kept.setdefault(group, []).append(what)
    return out


def box_iou(a, b):
    if None in a or None in b:
        return 0
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0


@pytest.mark.parametrize(("few", "head"), [(64, 8192), (0, 20), (10, 64), (0, 16)])
def test_boxes_in_rounds(spark, few, head):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(700):
        x, y = rng.integers(0, 60, 2).astype(float).tolist()
        box = (x, y, x + float(rng.integers(0, 12)), y + 10.0) if i % 41 else (None, y, x, y)
        rows.append((i, f"/{'big' if i % 4 else i % 28}.jpg" if i % 97 else None, 0, *box, float(rng.integers(0, 5)) / 4 if i % 53 else None))
    faces = spark.createDataFrame(rows, "face_id long, path_key string, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double")
    by_path = S.greedy_keep(faces, "path_key", [-F.col("det_score"), F.col("face_id")], "face_id", S.overlap(0.45), S.large_groups(faces, "path_key", few), head)
    got = {r.face_id: r.kept for r in by_path.collect()}
    order = lambda r: (r[7] is not None, -(r[7] or 0), r[0])
    want = greedy([(r[1], order(r), r[0], r[3:7]) for r in rows], lambda a, b: box_iou(a, b) > 0.45)
    assert got == want and 0 < sum(want.values()) < 700
    assert by_path.columns == ["path_key", "face_id", "kept"]


@pytest.mark.parametrize(("few", "head"), [(0, 16), (3, 40), (1000, 16)])
def test_vectors_in_rounds(spark, few, head):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.4
    x[7] = 0
    x[20:40] = x[20]
    rows = [(i, v.tolist(), "/v.mp4" if i % 3 else f"/{i % 9}.mov", float(i % 4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, file string, det_score double")
    cosine = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) > 0.88
    want = greedy([(r[2], (-r[3], r[0]), r[0], np.array(r[1])) for r in rows if r[0] != 7], cosine)
    assert {r.id: r.kept for r in V.temporal_nms(df, few=few, head=head).collect()} == want
    assert V.temporal_nms(df.limit(0), few=few, head=head).count() == 0


@pytest.mark.parametrize(("few", "limit"), [(64, 0.88), (3, 0.88), (64, 2.0)])
def test_detections_that_share_vectors(spark, few, limit):
    """Frames, then files, with equal, alike, zero, null and missing vectors; key 30 has none and still takes part in its frame."""
    rng = np.random.default_rng(24)
    x = rng.normal(size=(8, 6))[rng.integers(0, 8, 30)] + rng.normal(size=(30, 6)) * 0.4
    x[7] = 0
    vectors = spark.createDataFrame([(k, v.tolist() if k != 9 else None) for k, v in enumerate(x)], "key long, vector array<float>")
    rows = []
    for i in range(600):
        a, b = rng.integers(0, 20, 2).astype(float).tolist()
        rows.append((i, f"/{int(rng.integers(0, 120))}.mp4", int(rng.integers(0, 3)), a, b, a + 10, b + 10, float(rng.integers(0, 5)) / 4, int(rng.integers(0, 31)) if i % 43 else None))
    df = spark.createDataFrame(rows, "id long, path_key string, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double, key long")
    order = lambda r: (-r[7], r[0])
    inside = greedy([(r[1:3], order(r), r[0], r[3:7]) for r in rows], lambda p, q: box_iou(p, q) > 0.45)
    y = x.astype(np.float32).astype(np.float64)
    cosine = lambda p, q: np.dot(p, q) / (np.linalg.norm(p) * np.linalg.norm(q)) > limit
    left = [(r[1], order(r), r[0], y[r[8]]) for r in rows if inside[r[0]] and r[8] not in (7, 9, 30, None)]
    want = sorted(i for i, kept in greedy(left, cosine).items() if kept)
    assert sorted(r.id for r in V.detected_ids(df, vectors, 0.45, limit, few=few).collect()) == want
    assert 0 < len(want) < len(left) + (limit > 1) < sum(inside.values()) < 600
    assert V.detected_ids(df.limit(0), vectors, few=few).count() == 0


def test_detections_move_without_vectors(spark, sf_dir):
    got = similarity.QUERIES["detected_faces"][0](catalog(spark, sf_dir), spark, sf_dir)
    assert "vector" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() > 1000


def test_one_file_of_many_copies_is_one_round(spark, monkeypatch):
    """Half the detections are copies of one box; the others lie apart and take the rounds that their number asks for."""
    n, head, written = 6000, 1024, []
    x = F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 20.0)
    faces = spark.range(n).select(F.col("id").alias("face_id"), F.lit("/a.jpg").alias("path_key"), F.lit(0).alias("frame_index"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 10).alias("x2"), F.lit(10.0).alias("y2"), F.lit(1.0).alias("det_score"))
    write = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df, name, *more: written.append(name) or write(df, name, *more))
    got = V.spatial_nms(faces, head=head)
    assert got.where("kept").agg(F.count("*"), F.sum(F.col("face_id") % 2)).first() == (n // 2 + 1, n // 2)
    assert got.count() == n and written.count("suppression-heads") <= 2 + (n // 2) // (head - head // S.STEPS)


def test_ranks_inside_groups(spark):
    rows = [(k, i) for k in (None, 1, 2, 5) for i in range(k or 3)]
    got = sorted((r.k or 0, r.n, r.i) for r in ranked(spark.createDataFrame(rows, "k int, i int"), "k", F.desc("i")).collect())
    assert got == sorted((k or 0, (k or 3) - 1 - i, i) for k, i in rows)


def test_groups_of_large_components(spark):
    rng = np.random.default_rng(23)
    rows = [(f"/{i:03}.{'mp4' if i % 11 == 0 else 'jpg'}", f"h{i % 40}" if i % 3 else None, int(rng.integers(0, 4)), bool(i % 2), bool(i % 5 == 0)) for i in range(300)]
    media = spark.createDataFrame(rows, "file_path string, file_hash string, size int, has_exif_date boolean, has_location boolean")
    similar = spark.createDataFrame([(rows[a][0], rows[b][0]) for a, b in rng.integers(0, 300, (40, 2)).tolist()], "src string, dst string")
    whole = lambda df: sorted(tuple(r) for r in df.select("component", "file_path", "method", "rank").collect())
    small, large = whole(V.near_groups(media, similar)), whole(V.near_groups(media, similar, segment=0))
    assert small == large and {r[2] for r in small} == {"exact", "ai_local", "ai_local_video"}
