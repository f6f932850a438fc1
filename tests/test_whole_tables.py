"""Registered queries see the whole table, whatever its ids and size."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from lumenframe.catalog import Catalog
from lumenframe.operators import flows
from lumenframe.plans import scalars, similarity
from tests.test_vectors import sequential_dbscan

FACES = "face_id long, path_key string, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double"


def box_iou(a, b):
    i = max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
    u = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i
    return i / u if u > 0 else 0.0


def suppressed(rows, limit=0.45):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[0])):
        if all((k[1], k[2]) != (r[1], r[2]) or box_iou(k, r) <= limit for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def face_rows():
    """Faces of orders on both sides of 2,000."""
    return [(order * 1000 + n, f"/f{order}", n % 2, 2.0 * n, 0.0, 2.0 * n + 10, 10.0 + n, (n * 7 % 5) / 10) for order in (3, 1999, 2000, 91000) for n in range(1, 7)]


def test_suppression_sees_faces_of_every_id(spark):
    rows = face_rows()
    c = SimpleNamespace(faces=spark.createDataFrame(rows, FACES))
    got = {r.face_id: r.kept for r in similarity.QUERIES["spatial_nms"][0](c, spark, None).collect()}
    assert set(got) == {r[0] for r in rows}
    assert {k for k, kept in got.items() if kept} == suppressed(rows)


def test_face_pipeline(spark):
    """Detections of one folder against the same steps in plain Python."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4, 8))
    schema = "face_id long, file_path string, path_key string, cluster_id long, is_ignored int, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double, capture_date string"
    rows, vec = [], {}
    for i in range(60):
        path = f"/{'in' if i % 5 else 'out'}/{i % 8}.{'mp4' if i % 2 else 'jpg'}"
        x = float(rng.integers(0, 30))
        rows.append((i + 1, path, path, -1, int(i % 13 == 0), i % 3, x, 0.0, x + 10, 10.0, float(rng.integers(0, 9)) / 10, None))
        vec[i + 1] = base[rng.integers(0, 4)] + rng.normal(size=8) * rng.choice([0.05, 0.6])
    stored, fresh = [r for r in rows if r[0] <= 30], [r for r in rows if r[0] > 30 and r[1].startswith("/in/")]
    c = Catalog(None, spark.createDataFrame(stored, schema), spark.createDataFrame([], "cluster_id long, custom_name string, is_ignored int"), None, None, None, None)
    vectors_of = lambda ids: spark.createDataFrame([(i, vec[i].tolist()) for i in ids], "face_id long, vector array<double>")
    detections = spark.createDataFrame(fresh, schema).join(vectors_of([r[0] for r in fresh]), "face_id").withColumnRenamed("face_id", "id").drop("cluster_id", "is_ignored", "capture_date")
    after, left = flows.face_pipeline(c, vectors_of([r[0] for r in stored]), detections, "/in", 0.1, 2)

    unit = lambda v: v / np.linalg.norm(v)
    frames = suppressed([(r[0], r[1], r[5], r[6], r[7], r[8], r[9], r[10]) for r in fresh])
    kept = []
    for r in sorted((r for r in fresh if r[0] in frames), key=lambda r: (-r[10], r[0])):
        if all(k[1] != r[1] or unit(vec[k[0]]) @ unit(vec[r[0]]) <= 0.88 for k in kept):
            kept.append(r)
    faces, of = list(stored), {r[0]: vec[r[0]] for r in stored}
    for n, r in enumerate(sorted(kept, key=lambda r: (r[1], r[5], r[6], r[7]))):
        faces.append((31 + n, *r[1:4], 0, *r[5:]))
        of[faces[-1][0]] = vec[r[0]]
    ignored = [r[0] for r in faces if r[4] == 1]
    here = [r[0] for r in faces if r[1].startswith("/in/") and r[4] == 0 and all(1 - unit(of[r[0]]) @ unit(of[i]) >= 0.1 for i in ignored)]
    labels = dict(zip(sorted(here), sequential_dbscan(np.array([of[i] for i in sorted(here)]), 0.1, 2)))
    gone = set()
    for path in {r[1] for r in faces if r[1].startswith("/in/")}:
        stay = []
        for r in sorted(r for r in faces if r[1] == path):
            near = lambda k: unit(of[k[0]]) @ unit(of[r[0]]) > 0.88 if path.endswith("mp4") else box_iou((0, 0, 0, *k[6:10]), (0, 0, 0, *r[6:10])) > 0.45  # noqa: B023, E731
            if any(near(k) for k in stay):
                gone.add(r[0])
            else:
                stay.append(r)
    want = {r[0]: labels.get(r[0], -1) for r in faces if r[0] not in gone}
    assert {r.face_id: r.cluster_id for r in after.faces.collect()} == want and gone and max(want.values()) > 0
    assert {r.face_id for r in left.collect()} == set(want)
    assert {r.cluster_id for r in after.clusters.collect()} == {x for x in labels.values() if x >= 0}


def vectors(spark, n):
    x = np.random.default_rng(4).normal(size=(n, 16)).astype(np.float32)
    rows = [(f"vec/{i}", i, v.tolist(), i % 3) for i, v in enumerate(x)]
    return x.astype(np.float64), SimpleNamespace(features=spark.createDataFrame(rows, "file_path string, vec_id long, vector array<float>, label int"))


def test_chamfer_sees_all_pairs(spark):
    x, c = vectors(spark, 25)
    p = x.reshape(len(x), -1, 8)
    p = p / np.linalg.norm(p, axis=2, keepdims=True)
    want = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            m = p[i] @ p[j].T
            want[i, j] = (m.max(axis=1).mean() + m.max(axis=0).mean()) / 2
    got = {(r.a, r.b): r.x for r in scalars.QUERIES["chamfer"][0](c, spark, None).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_sort_by_centroid_returns_every_vector(spark):
    x, c = vectors(spark, 130)
    rows = similarity.QUERIES["sort_by_centroid"][0](c, spark, None).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    center = unit[2::3].mean(axis=0)
    want = unit @ (center / np.linalg.norm(center))
    assert [r.id for r in rows] == sorted(range(130), key=lambda i: (-want[i], i))
    assert all(r.similarity == pytest.approx(want[r.id], abs=1e-4) for r in rows)
