"""Vector operators against plain numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lumenframe.operators import blocks as B
from lumenframe.operators import density as D
from lumenframe.operators import vectors as V
from lumenframe.operators.components import connected_components
from lumenframe.operators.numbering import numbered


def sequential_dbscan(x, eps, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (1 - x @ x.T) <= eps
    label, n = [-1] * len(x), 0
    core = near.sum(axis=1) >= least
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], queue = n, [i]
        while queue:
            p = queue.pop()
            for q in np.flatnonzero(near[p]):
                if label[q] == -1:
                    label[q] = n
                    if core[q]:
                        queue.append(q)
        n += 1
    return label


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


@pytest.mark.parametrize("least", [1, 2, 3])
def test_dbscan_is_the_sequential_one(spark, least):
    x = np.random.default_rng(least).normal(size=(60, 3)).astype(np.float32)
    got = {r.id: r.label for r in V.dbscan(frame(spark, x), 0.05, least).collect()}
    assert [got[i] for i in range(60)] == sequential_dbscan(x.astype(np.float64), 0.05, least)


@pytest.mark.parametrize(("least", "block_rows"), [(1, 30), (2, 30), (4, 17), (9, 60)])
def test_clusters_over_blocks(spark, least, block_rows):
    """Tight and loose groups, copies, zero vectors and noise, cut into blocks; labels are least core ids."""
    rng = np.random.default_rng(least)
    centers = rng.normal(size=(8, 5))
    x = (centers[rng.integers(0, 8, 240)] + rng.normal(size=(240, 5)) * rng.choice([0.01, 0.2, 0.6], (240, 1))).astype(np.float32)
    x[30:50] = x[30]
    got = {r.id: r.label for r in D.density_labels(frame(spark, x), 0.03, least, block_rows=block_rows).collect()}
    want = sequential_dbscan(x.astype(np.float64), 0.03, least)
    core = {}
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    dense = ((1 - y @ y.T) <= 0.03).sum(axis=1) >= least
    for i, k in enumerate(want):
        if dense[i]:
            core.setdefault(k, i)
    assert [got[i] for i in range(240)] == [core.get(k) for k in want]


def test_clusters_of_zero_vectors_and_of_owners(spark):
    x = np.zeros((9, 2), dtype=np.float32)
    x[3:] = [[1, 0], [1, 0.01], [1, 0.02], [0, 1], [0, 1], [-1, 0]]
    assert [r.label for r in V.dbscan(frame(spark, x), 0.1, 2).orderBy("id").collect()] == [-1, -1, -1, 0, 0, 0, 1, 1, -1]
    rows = frame(spark, x).withColumn("owner", (F.col("id") % 2))
    got = {r.id: r.label for r in V.cluster_within(rows, 0.1, 2).collect()}
    assert [got[i] for i in range(9)] == [-1, -1, -1, 3, -1, 3, -1, -1, -1]
    assert V.dbscan(rows.limit(0).select("id", "vector"), 0.1, 2).count() == 0


def test_clusters_of_near_equal_rows_write_no_pairs(spark, monkeypatch):
    """Of n near-equal rows no row, and of each pair of blocks one, is written as an edge."""
    n, block_rows, sizes = 20_000, 512, {}
    rows = spark.range(n).select("id", F.array(*[(F.lit(1.0) + F.rand(k) * 1e-4) for k in range(8)]).alias("vector"))
    write = D.cut_lineage

    def counted(df, name, *more):
        out = write(df, name, *more)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(D, "cut_lineage", counted)
    got = D.density_labels(rows, 0.01, 5, block_rows=block_rows)
    assert got.groupBy("label").count().collect() == [(0, n)]
    assert sizes["density-edges"] < n / 2 and "density-core" not in sizes


def test_range_pairs_over_blocks(spark):
    x = np.random.default_rng(1).normal(size=(50, 4)).astype(np.float32)
    d = ((x[:, None].astype(np.float64) - x[None].astype(np.float64)) ** 2).sum(axis=2)
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if d[i, j] < 1.5}
    got = {(r.a, r.b) for r in V.range_pairs(frame(spark, x), 1.5, block_rows=7).collect()}
    assert got == want


@pytest.mark.parametrize("metric, radius", [("l2sq", 0.02), ("cosine", 0.0002)])
def test_blocks_that_cannot_meet_are_skipped(spark, metric, radius):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 6)) * 5
    x = (centers[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6)) * 0.05).astype(np.float32)
    x[5] = 0
    x[40:60] = x[40]
    rows = frame(spark, x)
    found = B.cells(rows, radius, metric, 600, 25)
    assert found.rows.sum() == 600 and found.skipped(25) > 0.6
    y = x.astype(np.float64)
    if metric == "cosine":
        n = np.linalg.norm(y, axis=1, keepdims=True)
        y = y / np.where(n > 0, n, 1)
        d = 1 - y @ y.T
    else:
        d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if d[i, j] < radius}
    assert len(want) > 300 and {(r.a, r.b) for r in B.range_pairs(rows, radius, metric, block_rows=25).collect()} == want


def test_pairs_within_and_across(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    owner = [int(k) for k in rng.integers(0, 3, 80)]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    rows = spark.createDataFrame([(i, owner[i], x[i].tolist()) for i in range(80)], "id long, owner long, vector array<double>")
    got = {(r.a, r.b) for r in B.range_pairs_within(rows, 1.0, block_rows=9).collect()}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if owner[i] == owner[j] and d[i, j] < 1.0}
    got = {(r.a, r.b) for r in B.cross_pairs(rows.where("id < 50"), rows.where("id >= 30"), 1.0, block_rows=9).collect()}
    assert got == {(i, j) for i in range(50) for j in range(30, 80) if i != j and d[i, j] < 1.0}
    assert B.cross_pairs(rows, rows.limit(0), 1.0).count() == 0


def test_many_stages_meet_rows_in_blocks(spark):
    rng = np.random.default_rng(10)
    rows = frame(spark, rng.normal(size=(60, 5)))
    centers = rng.normal(size=(30, 5))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    stages = spark.createDataFrame([(i, c.tolist(), 0.1 * (i % 8)) for i, c in enumerate(centers)], "stage int, centroid array<double>, radius double")
    few, many = (sorted((r.id, r.stage, round(r.distance, 9)) for r in V.nearest_stage(rows, stages, 0.3, most).collect()) for most in (100, 7))
    assert few == many and few
    few, many = (sorted(r.id for r in V.within_any_stage(rows, stages, 0.3, most).collect()) for most in (100, 7))
    assert few == many and few


@pytest.mark.parametrize(("metric", "radius"), [("l2sq", 0.05), ("cosine", 0.0004)])
def test_tables_meet_only_where_they_can(spark, metric, radius):
    """Pairs across two tables are brute force's, and most pairs of blocks never meet; a zero vector is far from all."""
    rng = np.random.default_rng(14)
    spots = rng.normal(size=(16, 6)) * 4
    x, y = (spots[rng.integers(0, 16, n)] + rng.normal(size=(n, 6)) * 0.05 for n in (500, 300))
    x[3], y[4] = 0, 0
    x[50:60] = y[7]
    a, b = (spark.createDataFrame([(k + i, v.tolist()) for i, v in enumerate(z)], "id long, vector array<double>") for k, z in ((0, x), (450, y)))
    unit = metric == "cosine"
    found = B.cross_cells(a, b, (unit, unit), 20, B._reach(radius, unit))
    assert found.rows.sum() == 500 and found.others.sum() == 300 and found.skipped(20) > 0.6
    p, q = (z / np.where((n := np.linalg.norm(z, axis=1, keepdims=True)) > 0, n, 1) for z in (x, y)) if unit else (x, y)
    d = 1 - p @ q.T if unit else ((p[:, None] - q[None]) ** 2).sum(axis=2)
    want = {(i, 450 + j) for i, j in zip(*np.nonzero(d < radius)) if i != 450 + j}
    assert len(want) > 200 and {(r.a, r.b) for r in B.cross_pairs(a, b, radius, metric, block_rows=20).collect()} == want


def test_nearest_center_of_cells_that_can_hold_it(spark):
    rng = np.random.default_rng(15)
    spots = rng.normal(size=(12, 5))
    near = lambda n, s: spots[rng.integers(0, 12, n)] + rng.normal(size=(n, 5)) * s
    x, c = near(400, 0.05), near(120, 0.05)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    radius = rng.choice([0.01, 0.02, 0.05], 120)
    rows, centers = frame(spark, x), spark.createDataFrame([(i, v.tolist(), float(r)) for i, (v, r) in enumerate(zip(c, radius))], "stage int, centroid array<double>, radius double")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.sqrt(((u[:, None] - c[None]) ** 2).sum(axis=2))
    best, inside = {}, set()
    got = B.cross_nearest(rows, centers, 0.03, block_rows=10).collect()
    for r in got:
        best[r.id] = min(best.get(r.id, (9, 0)), (r.distance, r.stage))
        inside |= {r.id} if r.inside else set()
    assert [best[i][1] for i in range(400)] == d.argmin(axis=1).tolist()
    assert inside == set(np.flatnonzero((d <= np.maximum(radius, 0.03)).any(axis=1)).tolist()) and 0 < len(inside) < 400
    assert len(got) < 0.5 * 400 * 12  # of 12 blocks of centers or more, most rows meet few
    assert B.cross_nearest(rows.limit(0), centers, 0.1).count() == B.cross_nearest(rows, centers.limit(0), 0.1).count() == 0


def test_nearest_city_on_grids(spark):
    rng = np.random.default_rng(11)
    cities = [(f"c{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)) * [20, 40])] + [("a", 10.0, 10.0), ("b", 10.0, 10.0), ("z", None, 1.0)]
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 1, size=(200, 2)) * [90, 180])] + [(900, 10.0, 10.0), (901, None, 1.0)]
    c = spark.createDataFrame(cities, "city string, city_lat double, city_lon double")
    p = spark.createDataFrame(points, "id long, lat double, lon double")
    want = {i: min((((a - x) ** 2 + (b - y) ** 2) ** 0.5, name) for name, x, y in cities if x is not None)[1] for i, a, b in points if a is not None}
    assert {r.id: r.city for r in V.nearest_city(p, c, most=10).collect()} == want
    assert {r.id: r.city for r in V.nearest_city(p, c).collect()} == want


def test_numbers(spark):
    rows = spark.createDataFrame([(f"k{i * 7919 % 1000:03d}",) for i in range(1000)], "k string").repartition(6)
    assert sorted((r.n, r.k) for r in numbered(rows, "k").collect()) == [(i + 1, f"k{i:03d}") for i in range(1000)]
    assert numbered(rows.limit(0), "k").count() == 0


def test_near_vector_only(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3, 384))
    v[1] = v[0] + rng.normal(size=384) * 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert [(r.a, r.b) for r in V.range_pairs(frame(spark, v), 0.05).collect()] == [(0, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_greedy_suppression(spark):
    rows = [(1, "/a", 0, 0.0, 0.0, 10.0, 10.0, 0.5), (2, "/a", 0, 1.0, 1.0, 11.0, 11.0, 0.9), (3, "/a", 0, 30.0, 30.0, 40.0, 40.0, 0.1)]
    faces = spark.createDataFrame(rows, "face_id long, path_key string, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double")
    assert {r.face_id: r.kept for r in V.spatial_nms(faces).collect()} == {1: False, 2: True, 3: True}
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)] + [(11, [1.0, 0.0]), (12, [0.99, 0.1]), (13, [0.0, 1.0]), (14, None)], "face_id long, vector array<double>")
    video = faces.withColumns({"face_id": F.col("face_id") + 10, "path_key": F.lit("/v.mp4")})
    extra = video.limit(1).withColumn("face_id", F.lit(14).cast("long"))
    assert sorted(r.face_id for r in V.stored_face_dedup(faces.union(video).union(extra), vectors).collect()) == [2, 12]


def test_stages_and_suggestions(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 16))
    own = np.array([a + rng.normal(size=16) * 0.05 for _ in range(6)] + [b + rng.normal(size=16) * 0.05 for _ in range(6)])
    stages = V.stages(frame(spark, own)).collect()
    assert sorted(r.members for r in stages) == [6, 6]
    unknown = np.array([a, rng.normal(size=16)])
    got = V.suggest_for_person(frame(spark, unknown), frame(spark, own), 0.55).collect()
    assert [r.id for r in got] == [0] and got[0].similarity > 0.9


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_in_rounds_and_in_one_task(spark, few):
    rng = np.random.default_rng(12)
    edges = [(f"é{a}" if a % 3 else f"Z{a}", f"é{b}" if b % 3 else f"Z{b}") for a, b in rng.integers(0, 300, (220, 2)).tolist()] + [("x", "x"), ("é1", None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string"), few=few).collect()}
    up = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in up}


@pytest.mark.parametrize("limit", [None, 0.3])
def test_chamfer_of_blocks(spark, limit):
    rng = np.random.default_rng(13)
    sets = [rng.normal(size=(k, 4)) for k in rng.integers(1, 6, 23)]
    rows = [(i, s.tolist()) for i, s in enumerate(sets)] + [(90, None), (91, []), (None, sets[0].tolist())]
    df = spark.createDataFrame(rows, "id long, patches array<array<double>>")
    want = {}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            each = a @ sets[j].T
            x = (each.max(axis=1).mean() + each.max(axis=0).mean()) / 2
            if limit is None or x > limit:
                want[i, j] = round(x, 9)
    got = {(r.a, r.b): round(r.similarity, 9) for r in B.chamfer_pairs(df, limit, block_rows=5).collect()}
    assert got == want and len(want) > 50


def test_patch_sets_go_to_few_blocks(spark, monkeypatch):
    seen, met = [], B.met
    monkeypatch.setattr(B, "met", lambda rows: seen.append(rows) or met(rows))
    sets = spark.range(5000).select("id", F.expr("array(array(1D, cast(id as double)))").alias("patches"))
    B.chamfer_pairs(sets)
    assert seen[0].count() == 5000 and seen[0].select(F.max(F.size("others"))).first()[0] <= B.LEAST_BLOCKS


def test_patch_sets_are_compared_by_tiles():
    rng = np.random.default_rng(17)
    sizes = [*rng.integers(1, 9, 700), B.TILE + 5]
    sets = [rng.normal(size=(k, 3)) for k in sizes]
    rows = pa.table({"id": np.arange(len(sets)), "block": np.zeros(len(sets), dtype=np.int64), "patches": pa.array([s.tolist() for s in sets], pa.list_(pa.list_(pa.float64())))})
    out = list(B._chamfer_pass(None)((pa.scalar(0), pa.scalar(0)), iter(rows.to_batches())))
    assert len(out) > 6 and max(b.num_rows for b in out) <= B.TILE**2 / 4
    got = {(r["a"], r["b"]): r["similarity"] for b in out for r in b.to_pylist()}
    assert len(got) == sum(b.num_rows for b in out) == len(sets) * (len(sets) - 1) // 2
    for i, j in [(0, 1), (5, 600), (3, 700), (699, 700)]:
        each = sets[i] @ sets[j].T
        assert got[i, j] == pytest.approx((each.max(axis=1).mean() + each.max(axis=0).mean()) / 2)


def test_patch_sets_leave_by_similarity(monkeypatch):
    """Rounded values repeat in long runs, so that a file of all pairs is small."""
    sheet = 100_000
    monkeypatch.setattr(B, "SHEET", sheet, raising=False)
    rng = np.random.default_rng(19)
    sets = [rng.normal(size=(4, 3)).tolist() for _ in range(900)]
    rows = pa.table({"id": np.arange(900), "block": np.arange(900) % 2, "patches": pa.array(sets, pa.list_(pa.list_(pa.float64())))})
    out = list(B._chamfer_pass(None)((pa.scalar(0), pa.scalar(1)), iter(rows.to_batches())))
    x = np.concatenate([b.column("similarity").to_numpy() for b in out])
    assert len(x) == 450 * 450 and max(b.num_rows for b in out) <= B.TILE**2 / 4
    assert (np.diff(x) < 0).sum() <= len(x) // sheet
    assert len({(r["a"], r["b"]) for b in out for r in b.to_pylist()}) == len(x)


@pytest.mark.parametrize("eps", [0.3, 0.6, 1.0])
def test_near_singles_are_exact_at_the_limit(eps):
    """Rows that single precision can't tell from the limit are on the side where double precision puts them."""
    rng = np.random.default_rng(23)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(400, 64))
    side -= np.einsum("ij,ij->i", side, a)[:, None] * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = 1 - eps + rng.choice([-1e-9, 1e-9, 0.01, -0.01], 400)
    b = c[:, None] * a + np.sqrt(1 - c**2)[:, None] * side
    got = {(x, y) for xs, ys in D.near_singles(a, b, eps) for x, y in zip(xs.tolist(), ys.tolist())}
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(1 - a @ b.T <= eps))}
    assert got == want and {i for i in range(400) if (i, i) in got} == set(np.flatnonzero(c >= 1 - eps).tolist())


@pytest.mark.parametrize("min_samples", [1, 3])
def test_single_rows_beside_knots(spark, min_samples):
    rng = np.random.default_rng(29)
    x = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(6, 8)), 10, axis=0) + 0.05 * rng.normal(size=(60, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = {r.id: r.label for r in V.dbscan(df.hint("rebalance"), 0.25, min_samples).collect()}
    small = {r.id: r.label for r in D.density_labels(df, 0.25, min_samples, block_rows=16).collect()}
    assert [got[i] for i in range(120)] == list(sequential_dbscan(x, 0.25, min_samples))
    assert len(set(small.values())) == len(set(got.values())) and all((small[i] == small[j]) == (got[i] == got[j]) for i in range(120) for j in range(i) if small[i] is not None and small[j] is not None)
