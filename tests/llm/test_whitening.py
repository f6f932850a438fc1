"""Whitening against numpy and against exact integers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from lumenframe.llm import whitening as W

ROWS = "vec_id long, embedding array<double>, label int"


def components(spark, vectors, schema=ROWS, **options):
    df = spark.createDataFrame(vectors, schema)
    out = {}
    for r in W.whitened_components(df, **options).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def exact_gram(x):
    """n, sums, and n**3 times the covariance of the distinct rows, in Python integers."""
    rows = sorted(set(map(tuple, x)))
    n, d = len(rows), len(rows[0])
    s = [sum(r[i] for r in rows) for i in range(d)]
    y = [[n * r[i] - s[i] for i in range(d)] for r in rows]
    return n, s, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


def as_integers(vectors, scale=64, offset=1_000_000):
    return [[math.floor(c * scale) + offset for c in v] for v in vectors]


def test_limbs_and_products_are_exact():
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 61), 1 << 61, (5, 40_000))
    assert (sum(x.astype(object) * (1 << (W.LIMB_BITS * k)) for k, x in enumerate(map(lambda v: v.astype(np.int64), W.limbs(a)))) == a.astype(object)).all()
    assert (W.product(a, a.T) == a.astype(object) @ a.T.astype(object)).all()
    big = a[:, :30].astype(object) ** 3
    assert (W.product(big, big.T) == big @ big.T).all()


def test_rank_is_exact():
    rng = np.random.default_rng(2)
    a = rng.integers(-9, 9, (12, 5)).astype(object) * 10**30
    assert W.rank(a @ a.T) == 5 and W.rank(np.zeros((3, 3), dtype=object)) == 0 and W.rank(np.eye(4, dtype=int).astype(object)) == 4


def test_whole_table_is_numpys(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array(as_integers([r.embedding for r in rows]))
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    e, q = np.linalg.eigh(np.cov((fit - 1_000_000).T, bias=True))
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    want = (x - mean) @ q / np.sqrt(e)
    got = W.whitened_components(df).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and set(got.n) == {n}
    w = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(-1, 16)[:, 0] == ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1)).all()
    assert np.abs(got.explained.to_numpy()[:16] - e / np.trace(np.cov(fit.T, bias=True))).max() < 1e-9
    # the error told is that of the whitened vectors themselves
    own = w[np.unique(x, axis=0, return_index=True)[1]]
    assert np.abs(np.cov(own.T, bias=True) - np.eye(16)).max() < 1e-9 and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_copies_count_once(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 3)).tolist()
    once = components(spark, [(i, v, 0) for i, v in enumerate(vectors)])
    many = components(spark, [(i, v, 0) for i, v in enumerate(vectors)] + [(100 + i, vectors[0], 0) for i in range(300)])
    assert many[0][1].n == once[0][1].n == 40
    assert all(many[i] == once[i] for i in once) and many[399][2].whitened == once[0][2].whitened


def test_eigenvalues_far_apart_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, (200, 4)).astype(float)
    # two directions of greatly different spread, neither along an axis
    vectors = np.column_stack((base[:, 0] * 2.0**16 + base[:, 1], base[:, 0] * 2.0**16 - base[:, 1], base[:, 2], base[:, 3])).tolist()
    got = components(spark, [(i, v, 0) for i, v in enumerate(vectors)], scale=1)
    x = as_integers(vectors, 1)
    n, s, g = exact_gram(x)
    w = np.array([[got[i][k].whitened for k in range(1, 5)] for i in range(200)])
    assert len(set(map(tuple, x))) == 200 == n
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-4 and got[0][1].identity_error < 1e-4
    trace = sum(g[i][i] for i in range(4))
    assert sum(Fraction(got[0][k].explained) for k in range(1, 5)) == pytest.approx(1, abs=1e-12)
    small = np.linalg.eigvalsh(np.array([[g[i][j] / n**3 for j in (2, 3)] for i in (2, 3)]))
    assert got[0][4].explained * trace / n**3 == pytest.approx(min(small), rel=0.02)
    assert [got[7][1].deviation, got[7][4].deviation] == [sum((n * a - b) ** 2 for a, b in zip(x[7], s))] * 2


def test_directions_without_variance(spark):
    vectors = [(i, [float(i % 7), float(2 * (i % 7)), 1.0, float(i % 5)], 0) for i in range(35)]
    got = components(spark, vectors)
    assert set(got[0]) == {1, 2, 3, 4}
    assert [got[3][k].whitened is None for k in (1, 2, 3, 4)] == [False, False, True, True]
    assert got[3][4].explained == 0 and got[3][1].identity_error < 1e-9
    alone = components(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])
    assert alone[2][1].n == 1 and alone[2][1].whitened is None and alone[2][1].explained is None and alone[2][1].deviation == 0 and alone[2][1].identity_error is None


def test_odd_rows(spark):
    rows = [
        (1, None, 0),
        (2, [1.0, None], 0),
        (3, [1.0, float("nan")], 0),
        (4, [float("inf"), 1.0], 0),
        (5, [], 0),
        (None, [1.0, 2.0], None),
        (6, [3.0, 1.0], 0),
        (6, [3.0, 1.0], 0),
        (7, [1.0, 1.5, 9.0], 0),
        (8, [2.0, 1.5, 7.0], 0),
        (9, [-0.001, 0.0], 0),
    ]
    got = W.whiten(spark.createDataFrame(rows, ROWS), keep=["vec_id", "label"]).collect()
    assert sorted((r.vec_id or 0, len(r.whitened), r.n) for r in got) == [(0, 2, 3), (6, 2, 3), (6, 2, 3), (7, 3, 2), (8, 3, 2), (9, 2, 3)]


def test_huge_entries_and_clashing_names(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)], "a", 1, 2) for i in range(6)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int, size int"), keep=["vec_id", "x", "n", "size"])
    assert got.columns == ["vec_id", "x", "n", "size", "n", "deviation", "whitened", "explained", "identity_error"]
    told = got.select("vec_id", "deviation").collect()
    x = [[(1 << 61) * (-1) ** i + 1_000_000, 64 * i + 1_000_000] for i in range(6)]
    n, s, _ = exact_gram(x)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in told} == {i: v if v < 10**38 else None for i, v in want.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert W.whitened_components(df).collect() == [] and [f.name for f in W.whitened_components(df).schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
