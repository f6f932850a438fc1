"""Exact search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lumenframe.llm import exact_topk as X

ROWS = "vec_id long, embedding array<double>, row string, block int"


def brute(rows, k=5, every=50, scale=256):
    """Sorted (query_id, rank, vec_id, score); every row is a query and a candidate of its own."""
    own = []
    for vec_id, vector in rows:
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector):
            own.append((vec_id, [math.floor(c * scale) for c in vector]))
    out = []
    for i, (q, x) in enumerate(own):
        if q is not None and q % every == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), v is None, v or 0) for j, (v, y) in enumerate(own) if j != i]
            out += [(q, r, None if none else v, -s) for r, (s, none, v) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], ROWS)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in X.exact_topk(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block_rows": 60, "query_rows": 7}, {"k": 1, "block_rows": 100}, {"k": 1000, "block_rows": 100}])
def test_search_is_brute_force(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    assert found(spark, rows, every=10, **options) == brute(rows, k=options.get("k", 5), every=10)


def test_ties_and_copies(spark):
    rng = random.Random(2)
    copy = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, copy) for i in range(0, 300)] + [(i, [rng.randrange(-2, 3) / 256 for _ in range(6)]) for i in range(300, 500)] + [(0, copy), (50, copy)]
    assert found(spark, rows, block_rows=64) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]),
        (1, None),
        (2, [1.0, None]),
        (3, [float("nan"), 1.0]),
        (50, [float("-inf"), 1.0]),
        (100, []),
        (150, [0.0, 0.0]),
        (200, [0.5]),
        (250, [1.0, 2.0, -3.0]),
        (None, [1.0, 2.0]),
        (None, [4.0, 4.0, 4.0, 4.0]),
        (-50, [-1.0, 0.001]),
        (-50, [-1.0, 0.001]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


def test_huge_components(spark):
    rows = [(50 * i, [1e5 * (i + 1), -3e5, 0.5]) for i in range(8)] + [(1, [3e7, 1e7, 1.0])]
    assert found(spark, rows) == brute(rows)
    got = found(spark, [(0, [1e12, 1.0]), (50, [1e12, 1.0]), (100, [-1e12, 1.0])])
    assert {s for _, _, _, s in got} == {(1 << 63) - 1, -(1 << 63)}


def test_index_holds_every_posting_by_falling_impact(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=5).tolist(), "x", 1) for i in range(200)], ROWS)
    rows = X.prepared(df, "embedding", 256)
    want = sorted((r.row, d, v) for r in rows.collect() for d, v in enumerate(r.x) if v)
    got = []
    for n in range(3):
        own = X.build_index(rows, 3).where(f"block = {n}").collect()
        ids = next(s for s in own if s.dim == -1)
        number = ids["values"][: len(ids["values"]) // 2]
        segments = [s for s in own if s.dim >= 0]
        assert all(X.level_of(np.array(s["values"])).tolist() == [s.level] * len(s["values"]) for s in segments)
        assert [s.level for s in segments] == sorted((s.level for s in segments), reverse=True)
        got += [(number[p], s.dim, v) for s in segments for p, v in zip(s.places, s["values"])]
    assert sorted(got) == want


def test_processing_stops_on_proof():
    """Rows that the least impacts can't bring up again are left out without having been seen whole."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(0, 60, (4000, 32)).astype(np.int64)
    x[:40] *= 6
    table = pa.table({"row": np.arange(4000), "vec_id": np.arange(4000), "x": x.tolist()})
    block = X.Block(X._index_block((pa.scalar(0),), table))
    scored = []
    exact = block.scores
    block.scores = lambda queries, q, place: scored.append(len(q)) or exact(queries, q, place)
    q, place, score = X.search_block(block, x[:20], np.arange(20), 5)
    every = (x[:20] @ x.T).astype(float)
    every[np.arange(20), np.arange(20)] = -np.inf
    assert sorted(score.tolist()) == sorted(np.sort(every, axis=1)[:, -5:].astype(int).ravel().tolist())
    assert 100 <= scored[0] < 20 * 4000 / X.STOP_SHARE and len(q) == 100
