"""Kept groups against whole runs."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumenframe.operators import increments as I
from lumenframe.operators import vectors as V


@pytest.mark.parametrize("rerank", [None, 0.9])
def test_batches_give_the_groups_of_a_whole_run(spark, rerank):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(60, 8))[rng.integers(0, 60, 90)] + rng.normal(size=(90, 8)) * 0.15
    x[0], x[60] = 50, -50  # of equal hash and far from all others
    names = [f"/{int(k):03}.{'mp4' if i % 7 == 0 else 'jpg'}" for i, k in enumerate(rng.permutation(90))]
    rows = [(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, x))]
    vectors = spark.createDataFrame(rows, "id long, file_path string, vector array<float>")
    hashes = [(n, f"h{i % 30}" if i % 4 == 0 else f"own{i}" if i % 5 else "", i, False, i % 2 == 0) for i, n in enumerate(names)]
    media = spark.createDataFrame(hashes, "file_path string, file_hash string, size int, has_exif_date boolean, has_location boolean")
    whole = lambda df: sorted(tuple(r) for r in df.select("component", "file_path", "method", "rank").collect())

    kept, old = I.nothing_kept(spark), vectors.limit(0)
    for low, high in ((0, 40), (40, 41), (41, 41), (41, 90)):
        new = vectors.where((F.col("id") >= low) & (F.col("id") < high))
        kept, old = I.add_files(kept, media, old, new, 0.9, rerank), old.union(new)
        here = media.join(old, "file_path", "left_semi")
        assert whole(I.kept_groups(here, kept)) == whole(V.media_groups(here, old, 0.9, rerank))
    assert kept.count() == kept.select("file_path").distinct().count() and kept.where("video").count()
    assert {r[2] for r in whole(I.kept_groups(media, kept))} == {"exact", "ai_local", "ai_local_video"}

    gone = vectors.where("id % 6 = 1").select("file_path")
    kept = I.remove_files(kept, media, vectors, gone, 0.9, rerank)
    left, here = vectors.join(gone, "file_path", "left_anti"), media.join(gone, "file_path", "left_anti")
    assert whole(I.kept_groups(here, kept)) == whole(V.media_groups(here, left, 0.9, rerank))
