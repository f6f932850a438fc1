"""Versions of a catalogue: buckets, conflicts, failures, cancellation and incremental analysis."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lumenframe import jobs
from lumenframe.catalog import CatalogError
from lumenframe.operators import mutations as X
from lumenframe.operators.sync import new_media_records
from lumenframe.storage import cut_lineage
from lumenframe.streaming.ingest import analyse_listings
from lumenframe.versions import Store, VersionConflict
from tests.test_catalog import catalog, face, row


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/kept", buckets=8)
    out.create(catalog(spark, [row(f"/{i}.jpg") for i in range(40)], [face(i, f"/{i}.jpg") for i in range(40)]))
    return out


def records(spark, *paths, modified=9.0):
    return spark.createDataFrame([(p, modified) for p in paths], "file_path string, last_modified double")


def folders(store, version, name):
    return store.manifest(version)["tables"][name]["folders"]


def media(store, version=None):
    return {r.path_key: r.last_modified for r in store.load(version).media.collect()}


def test_only_touched_buckets_are_written(spark, store):
    batch = records(spark, "/3.JPG", "/new.jpg")
    assert store.change(lambda c: X.upsert_media(c, new_media_records(batch)), batch) == 1
    old, new = folders(store, 0, "media"), folders(store, 1, "media")
    assert 1 <= sum(old.get(b) != p for b, p in new.items()) <= 2 and len(old) == 8
    assert folders(store, 0, "faces") == folders(store, 1, "faces")
    want = {f"/{i}.jpg": 1.0 for i in range(40)}
    assert media(store, 0) == want
    assert media(store) == want | {"/3.jpg": 9.0, "/new.jpg": 9.0}


def test_a_bucket_that_empties(spark, store):
    gone = spark.createDataFrame([(f"/{i}.jpg",) for i in range(40)], "file_path string")
    store.change(lambda c: X.delete_media(c, gone.select(F.col("file_path").alias("path_key"))), gone)
    now = store.load()
    assert now.media.count() == now.faces.count() == 0 and now.media.columns == store.load(0).media.columns
    store.change(lambda c: X.upsert_media(c, new_media_records(records(spark, "/a.jpg"))), records(spark, "/a.jpg"))
    assert media(store) == {"/a.jpg": 9.0}


def test_a_change_stays_with_its_keys(spark, store):
    with pytest.raises(CatalogError, match="not among its keys"):
        store.change(lambda c: X.upsert_media(c, new_media_records(records(spark, *[f"/x{i}" for i in range(30)]))), records(spark, "/1.jpg"))
    assert store.versions() == [0]


def test_a_failed_writer_leaves_the_last_version(spark, store):
    boom = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(Exception):
        store.change(lambda c: c.having(faces=c.faces.limit(1), media=c.media.withColumn("last_modified", boom("path_key"))))
    assert store.versions() == [0] and store.load().faces.count() == 40
    assert len(store._names("data")) == 1


def test_two_writers(spark, store):
    """The slower one starts again from the faster one's version; both changes stay."""
    calls = []

    def slow(c):
        calls.append(1)
        if len(calls) == 1:
            store.change(lambda c: X.upsert_media(c, new_media_records(records(spark, "/fast.jpg"))), records(spark, "/fast.jpg"))
        return X.upsert_media(c, new_media_records(records(spark, "/slow.jpg")))

    assert store.change(slow, records(spark, "/slow.jpg")) == 2 and len(calls) == 2
    assert {"/fast.jpg", "/slow.jpg"} < set(media(store)) and len(media(store)) == 42
    with pytest.raises(VersionConflict):
        store.create(store.load())


def test_expired_versions(spark, store):
    for k in range(3):
        batch = records(spark, f"/{k}.jpg", modified=20.0 + k)
        store.change(lambda c: X.upsert_media(c, new_media_records(batch)), batch)
    want = media(store)
    assert store.expire(1) == [0, 1, 2] and store.versions() == [3]
    assert media(store) == want and store.load().faces.count() == 40
    with pytest.raises(CatalogError):
        store.load(1)


def test_cancelled_work_publishes_nothing(spark, store):
    job, slow = jobs.Job(spark), F.udf(lambda x: time.sleep(2) or x, "double")
    threading.Timer(3, job.cancel).start()
    began = time.time()
    with pytest.raises(jobs.Cancelled):
        job.run(store.change, lambda c: c.having(media=c.media.withColumn("last_modified", slow("last_modified"))))
    assert time.time() - began < 15 and store.versions() == [0]
    with pytest.raises(jobs.Cancelled):
        job.run(cut_lineage, spark.range(3), "never")
    assert jobs.Job(spark).run(cut_lineage, spark.range(3), "free").count() == 3


def test_only_changed_files_are_analysed(spark, store, tmp_path):
    feed, seen = tmp_path / "feed", []
    feed.mkdir()
    thumbs = spark.createDataFrame([("t",)], "thumbnail_path string")

    def analyse(work):
        seen.append(sorted(tuple(r) for r in work.collect()))
        return new_media_records(work).withColumns({"file_hash": F.lit("seen"), "thumbnail_path": F.lit("t")})

    def feed_in(name, rows):
        (feed / name).write_text("\n".join(json.dumps({"file_path": p, "last_modified": t}) for p, t in rows))
        query = analyse_listings(store, str(feed), str(tmp_path / "ck"), thumbs, analyse)
        query.awaitTermination()

    feed_in("1.json", [("/1.jpg", 1.0), ("/2.jpg", 5.0), ("/NEW.jpg", 2.0), ("/new.jpg", 3.0)])
    feed_in("2.json", [("/2.jpg", 5.0), ("/new.jpg", 3.0)])
    feed_in("3.json", [("/new.jpg", 4.0)])
    assert seen == [[("/2.jpg", 5.0), ("/new.jpg", 3.0)], [("/new.jpg", 4.0)]]
    assert store.versions() == [0, 1, 2, 3] and store.manifest()["notes"] == {str(tmp_path / "ck"): 2}
    now = media(store)
    assert (now["/1.jpg"], now["/2.jpg"], now["/new.jpg"], len(now)) == (1.0, 5.0, 4.0, 41)


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    c = catalog(spark, [row(f"/{i}.jpg") for i in range(40)], [face(i, f"/{i}.jpg") for i in range(40)])
    before, shuffled = _shuffle_files(spark), c.having(media=c.media.distinct())
    Store(spark, f"file://{tmp_path}/kept", buckets=8).create(shuffled)
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_versioned_changes_keep_one_version(spark, sf_dir):
    from lumenframe.plans import changes, registry

    kept, made = [], changes.Store
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(changes, "Store", lambda *a: kept.append(made(*a)) or kept[0])
        rows = registry.queries()["versioned_changes"](spark, sf_dir)
    assert rows.count() > 0 and kept[0].versions() == [2]
    live = {p.split("/")[1] for t in kept[0].manifest()["tables"].values() for p in t["folders"].values()}
    assert all(kept[0]._names(f"data/{a}/faces") == [] for a in kept[0]._names("data") if a not in live)
