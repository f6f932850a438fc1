from __future__ import annotations

import json

from lumenframe.catalog import Catalog
from lumenframe.streaming.ingest import events_per_window, ingest_listings, version_path
from tests.test_catalog import catalog, row


def test_listings_become_versions(spark, tmp_path):
    root, feed = tmp_path / "cat", tmp_path / "feed"
    feed.mkdir()
    catalog(spark, [row("/a.jpg")]).save(version_path(str(root), 0))
    for name, rows in (("1.json", [("/b.jpg", 5.0), ("/A.jpg", 7.0)]), ("2.json", [("/b.jpg", 6.0)])):
        (feed / name).write_text("\n".join(json.dumps({"file_path": p, "last_modified": t}) for p, t in rows))
        ingest_listings(spark, str(feed), str(root), str(tmp_path / "ck")).awaitTermination()
    got = {r.path_key: (r.last_modified, r.file_hash) for r in Catalog.load(spark, version_path(str(root), 2)).media.collect()}
    assert got == {"/a.jpg": (7.0, "h"), "/b.jpg": (6.0, None)}


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert events_per_window(events).agg({"n": "sum"}).first()[0] == events.count()
