"""The facade and the settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenframe.config import Config, timed
from lumenframe.database import Database
from lumenframe.operators import vectors as V
from tests.test_catalog import catalog, face, row


def test_a_chain_of_changes(spark):
    db = Database(catalog(spark, [row("/p/a.jpg"), row("/p/b.jpg")], [face(1, "/p/a.jpg"), face(2, "/p/b.jpg")]))
    after = db.upsert_cluster(7, "Ada").update_faces_association_batch([1], 7).delete_media("/p/B.jpg").save_setting("k", 1)
    assert [(r.cluster_id, r.custom_name, r.faces) for r in after.get_clusters().collect()] == [(7, "Ada", 1)]
    assert [r.file_path for r in after.get_all_media_paths().collect()] == ["/p/a.jpg"]
    assert after.get_setting("k").first()[0] == "1" and db.get_clusters().count() == 0
    assert after.get_faces_by_category("person", 7).count() == 1 and after.get_faces_by_category("unknown").count() == 0
    assert after.set_cluster_ignored(7, True).get_face_counts().first().bucket == "ignored"
    assert after.clear_all_data().get_all_media_paths().count() == 0


@pytest.mark.parametrize("stored, want", [("60", 0.6), ("0.3", 0.3), ("bad", 0.55)])
def test_settings_are_fractions(spark, stored, want):
    rows = spark.createDataFrame([("merge_threshold", stored), ("include_trash", "True"), ("face_min_samples", "3")], "key string, value string")
    config = Config.load(rows)
    assert (config.merge_threshold, config.include_trash, config.face_min_samples, config.face_eps) == (want, True, 3, 0.42)
    assert dict(config.rows())["include_trash"] == "True"


def test_settings_are_read_under_their_stored_names(spark):
    rows = spark.createDataFrame([("face_cluster_eps", "35"), ("face_eps", "0.1"), ("dup_threshold_stage2", "0.9"), ("force_reanalyze", "True"), ("dup_threshold", None)], "key string, value string")
    config = Config.load(rows)
    assert (config.face_eps, config.rerank_threshold, config.force, config.near_radius) == (0.35, 0.9, True, 0.6)
    assert Config.load(spark.createDataFrame(config.rows(), "key string, value string")) == config


def test_rename_by_label(spark):
    db = Database(catalog(spark, [row("/p/a.jpg")], [face(1, "/p/a.jpg"), face(2, "/p/a.jpg")])).upsert_cluster(7, "Ada").update_faces_association_batch([1], 7)
    db = db.upsert_cluster(8, "").update_faces_association_batch([2], 8)
    after = db.rename_person("Ada", "Grace").rename_person("Person 8", "Mary").rename_person("nobody", "x")
    assert {r.cluster_id: r.custom_name for r in after.get_clusters().collect()} == {7: "Grace", 8: "Mary"}


def test_timer():
    told = []
    with timed("x", told.append):
        pass
    assert told[0].startswith("x: ")


def test_ignored_faces_do_not_match_themselves(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.99, 0.1])], "id long, vector array<double>")
    ignored = rows.where("id in (1, 2)")
    got = {r.id for r in V.ignored_match(rows, ignored, 0.2).collect()}
    assert got == {3}
    plan = {r.id: (r.label, r.matches_ignored) for r in V.cluster_faces(rows, ignored, 0.2, 1, 100).collect()}
    assert plan[3] == (None, True) and plan[1][0] == 100 and plan[2][0] == 101


def test_members_of_a_group(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.2]), (3, "a", [1.0, 0.9])], "id long, owner string, vector array<double>")
    assert V.cluster_representative(rows).first().id == 2
    chunks = V.chunk_resort(rows.select("id", F.col("id").cast("double").alias("distance"), (-F.col("id")).alias("similarity")), 2)
    assert [(r.id, r.chunk, r.place) for r in chunks.orderBy("id").collect()] == [(1, 0, 1), (2, 0, 2), (3, 1, 1)]
