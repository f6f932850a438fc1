"""Small cases with known answers: paging, tags, upserts, audit, folders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog, CatalogError, UnknownAction
from lumenframe.functions import geo, text
from lumenframe.operators import media as M
from lumenframe.operators import mutations as X
from lumenframe.operators import people as P
from lumenframe.sources.files import read_gazetteer, scan_files

MEDIA = "file_path string, path_key string, last_modified double, size long, has_exif_date boolean, has_location boolean, location_id int, is_corrupted int, is_in_trash int, capture_date string, year int, month int, file_hash string, thumbnail_path string, metadata_json string, group_id string"
FACES = "face_id long, file_path string, path_key string, cluster_id long, is_ignored int, frame_index int, x1 double, y1 double, x2 double, y2 double, det_score double, capture_date string"


def catalog(spark, media=(), faces=(), clusters=(), locations=(), groups=()):
    return Catalog(
        spark.createDataFrame(list(media), MEDIA),
        spark.createDataFrame(list(faces), FACES),
        spark.createDataFrame(list(clusters), "cluster_id long, custom_name string, is_ignored int"),
        spark.createDataFrame(list(locations), "location_id int, country string, prefecture string, city string"),
        spark.createDataFrame(list(groups), "group_id string, discovery_method string"),
        spark.createDataFrame([], "file_path string, vector array<float>"),
        spark.createDataFrame([("a", "1")], "key string, value string"),
    )


def row(path, date="2024:01:01 12:00:00", **more):
    base = dict(file_path=path, path_key=path.lower(), last_modified=1.0, size=10, has_exif_date=False, has_location=False, location_id=None, is_corrupted=0, is_in_trash=0, capture_date=date, year=int(date[:4]) if date else None, month=int(date[5:7]) if date else None, file_hash="h", thumbnail_path="t", metadata_json="{}", group_id=None)
    return tuple((base | more).values())


def face(number, path, cluster=-1, ignored=0, box=(0.0, 0.0, 50.0, 50.0), score=0.9):
    return (number, path, path.lower(), cluster, ignored, 0, *box, score, "2024:01:01 12:00:00")


def test_many_faces_of_a_person_are_one_row(spark):
    c = catalog(spark, [row("/p/a.jpg")], [face(i, "/p/a.jpg", 100) for i in range(50)], [(100, "Person 100", 0)])
    rows = M.media_page(c, cluster_id=100).collect()
    assert len(rows) == 1 and rows[0].tags == "100:Person 100"
    assert [r.year for r in M.years_facet(c, 100).collect()] == [2024]


def test_faces_and_photos_are_counted_apart(spark):
    c = catalog(spark, [], [face(1, "/p1", 1), face(2, "/p1", 1), face(3, "/p2", 1), face(4, "/p3"), face(5, "/p4", 2, 1)], [(1, "A", 0)])
    assert {r.bucket: r.n for r in P.face_counts(c).collect()} == {"1": 3, "unknown": 1, "ignored": 1}
    assert [(r.cluster_id, r.photos) for r in P.person_photo_counts(c).collect()] == [(1, 2)]


def test_upsert_keeps_the_hash(spark):
    c = catalog(spark, [row("/P/A.jpg", last_modified=123.0)])
    batch = spark.createDataFrame([("/p/a.JPG", 456.0, None)], "file_path string, last_modified double, file_hash string")
    (r,) = X.upsert_media(c, batch).media.collect()
    assert (r.last_modified, r.file_hash, r.path_key) == (456.0, "h", "/p/a.jpg")


def test_pages_do_not_repeat(spark):
    c = catalog(spark, [row("/p/a.jpg")], [face(i, "/p/a.jpg") for i in range(50)])
    seen, date, last = [], None, None
    for n in (20, 20, 10):
        page = P.faces_page(c, "unknown", limit=20, last_date=date, last_face=last).collect()
        assert len(page) == n
        seen += [r.face_id for r in page]
        date, last = page[-1].capture_date, page[-1].face_id
    assert seen == list(range(49, -1, -1))


def test_folder_with_wildcards_is_taken_literally(spark):
    paths = ["/a/[x]%_f/1.jpg", "/a/[x]%_f2/1.jpg", "/a/b/1.jpg"]
    c = catalog(spark, [], [face(i, p) for i, p in enumerate(paths)])
    assert [r.face_id for r in X.clear_faces(c, "/a/[x]%_f").faces.collect()] == [1, 2]


def test_audit_of_a_healthy_catalogue_is_zero(spark):
    c = catalog(spark, [row("/p/a.jpg")], [face(1, "/p/a.jpg", 1)], [(1, "A", 0)])
    audit = P.full_audit(c, c.media, c.media).first()
    assert set(audit.asDict().values()) == {0}


def test_unknown_action_is_an_error(spark):
    c = catalog(spark)
    with pytest.raises(UnknownAction):
        X.person_action(c, "fly")
    assert issubclass(UnknownAction, CatalogError) and issubclass(UnknownAction, ValueError)
    assert M.facet(c, "weeks").count() == 0


def test_a_group_whose_other_member_is_in_the_trash_is_no_duplicate(spark):
    c = catalog(spark, [row("/a", group_id="g"), row("/b", group_id="g", is_in_trash=1), row("/c", group_id="k"), row("/d", group_id="k")])
    flags = {r.file_path: r.is_duplicate for r in M.duplicate_flag(c.media).collect()}
    assert flags == {"/a": 0, "/b": 1, "/c": 1, "/d": 1}


def test_cleanup_keeps_the_best_file(spark):
    c = catalog(spark, [row("/a", group_id="g", size=5), row("/b", group_id="g", size=1, has_exif_date=True, is_in_trash=1), row("/c", group_id="g", size=9)])
    plan = {r.file_path: r.action for r in X.cleanup_plan(M.survivor_rank(c.media)).collect()}
    assert plan == {"/a": "trash", "/b": "restore", "/c": "trash"}


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(
        text.location_label(F.lit("Japan"), F.lit("Tokyo"), F.lit("Minato")).alias("home"),
        text.location_label(F.lit("France"), F.lit("IDF"), F.lit("Paris")).alias("away"),
        text.location_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("none"),
        text.size_text(F.lit(1048577.0)).alias("mb"),
        geo.iso6709(F.lit("+35.5-120.25+10/")).alias("p"),
        geo.dms_to_decimal(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("S")).alias("dms"),
        text.pct_coerce(F.lit("42"), 0.5).alias("pct"),
    ).first()
    assert (r.home, r.away, r.none, r.mb) == ("Tokyo, Minato", "France, Paris", "Unknown Location", "1.0 MB")
    assert (r.p.lat, r.p.lon, r.dms, r.pct) == (35.5, -120.25, -10.5, 0.42)


def test_sources(spark, tmp_path):
    top = tmp_path / ".trash" / "files"  # what lies above the root says nothing
    always = ["a.jpg", "d/e.MP4", "trashcan-band/g.png", "d/Trashed.jpg"]
    trash = [".hidden/c.jpg", "Trash/f.jpg", "$Recycle.bin/h.bmp", "d/.trash-1000/i.mov", "d/.j.jpg"]
    for name in (*always, *trash, "b.txt", ".git/k.jpg", "d/__pycache__/l.jpg"):
        (top / name).parent.mkdir(exist_ok=True, parents=True)
        (top / name).write_bytes(b"x")
    below = lambda **options: sorted(r.file_path.split("/files/", 1)[1] for r in scan_files(spark, str(top), **options).collect())
    assert below() == sorted(always)
    assert below(include_trash=True) == sorted(always + trash)
    (one,) = (r for r in scan_files(spark, f"file://{top}", with_content=True).collect() if r.file_path.endswith("a.jpg"))
    assert (one.size, bytes(one.content)) == (1, b"x") and abs(one.last_modified - (top / "a.jpg").stat().st_mtime) < 1e-3
    assert one.file_path == f"file:{top}/a.jpg" and scan_files(spark, str(tmp_path / "none")).collect() == []
    tsv = tmp_path / "cities.tsv"
    tsv.write_text("\t".join(["1", "Ville", "", "", "1.5", "2.5", "P", "PPL", "FR", "", "A8"] + [""] * 8) + "\nshort\n")
    (city,) = read_gazetteer(spark, str(tsv)).collect()
    assert (city.city, city.lat, city.lon, city.code) == ("Ville", 1.5, 2.5, "FR.A8")


def test_person_page_plan_reaches_the_scan(spark, sf_dir):
    from lumenframe.plans import registry

    plan = registry.queries()["paths_in_folder"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    plan = registry.queries()["media_of_person"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_catalog_round_trip(spark, tmp_path):
    c = catalog(spark, [row("/a")])
    c.save(str(tmp_path / "c"))
    assert Catalog.load(spark, str(tmp_path / "c")).media.count() == 1
