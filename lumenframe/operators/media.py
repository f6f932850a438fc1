"""Catalogue reads over media: filters, pages, facets, counts, duplicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.catalog import CORRUPTED, DUPLICATES, NO_FACES, Catalog, UnknownAction
from lumenframe.functions import text as T
from lumenframe.storage import cut_lineage

SOUND = "coalesce(is_corrupted, 0) = 0"


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def of_category(c: Catalog, rows: DataFrame, cluster_id: int | None) -> DataFrame:
    """Rows of a media category: all, without faces, duplicates, corrupted or of one person."""
    if cluster_id is None:
        return rows.where(SOUND)
    if cluster_id == NO_FACES:
        return rows.where(SOUND).join(c.faces.select("path_key"), "path_key", "left_anti")
    if cluster_id == DUPLICATES:
        return rows.where(SOUND).where("group_id is not null")
    if cluster_id == CORRUPTED:
        return rows.where("is_corrupted = 1")
    return media_of_person(c, rows, cluster_id)


def media_of_person(c: Catalog, rows: DataFrame, person: int) -> DataFrame:
    """A semi join: a file with many faces of the person is one row."""
    return rows.join(c.faces.where(F.col("cluster_id") == person).select("path_key"), "path_key", "left_semi")


def filter_media(
    c: Catalog,
    cluster_id: int | None = None,
    year: int | None = None,
    month: int | None = None,
    location: str | None = None,
    include_trash: bool = False,
    root: str | None = None,
    discovery: str | None = None,
) -> DataFrame:
    """Media rows with location and group columns under all given filters; None and 0 don't filter."""
    tests: list[Column] = []
    if not include_trash:
        tests.append(F.col("is_in_trash") == 0)
    if root:
        tests.append(T.under_folder(F.col("path_key"), root))
    if year:
        tests.append(F.col("year") == year)
    if month:
        tests.append(F.col("month") == month)
    rows = of_category(c, c.media.where(_all(tests)), cluster_id)
    rows = rows.join(c.locations, "location_id", "left").join(c.groups, "group_id", "left")
    if location:
        rows = rows.where((F.col("city") == location) | (F.col("prefecture") == location) | (F.col("country") == location))
    if discovery and cluster_id == DUPLICATES:
        kind = F.col("discovery_method")
        rows = rows.where(F.startswith(kind, F.lit("ai_")) if discovery == "ai_local" else kind == discovery)
    return rows


def duplicate_flag(media: DataFrame, include_trash: bool = False) -> DataFrame:
    """``is_duplicate``: another visible member of the row's group exists. Rows without a group take no part in the counts."""
    seen = F.lit(True) if include_trash else F.col("is_in_trash") == 0
    members = media.where("group_id is not null").groupBy("group_id").agg(F.count_if(seen).alias("members"))
    rows = media.join(members, "group_id", "left").withColumn("is_duplicate", F.when(F.col("members") - seen.cast("int") > 0, 1).otherwise(0))
    return rows.select(*media.columns, "is_duplicate")


def person_tags(c: Catalog) -> DataFrame:
    """``path_key, tags``: distinct ``id:name`` of a file's persons that aren't ignored."""
    joined = c.faces.join(c.clusters.withColumnRenamed("is_ignored", "hidden"), "cluster_id", "left").where("coalesce(hidden, 0) = 0")
    tag = F.concat(F.coalesce("cluster_id", F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("custom_name", F.lit("")))
    return joined.select("path_key", tag.alias("tag")).distinct().groupBy("path_key").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


MAX_LOCAL = 10_000
PAGE = ("file_path", "last_modified", "capture_date", "size", "is_in_trash", "group_id", "is_duplicate", "discovery_method", "country", "prefecture", "city", "tags")


def page_order(cluster_id: int | None) -> list[Column]:
    """Newest first; duplicates by group first."""
    newest = [F.col("capture_date").desc_nulls_last(), F.col("file_path").desc_nulls_last()]
    return [F.col("group_id").asc_nulls_first(), F.col("is_in_trash").asc_nulls_first(), *newest] if cluster_id == DUPLICATES else newest


def seek_media(rows: DataFrame, last_date: str | None, last_path: str | None = None) -> DataFrame:
    """Rows after a page's last row, newest first."""
    if last_date is None:
        return rows
    older = F.col("capture_date") < last_date
    return rows.where(older if last_path is None else older | ((F.col("capture_date") == last_date) & (F.col("file_path") < last_path)))


def media_page(c: Catalog, cluster_id: int | None = None, limit: int = 100, offset: int = 0, last_date: str | None = None, last_path: str | None = None, include_trash: bool = False, **filters) -> DataFrame:
    """One page of twelve columns.

    The page is ranked once; its few rows are then a local table, so flags and
    tags, which need whole groups and all faces, are computed for them alone.
    """
    rows = seek_media(filter_media(c, cluster_id, include_trash=include_trash, **filters), last_date, last_path)
    rows = rows.orderBy(*page_order(cluster_id))
    page = _held((rows.offset(offset) if offset else rows).limit(limit).select("path_key", *[x for x in PAGE if x not in ("is_duplicate", "tags")]), limit)
    groups = F.broadcast(page.where("group_id is not null").select("group_id").distinct())  # at most a page of rows
    seen = F.lit(True) if include_trash else F.col("is_in_trash") == 0
    members = c.media.join(groups, "group_id", "left_semi").groupBy("group_id").agg(F.count_if(seen).alias("members"))
    tags = person_tags(c.having(faces=c.faces.join(F.broadcast(page.select("path_key")), "path_key", "left_semi")))
    others = F.col("members") - seen.cast("int") > 0
    out = page.join(F.broadcast(members), "group_id", "left").join(F.broadcast(tags), "path_key", "left")  # a row per group and file of the page
    return out.withColumn("is_duplicate", F.when(others, 1).otherwise(0)).select(*PAGE)


def _held(page: DataFrame, rows: int) -> DataFrame:
    """A page's rows, computed now: at the driver if a page is as small as a page is, else in the shared folder."""
    return page.sparkSession.createDataFrame(page.toArrow(), page.schema) if rows <= MAX_LOCAL else cut_lineage(page, "page")


def page_result(page: DataFrame, limit: int, date: str = "capture_date", key: str = "file_path") -> DataFrame:
    """One row: whether more may follow, and the cursor of the last row."""
    last = F.min_by(F.struct(F.col(date).alias("date"), F.col(key).alias("key")), F.struct(F.coalesce(date, F.lit("")), F.col(key)))
    return page.agg(F.count("*").alias("n"), last.alias("last")).select((F.col("n") >= limit).alias("has_more"), F.col("last.date").alias("next_date"), F.col("last.key").alias("next_key"))


def media_by_path(c: Catalog, path: str) -> DataFrame:
    """One media row with location, features and year and month read from the date again."""
    row = c.media.where(F.col("path_key") == path.lower())
    row = row.join(c.locations, "location_id", "left").join(c.features.select(F.lower("file_path").alias("path_key"), "vector"), "path_key", "left")
    date = F.col("capture_date")
    return row.select(
        "file_path", "last_modified", "metadata_json", "group_id", "location_id", "thumbnail_path", "is_corrupted", "is_in_trash", "capture_date", "file_hash",
        T.year_text(date).alias("year"), T.month_text(date).alias("month"), "country", "prefecture", "city", "vector",
    )


def signatures(c: Catalog, include_trash: bool = False) -> DataFrame:
    """What near-duplicate search starts from: hashed rows with vector and former method, group cleared."""
    rows = c.media.where("coalesce(file_hash, '') <> ''")
    if not include_trash:
        rows = rows.where("is_in_trash = 0")
    rows = rows.join(c.features.select("file_path", "vector"), "file_path", "left").join(c.groups, "group_id", "left")
    return rows.withColumn("group_id", F.lit(None).cast("string")).select("file_path", "file_hash", "size", "has_exif_date", "has_location", "discovery_method", "group_id", "vector")


def years_facet(c: Catalog, cluster_id: int | None = None, include_trash: bool = False) -> DataFrame:
    return _facet_rows(c, cluster_id, include_trash).groupBy("year").agg(F.count("*").alias("n")).where("year is not null").orderBy(F.desc("year"))


def months_facet(c: Catalog, cluster_id: int | None, year: int, include_trash: bool = False) -> DataFrame:
    rows = _facet_rows(c, cluster_id, include_trash).where(F.col("year") == year)
    return rows.groupBy(F.col("month").cast("int").alias("month")).agg(F.count("*").alias("n")).where("month is not null").orderBy("month")


def locations_facet(c: Catalog, cluster_id: int | None = None, year: int | None = None, month: int | None = None, include_trash: bool = False) -> DataFrame:
    rows = _facet_rows(c, cluster_id, include_trash)
    if year:
        rows = rows.where(F.col("year") == year)
    if month:
        rows = rows.where(F.col("month") == month)
    return rows.join(c.locations, "location_id").groupBy("city").agg(F.count("*").alias("n")).where("city is not null").orderBy("city")


def _facet_rows(c: Catalog, cluster_id: int | None, include_trash: bool) -> DataFrame:
    rows = c.media if include_trash else c.media.where("coalesce(is_in_trash, 0) = 0")
    rows = of_category(c, rows, cluster_id)
    return rows if cluster_id == CORRUPTED else rows.where(SOUND)


def drill_down(c: Catalog) -> DataFrame:
    """Year, month and city counts in one pass; ``level`` 0 to 2."""
    rows = _facet_rows(c, None, False).join(c.locations.select("location_id", "city"), "location_id", "left")
    sets = rows.groupingSets([["year"], ["year", "month"], ["year", "month", "city"]], "year", "month", "city")
    return sets.agg(F.count("*").alias("n"), (2 - F.grouping("month").cast("int") - F.grouping("city").cast("int")).alias("level")).select("level", "year", "month", "city", "n")


def facet(c: Catalog, level: str, cluster_id: int | None = None, year: int | None = None, month: int | None = None) -> DataFrame:
    """Dispatch by level; an unknown level has no rows."""
    if level == "months" and year:
        return months_facet(c, cluster_id, year)
    if level == "locations":
        return locations_facet(c, cluster_id, year, month)
    found = years_facet(c, cluster_id)
    return found if level == "years" else found.limit(0)


def root_counts(c: Catalog, root: str | None = None) -> DataFrame:
    """All, faceless, duplicate and corrupted files in one pass over media; trash never counts."""
    rows = c.media.where("is_in_trash = 0")
    if root:
        rows = rows.where(T.under_folder(F.col("path_key"), root))
    rows = rows.join(c.faces.select("path_key").distinct().withColumn("has_face", F.lit(1)), "path_key", "left")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("has_face").isNull() & F.expr(SOUND)).alias("no_faces"),
        F.count_if(F.col("group_id").isNotNull() & F.expr(SOUND)).alias("duplicates"),
        F.count_if(F.col("is_corrupted") == 1).alias("corrupted"),
    )


def duplicate_stats(c: Catalog, include_trash: bool = False, root: str | None = None, discovery: str | None = None) -> DataFrame:
    rows = filter_media(c, DUPLICATES, include_trash=include_trash, root=root, discovery=discovery)
    return rows.agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("files"))


def duplicate_members(c: Catalog) -> DataFrame:
    """Members of groups with more than one hashed row."""
    rows = c.media.where("coalesce(file_hash, '') <> '' and group_id is not null").join(c.groups, "group_id")
    big = rows.groupBy("group_id").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(big, "group_id").select("group_id", "members", "file_path", "discovery_method")


def section_headers(page: DataFrame, order: list[Column], last_date: str | None = None, last_label: str | None = None) -> DataFrame:
    """``section`` number and ``is_header`` where day or place changes along ``order``; a page's rows only."""
    keyed = page.withColumns({"day": T.date_header(F.col("capture_date")), "label": T.location_label(F.col("country"), F.col("prefecture"), F.col("city"))})
    w = Window.orderBy(*order)
    before = F.struct("day", "label")
    first = F.struct(F.lit(last_date).alias("day"), F.lit(last_label).alias("label"))
    changed = ~F.coalesce(F.lag(before).over(w), first).eqNullSafe(before)
    keyed = keyed.withColumn("is_header", changed.cast("int"))
    return keyed.withColumn("section", F.sum("is_header").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def group_display_ids(page: DataFrame, order: list[Column]) -> DataFrame:
    """``display_id`` 1..n for groups in the order in which a page first shows them."""
    key = F.lower(F.trim("group_id"))
    numbered = page.withColumn("at", F.row_number().over(Window.orderBy(*order))).withColumn("key", key)
    first = numbered.withColumn("first", F.min("at").over(Window.partitionBy("key")))
    return first.withColumn("display_id", F.when(F.col("key").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("key").isNull(), "first")))).drop("at", "key", "first")


def chunk_numbers(page: DataFrame, order: list[Column], sizes: tuple[int, ...] = (10, 30), rest: int = 50) -> DataFrame:
    """``chunk``: how a page is handed on, small pieces first."""
    at = F.row_number().over(Window.orderBy(*order)) - 1
    chunk, start = None, 0
    for i, n in enumerate(sizes):
        chunk = F.when(at < start + n, i) if chunk is None else chunk.when(at < start + n, i)
        start += n
    later = (F.floor((at - start) / rest) + len(sizes)).cast("int")
    return page.withColumn("chunk", later if chunk is None else chunk.otherwise(later))


def select_where(rows: DataFrame, test: Callable[[DataFrame], Column] | Column) -> DataFrame:
    """``selected`` by the caller's predicate; null counts as no."""
    return rows.withColumn("selected", F.coalesce(test(rows) if callable(test) and not isinstance(test, Column) else test, F.lit(False)))


def survivor_rank(rows: DataFrame, group: str = "group_id") -> DataFrame:
    """``rank`` inside a group: files with camera date or place first, then larger, then by path."""
    best = [(F.col("has_exif_date") | F.col("has_location")).desc(), F.col("size").desc(), F.col("file_path")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*best)))


def category(name: str) -> int | None:
    """Sentinel of a category's name."""
    found = {"all": None, "no_faces": NO_FACES, "duplicates": DUPLICATES, "corrupted": CORRUPTED}
    if name not in found:
        raise UnknownAction(name)
    return found[name]
