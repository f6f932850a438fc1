"""Near-duplicate groups that are kept while files come and go.

What is kept is a row for each file that ever had a near duplicate: ``file_path,
component, video`` with the least file that it is linked to, and whether it is an
end of a link that touches a video.  New files are compared among themselves and
with the files that were there, which never meet again; their links join the
names of kept components, so rounds run over the batch's links only and the kept
rows are relabelled by one join.  Where files go, the components that held them
are found again from their other files, as no link leaves a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.components import connected_components
from lumenframe.operators.vectors import accepted_links, near_groups
from lumenframe.storage import cut_lineage

KEPT = "file_path string, component string, video boolean"


def nothing_kept(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KEPT)


def _linked(kept: DataFrame, links: DataFrame, touched: DataFrame) -> DataFrame:
    """``kept`` after ``links`` (``src, dst``) and files ``touched`` by a link with a video."""
    named = lambda side: kept.select(F.col("file_path").alias(side), F.col("component").alias(f"c{side}"))
    ends = links.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    merged = connected_components(ends.select(F.coalesce("csrc", "src").alias("src"), F.coalesce("cdst", "dst").alias("dst")))
    merged = cut_lineage(merged.select(F.col("id").alias("component"), F.col("component").alias("now")), "joined-names")

    ends = links.select(F.explode(F.array("src", "dst")).alias("file_path")).distinct()
    files = ends.join(touched.select("file_path", F.lit(True).alias("touched")).distinct(), "file_path", "full")
    rows = kept.join(files, "file_path", "full").withColumn("component", F.coalesce("component", "file_path"))
    rows = rows.join(merged, "component", "left")
    seen = F.coalesce("video", F.lit(False)) | F.coalesce("touched", F.lit(False))
    return cut_lineage(rows.select("file_path", F.coalesce("now", "component").alias("component"), seen.alias("video")), "kept-groups")


def add_files(kept: DataFrame, media: DataFrame, old: DataFrame, new: DataFrame, radius: float = 0.6, rerank: float | None = None) -> DataFrame:
    """``kept`` after ``new`` came beside ``old`` (both ``id, file_path, vector``, no id in both); ``media`` holds the files of both."""
    old, new = old.select("id", "file_path", "vector"), new.select("id", "file_path", "vector")
    (inner, video), (outer, more) = accepted_links(media, new, radius, rerank), accepted_links(media, new, radius, rerank, old)
    return _linked(kept, inner.union(outer), video.union(more))


def remove_files(kept: DataFrame, media: DataFrame, vectors: DataFrame, gone: DataFrame, radius: float = 0.6, rerank: float | None = None) -> DataFrame:
    """``kept`` after the files ``gone`` (``file_path``) went; ``vectors`` may still hold theirs."""
    hit = cut_lineage(kept.join(gone, "file_path", "left_semi").select("component").distinct(), "broken-groups")
    again = kept.join(hit, "component", "left_semi").join(gone, "file_path", "left_anti").select("file_path")
    rows = cut_lineage(vectors.select("id", "file_path", "vector").join(again, "file_path", "left_semi"), "broken-files")
    return _linked(kept.join(hit, "component", "left_anti").select("file_path", "component", "video"), *accepted_links(media, rows, radius, rerank))


def kept_groups(media: DataFrame, kept: DataFrame) -> DataFrame:
    """Groups of equal hashes and kept links, as ``near_groups`` gives them."""
    stars = kept.where("file_path <> component").select(F.col("component").alias("src"), F.col("file_path").alias("dst"))
    return near_groups(media, stars, touched=kept.where("video").select("file_path"))
