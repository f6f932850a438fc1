"""Connected components by alternating large-star / small-star contraction.

Every round replaces the edge list by one of the same components whose longest
path is shorter; it ends when the list is a forest of stars around each
component's smallest id.  A round is two aggregations and two joins, all
distributed; lineage is cut by writing each round to the shared folder.  A list
that has been counted and holds at most FEW edges is joined in one task instead,
as a round costs more than all of its work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import cut_lineage, drop

FEW = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one partition of edges, by union and find."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            if a != b:
                low, high = (a, b) if _order(a) < _order(b) else (b, a)
                up[high] = low
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(up.keys(), kind), pa.array([find(x) for x in up], kind)], names=["id", "component"])


def _order(x):
    """Spark's order: texts by code points, as UTF-8 has it."""
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x


def _smallest(edges: DataFrame) -> DataFrame:
    """The least of each node's neighbours and itself."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest(both)
    return (
        both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _smallest(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hubs = low.select("u", F.col("m").alias("v"))
    return moved.union(hubs).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60, rows: int | None = None, few: int = FEW) -> DataFrame:
    """``(id, component)`` for every node that occurs in ``edges``.

    ``component`` is the smallest id that can be reached.  Self loops and
    repeated edges are harmless, edges with a null end are ignored, and an
    empty list gives an empty result.  ``rows`` is about the number of edges, if
    it is known.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select(F.col("u").alias("id")).distinct()
    now = cut_lineage(pairs.where("u <> v").distinct(), "cc", rows)
    held = now.count()
    if held <= few:
        kind = now.schema["u"].dataType.simpleString()
        joined = now.coalesce(1).mapInArrow(_joined, f"id {kind}, component {kind}")
        return joined.union(alone.join(joined, "id", "left_anti").select("id", F.col("id").alias("component")))
    mark = None
    for _ in range(max_rounds):
        last, now = now, cut_lineage(_small_star(_large_star(now)), "cc", held)
        drop(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    joined = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    )
    return joined.union(alone.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
