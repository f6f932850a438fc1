"""Dense numbers for rows in a global order, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import cut_lineage

_PLACE = (1 << 33) - 1  # lower bits of monotonically_increasing_id


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... along ``order``, which should tell all rows apart.

    Ranges of the order are dealt out and sorted; the counts of the ranges, one
    row each, give the number at which each range starts.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    held = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = accumulate((n for _, n in held), initial=1)
    table = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(held, starts)], "__part long, __start long")
    out = ranged.withColumn("__part", part).join(F.broadcast(table), "__part")  # a row for each range
    return out.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_PLACE))).drop("__part", "__start", "__at")


def ranked(rows: DataFrame, by: str, *order: str | Column, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... along ``order`` inside each ``by``, of which null is one; a large ``by`` is many ranges."""
    all_ = numbered(rows, by, *order, name=name)
    first = all_.groupBy(F.col(by).alias("__by")).agg(F.min(name).alias("__first"))
    return all_.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col(name) - F.col("__first")).drop("__by", "__first")
