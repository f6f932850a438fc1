"""Taking documents out of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.storage import cut_lineage


def without(docs: DataFrame, gone: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``docs`` without the doc_ids in ``gone``; rows without a doc_id stay.

    Up to ``most`` ids (8 bytes each) are sent to all executors, so texts stay
    where they are; more of them are joined by a shuffle.
    """
    gone = cut_lineage(gone.select("doc_id").distinct(), "gone")
    ids = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
