"""Operator 7: quality classifier, histogram gradient-boosted trees over document statistics.

Statistics of whole texts (``_stats.FEATURES``: lengths, shares of characters,
repeated words and lines) are the only inputs.  Labels are learned from rows
whose crc32(doc_id as text) mod 5 isn't 0; of them the ``max_train`` with the
least hash of doc_id are the documented sample.  The flattened trees go to the
executors (some 100 KB whatever the input), which score every document.

A null text counts as empty and is scored; a null doc_id is never held out and
never trains; rows that repeat get the same score; null labels don't train;
without labels the score is 0.5 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._gbt import Trees, fit
from lumenframe.llm._stats import FEATURES, features
from lumenframe.llm._text import as_bytes, slices, small_batches

FOLDS = 5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _feature_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = features(as_bytes(batch.column("text"), lower=False))
        columns = [batch.column(x) for x in ("doc_id", "digest", "label")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "digest", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 20_000, **options) -> Trees:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold.

    A doc_id with labels of both kinds isn't used; of a doc_id with several
    texts, the one of the least hash is.
    """
    small_batches(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = own.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("digest"), "label", "text")  # at most max_train rows of 12 bytes
    found = picked.mapInArrow(_feature_pass, "doc_id long, digest long, label int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("digest", "x", "label")).alias("row")).select("row.label", "row.x").toArrow()
    y = np.array(found.column("label").to_pylist(), dtype=np.float64)
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same trees, however rows arrive
    return fit(x[order], y[order], **options)


def _score_pass(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.value.score(features(as_bytes(batch.column("text"), lower=False)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_score_pass(sent, threshold), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))
