"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity to it,
so sizes are partitioned first.  Items fall into classes of sizes (u/2, u].
For each class the documents are cut into overlapping windows of 2u shingles
that start every u/2, so an item's passage, with up to half as much between its
parts, lies inside one window.  Inside a class, containment ``percent`` turns
into a Jaccard similarity of at least ``j = c q / (q + w - c q)`` for the
smallest item q and a full window w, and the number of hash functions is
chosen so that all of them miss with probability below ``miss``.  Windows that
share a minimum with an item are candidates; each candidate document is then
verified: exact share of the item's distinct five-word shingles that the whole
document holds, at least ``percent``/100.

Items are the stated query set, sent to the executors in blocks of
``block_items``; each block is matched against all documents in one pass
without a shuffle, so copies and hot sources cost what other rows cost.

Items of fewer than five words are one shingle, their whole sequence, and match
documents of the same words only.  Null or wordless items and documents match
nothing; an empty benchmark or table gives an empty result; rows that repeat
give repeated results for documents, one for items with equal id and set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm._rows import without
from lumenframe.llm._text import as_bytes, distinct_sets, shingles, slices, small_batches

SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"
_LOOK = 16


@dataclass
class SizeClass:
    """Items of sizes (upper/2, upper] and their minima under each hash function."""

    upper: int
    hashes: int
    items: list[int]
    minima: np.ndarray
    owners: np.ndarray
    look: np.ndarray


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(values: np.ndarray, by: np.uint64) -> np.ndarray:
    out = values * by
    out ^= out >> np.uint64(32)
    return out


def size_classes(sets: list[np.ndarray], percent: int, miss: float) -> list[SizeClass]:
    found = []
    uppers = sorted({max(8, 1 << (len(s) - 1).bit_length()) for s in sets if len(s)})
    for upper in uppers:
        own = [i for i, s in enumerate(sets) if len(s) and max(8, 1 << (len(s) - 1).bit_length()) == upper]
        q = min(len(sets[i]) for i in own)
        shared = math.ceil(percent * q / 100)
        j = shared / (q + 2 * upper - shared)
        n = max(8, math.ceil(math.log(miss) / math.log(1 - j)))
        mult = _multipliers(n)
        minima, owners, look = [], [], np.zeros((n, 1 << _LOOK), dtype=bool)
        for h in range(n):
            low = np.array([_hash(sets[i], mult[h]).min() for i in own], dtype=np.uint64)
            order = np.argsort(low, kind="stable")
            minima.append(low[order])
            owners.append(np.array(own)[order])
            look[h, (low & np.uint64((1 << _LOOK) - 1)).astype(np.int64)] = True
        found.append(SizeClass(upper, n, own, np.array(minima), np.array(owners), look))
    return found


def _candidates(flat: np.ndarray, at: np.ndarray, classes: list[SizeClass]) -> set[tuple[int, int]]:
    """(document, item) pairs of which a window and the item share a minimum."""
    out: set[tuple[int, int]] = set()
    n = np.diff(at)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    for c in classes:
        step = c.upper // 2
        blocks = -(-n[full] // step)
        first = np.concatenate(([0], np.cumsum(blocks)))
        inside = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
        starts = np.repeat(at[:-1][full], blocks) + inside * step
        home = np.repeat(full, blocks)
        left = np.repeat(blocks, blocks) - inside
        for h, by in enumerate(_multipliers(c.hashes)):
            low = np.minimum.reduceat(_hash(flat, by), starts)
            window = low.copy()
            for k in range(1, 4):  # four blocks make a window; the last ones of a document are shorter
                if len(low) > k:
                    np.minimum(window[:-k], np.where(left[:-k] > k, low[k:], window[:-k]), out=window[:-k])
            hit = np.flatnonzero(c.look[h][(window & np.uint64((1 << _LOOK) - 1)).astype(np.int64)])
            from_ = np.searchsorted(c.minima[h], window[hit], "left")
            to = np.searchsorted(c.minima[h], window[hit], "right")
            for k in np.flatnonzero(to > from_).tolist():
                out.update((int(home[hit[k]]), int(i)) for i in c.owners[h][from_[k] : to[k]])
    return out


def _match_pass(block, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, classes = block.value
        for batch in slices(batches, limit=4 << 20):
            flat, at = shingles(as_bytes(batch.column("text")))
            doc_ids = batch.column("doc_id")
            rows = []
            for d, i in sorted(_candidates(flat, at, classes)):
                own = np.unique(flat[at[d] : at[d + 1]])
                shared = int(np.isin(sets[i], own, assume_unique=True).sum())
                if 100 * shared >= percent * len(sets[i]):
                    rows.append((doc_ids[d].as_py(), ids[i], shared, len(sets[i]), shared / len(sets[i])))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, miss: float = 1e-6, block_items: int = 20_000) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: every item inside a document."""
    spark = docs.sparkSession
    small_batches(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], SCHEMA)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held: list = []
    for row in wanted.orderBy("item_id", "text").toLocalIterator():
        held.append(row)
        if len(held) >= block_items:
            found = found.union(_match_block(text, held, percent, miss))
            held = []
    return found.union(_match_block(text, held, percent, miss)) if held else found


def _match_block(text: DataFrame, held: list, percent: int, miss: float) -> DataFrame:
    flat, at = distinct_sets(*shingles([r.text.encode("utf-8", "surrogatepass").lower() for r in held]))
    every = {(r.item_id, flat[a:b].tobytes()): flat[a:b] for r, a, b in zip(held, at.tolist(), at.tolist()[1:])}
    ids, sets = [k[0] for k in every], list(every.values())
    block = text.sparkSession.sparkContext.broadcast((ids, sets, size_classes(sets, percent, miss)))
    return text.mapInArrow(_match_pass(block, percent), SCHEMA)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents that hold no item; the rows of a doc_id stay or go together, rows without one stay."""
    return without(docs, contained_items(docs, items, **options))
