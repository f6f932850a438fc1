"""Operator 13: exact top-k search by inner product over an impact-ordered index.

The index cuts the rows into blocks.  In a block, the entries other than 0 of
every dimension are postings (place of the row, value); their impact, the size
of the value, is quantised to half powers of two, and the postings of one
dimension and one quantised impact are a *segment*.  A segment is a row of the
index table, so the index is built and read by Spark, block by block.

A block of queries meets every block of the index.  Segments are taken score at
a time: all those of the greatest quantised impact first, whatever their
dimension, then the next.  After each impact the score of a row is known up to
what its entries not yet seen can add, at most the length of that rest times
the length of the query (Cauchy-Schwarz).  The k-th best of the least possible
scores is a bound that the k best of the block reach; a row whose greatest
possible score is below it is proved out.  Processing stops when the rows that
are left are at most one in STOP_SHARE, or no segment is left, and the rows
left are scored again exactly, in integers.  Nothing else is ever left out, so
the result is exact: the k best of each block hold the k best of all.

Work grows with queries times rows, as every query meets every row; what is
shuffled is the index once for each QUERY_ROWS queries, and the queries once for
each block.  A task holds one block and SUB_ROWS queries' scores, whatever the
input.

Vectors that are null or hold a null or non-finite component take no part.
Vectors of different lengths meet as if the shorter ended in zeros.  Every row
is a query and a candidate of its own, also if it repeats another or its id;
rows without an id are candidates.  Ties go to the smaller id, null last.
Scores beyond a long count as the greatest or least long.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.whitening import integers, usable
from lumenframe.storage import cut_lineage, drop

BLOCK_ROWS = 8192
QUERY_ROWS = 8192
SUB_ROWS = 128
STOP_SHARE = 32
_IDS = -1  # the "dimension" of the row that holds a block's ids and row numbers
_SEGMENTS = "block int, level int, dim int, places array<int>, values array<long>"
_FOUND = "query long, query_id long, row long, vec_id long, score long"
_LONG = (1 << 63) - 1


def level_of(values: np.ndarray) -> np.ndarray:
    """Quantised impact: the number of half powers of two up to the value's size; of equal sizes alike."""
    return np.floor(2 * np.log2(np.abs(values.astype(np.float64)))).astype(np.int64)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the size of each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy()


def _index_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The segments of one block, and one row with ids (``values``, null as the greatest long), whose ``places`` tell which are null."""
    rows = rows.sort_by("row")
    flat, sizes = _flat(rows.column("x"))
    place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(flat)
    flat, place, dim = flat[some], place[some], dim[some]
    level = level_of(flat)
    order = np.lexsort((place, dim, -level))
    flat, place, dim, level = flat[order], place[order], dim[order], level[order]
    new = np.flatnonzero((np.diff(level, prepend=-1 << 40) != 0) | (np.diff(dim, prepend=-1) != 0))
    bounds = np.append(new, len(flat)).astype(np.int32)
    ids = rows.column("vec_id")
    held = np.concatenate((rows.column("row").to_numpy(), ids.fill_null(_LONG).to_numpy()))
    bounds = np.append(bounds, [len(flat) + len(held)]).astype(np.int32)
    places = np.concatenate((place, np.zeros(len(sizes), dtype=np.int32), ids.is_null().to_numpy().astype(np.int32)))
    values = np.concatenate((flat, held))
    return pa.table(
        {
            "block": pa.array(np.full(len(new) + 1, key[0].as_py()), pa.int32()),
            "level": pa.array(np.append(level[new], 0), pa.int32()),
            "dim": pa.array(np.append(dim[new], _IDS), pa.int32()),
            "places": pa.ListArray.from_arrays(pa.array(bounds), pa.array(places, pa.int32())),
            "values": pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, pa.int64())),
        }
    )


def prepared(vectors: DataFrame, column: str, scale: int) -> DataFrame:
    """``row, vec_id, x`` of every vector that takes part, written once, so that row numbers stay."""
    rows = vectors.where(usable(F.col(column))).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(column), scale).alias("x"))
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "search-rows")


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """The index of ``row, vec_id, x`` as a table of segments, greatest impact first in each block."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    return rows.withColumn("block", block).groupBy("block").applyInArrow(_index_block, _SEGMENTS)


class Block:
    """One block of the index: its segments by falling impact, its rows, and how long each row's rest is after each impact."""

    def __init__(self, table: pa.Table):
        is_ids = table.column("dim").to_numpy() == _IDS
        ids = table.filter(pa.array(is_ids))
        held = _flat(ids.column("values"))[0]
        self.rows, self.ids = held[: len(held) // 2], held[len(held) // 2 :]
        self.unnamed = _flat(ids.column("places"))[0][len(self.rows) :].astype(bool)
        segments = table.filter(pa.array(~is_ids))
        values, sizes = _flat(segments.column("values"))
        places = _flat(segments.column("places"))[0]
        dim, level = (np.repeat(segments.column(c).to_numpy(), sizes) for c in ("dim", "level"))
        order = np.argsort(-level, kind="stable")
        self.place, self.dim, self.value, level = places[order], dim[order], values[order], level[order]
        self.cuts = np.append(np.flatnonzero(np.diff(level, prepend=-1 << 40)), len(level)).tolist()
        self.dims = int(dim.max(initial=-1)) + 1
        self.greatest = int(np.abs(values).max(initial=0))
        self.whole = np.zeros((len(self.rows), self.dims), dtype=np.int64)
        self.whole[self.place, self.dim] = self.value

    def impacts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each impact, greatest first: its postings as a matrix (dimensions by rows), and the length of each row's rest after it."""
        left = (self.whole.astype(np.float64) ** 2).sum(axis=1)
        for a, b in zip(self.cuts, self.cuts[1:]):
            matrix = np.zeros((self.dims, len(self.rows)))
            matrix[self.dim[a:b], self.place[a:b]] = self.value[a:b]
            left = np.maximum(left - (matrix**2).sum(axis=0), 0) if b < self.cuts[-1] else np.zeros(len(self.rows))
            yield matrix, np.sqrt(left)

    def scores(self, queries: np.ndarray, q: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a query and a row; beyond a long the greatest or least one."""
        top = self.greatest * int(np.abs(queries).max(initial=0)) * max(1, self.dims)
        if top < 1 << 53:
            return np.einsum("ij,ij->i", queries[q].astype(np.float64), self.whole[place].astype(np.float64)).astype(np.int64)
        if top <= _LONG:
            return np.einsum("ij,ij->i", queries[q], self.whole[place])
        exact = (queries[q].astype(object) * self.whole[place].astype(object)).sum(axis=1)
        return np.array([min(max(v, -_LONG - 1), _LONG) for v in exact.tolist()], dtype=np.int64)


def search_block(block: Block, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row place, score) of each query's k best rows of the block other than its ``own`` row; ties as the module says."""
    n = len(block.rows)
    flat = queries.astype(np.float64)
    reach = np.sqrt((flat**2).sum(axis=1))[:, None]
    at = {r: i for i, r in enumerate(block.rows.tolist())}
    mine = np.array([at.get(r, -1) for r in own.tolist()])
    here = np.flatnonzero(mine >= 0)
    score, rest = np.zeros((len(queries), n)), np.sqrt((block.whole.astype(np.float64) ** 2).sum(axis=1))
    whole, kept = float((rest**2).sum()), min(k, n)
    slack = 1e-9 * reach * max(1.0, float(rest.max(initial=0)))  # far above what rounding can add up to
    possible = np.ones((len(queries), n), dtype=bool)
    for matrix, rest in block.impacts():
        score += flat @ matrix
        if (rest**2).sum() > whole / 8:
            continue  # too much is open for a proof
        open_ = reach * rest + slack
        least = score - open_
        least[here, mine[here]] = -np.inf
        bound = np.partition(least, n - kept, axis=1)[:, n - kept, None]
        possible = score + open_ >= bound
        if possible.sum() * STOP_SHARE <= possible.size:
            break
    possible[here, mine[here]] = False
    q, place = np.nonzero(possible)
    exact = block.scores(queries, q, place)
    order = np.lexsort((block.rows[place], block.ids[place], block.unnamed[place], -exact, q))
    q, place, exact = q[order], place[order], exact[order]
    first = np.searchsorted(q, q)  # where each query's rows begin
    best = np.arange(len(q)) - first < k
    return q[best], place[best], exact[best]


def _aligned(flat: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    """Vectors as rows of ``dims`` entries; missing ones are 0, further ones meet only zeros."""
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    dim = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[dim < dims], dim[dim < dims]] = flat[dim < dims]
    return out


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], index: pa.Table, asked: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, ...]] = []
        if index.num_rows and asked.num_rows:
            block = Block(index)
            flat, sizes = _flat(asked.column("x"))
            queries = _aligned(flat, sizes, block.dims)
            number, name = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
            for a in range(0, len(queries), SUB_ROWS):
                q, place, score = search_block(block, queries[a : a + SUB_ROWS], number[a : a + SUB_ROWS], k)
                parts.append((number[a + q], name[a + q], block.rows[place], block.ids[place], block.unnamed[place], score))
        query, query_id, row, vec_id, unnamed, score = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, dtype=np.int64)] * 6
        columns = [pa.array(query), pa.array(query_id), pa.array(row), pa.array(vec_id, mask=unnamed.astype(bool)), pa.array(score)]
        return pa.Table.from_arrays([c.cast(pa.int64()) for c in columns], names=["query", "query_id", "row", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, column: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose vec_id is divisible by ``every``, the ``k`` rows of greatest inner product."""
    rows = prepared(vectors, column, scale)
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(4 * cores, n // 512))  # small tables are cut finer, so that all cores have work
    sets = max(1, -(-m // query_rows))
    index = cut_lineage(build_index(rows, blocks), "search-index")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = cut_lineage(top.select("query_id", "rank", "vec_id", "score"), "search-result")
    drop(rows, index)
    return out
