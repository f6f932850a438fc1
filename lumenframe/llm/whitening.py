"""Operator 11: embedding whitening by digit-slice GEMM.

Entries become integers, ``x = floor(scale * c) + offset``, and each distinct
vector of integers counts once (the *fit list*: n vectors, per-dimension sums
S).  Nothing is rounded before the eigendecomposition:

* the first pass adds up S;
* the second centres every vector at the whole part of the mean, cuts the
  entries into limbs of LIMB_BITS bits, and multiplies limb by limb in float64.
  A block has so few rows that every sum stays below 2**53, so BLAS is exact.
  The products, shifted to their places, are added as big integers;
* tasks send sums as digits of DIGIT_BITS bits, which Spark adds up as longs.

The driver, which sees ``d * (d + 1) / 2`` sums for vectors of d entries and no
vector, takes the fraction of the mean out: ``n**3 * V`` is an integer matrix.
Its eigenvectors come from LAPACK and are then corrected: the matrix in their
basis is again taken exactly, and rotated (Jacobi) until every entry beside the
diagonal is below 1e-13 of the geometric mean of its two diagonal entries.  So
eigenvalues that are many orders of magnitude smaller than the greatest keep
their digits.  The number of components without variance is the rank of the
integer matrix, not a threshold.

Vectors that are null or hold a null or non-finite entry are left out.  Vectors
of each length are a space of their own, with their own n and components; empty
vectors have no components.  A component without variance has a null
``whitened`` and explains 0 (null if nothing varies).  Scaled entries beyond
2**61 count as 2**61.  Repeated rows each get their rows; an empty table gives
none; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.storage import cut_lineage, drop

LIMB_BITS = 20
BLOCK_ROWS = 1 << 14  # 2**14 products below 2**38 add up to less than 2**53
DIGIT_BITS = 30
_LARGEST = float(1 << 61)
_PRIMES = (2147483647, 2147483629)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def integers(vector: Column, scale: int, offset: int = 0) -> Column:
    """``floor(scale * c) + offset`` of each entry, taken as double."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_LARGEST)), F.lit(-_LARGEST))) + offset)


def limbs(a: np.ndarray) -> list[np.ndarray]:
    """Integers as float64 limbs, least first, each between -2**19 and 2**19; ``a``: int64 or Python integers."""
    half, out = 1 << (LIMB_BITS - 1), []
    while True:
        low = ((a + half) & ((1 << LIMB_BITS) - 1)) - half
        out.append(low.astype(np.float64))
        a = (a - low) >> LIMB_BITS
        if not a.any():
            return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product of integer matrices as Python integers, exact; one BLAS product for each pair of limbs and block."""
    total = np.zeros((a.shape[0], b.shape[1]), dtype=object)
    for at in range(0, a.shape[1], BLOCK_ROWS):
        left, right = limbs(a[:, at : at + BLOCK_ROWS]), limbs(b[at : at + BLOCK_ROWS])
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                total += (x @ y).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total


def _digits(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, digit, value) of each integer that is not 0."""
    mask, most = (1 << DIGIT_BITS) - 1, 1 << DIGIT_BITS
    for place, v in enumerate(values):
        k = 0
        while not -most <= v < most:
            yield place, k, v & mask
            v >>= DIGIT_BITS
            k += 1
        if v:
            yield place, k, v


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, int64 matrix) of the vectors of each length but 0."""
    size = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, flat[start[at][:, None] + np.arange(d)]


_SUMS = "size int, place int, digit int, value long"


def _adding(one):
    """A pass that adds up ``one(length, matrix)`` (a list of integers) for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column("x")):
                total[d] = total.get(d, 0) + one(d, x)
        for d, values in total.items():
            rows = list(_digits(values.tolist()))
            columns = [pa.array([d] * len(rows), pa.int32())] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "place", "digit", "value"])

    return run


def _added(fit: DataFrame, one) -> dict[int, dict[int, int]]:
    """length -> place -> sum over the fit list."""
    sums = fit.mapInArrow(_adding(one), _SUMS).groupBy("size", "place", "digit").agg(F.sum("value").alias("value")).toArrow()
    out: dict[int, dict[int, int]] = {}
    for d, place, digit, value in zip(*(sums.column(c).to_pylist() for c in ("size", "place", "digit", "value"))):
        own = out.setdefault(d, {})
        own[place] = own.get(place, 0) + (value << (DIGIT_BITS * digit))
    return out


def _count_and_sums(d: int, x: np.ndarray) -> np.ndarray:
    high = x >> 31
    low = x - (high << 31)
    sums = (high.sum(axis=0).astype(object) << 31) + low.sum(axis=0).astype(object)
    return np.concatenate((np.array([len(x)], dtype=object), sums))


def _upper_products(centers: dict[int, np.ndarray]):
    def one(d: int, x: np.ndarray) -> np.ndarray:
        z = x - centers[d]
        return product(z.T, z)[np.triu_indices(d)]

    return one


def rank(matrix: np.ndarray) -> int:
    """Rank of a matrix of Python integers, by elimination modulo two primes (each can only find too few)."""
    best = 0
    for p in _PRIMES:
        m = (matrix % p).astype(np.int64)
        row = 0
        for column in range(m.shape[1]):
            some = np.flatnonzero(m[row:, column])
            if not len(some):
                continue
            m[[row, row + some[0]]] = m[[row + some[0], row]]
            m[row] = m[row] * pow(int(m[row, column]), -1, p) % p
            m[row + 1 :] = (m[row + 1 :] - m[row + 1 :, column][:, None] * m[row] % p) % p
            row += 1
            if row == len(m):
                break
        best = max(best, row)
    return best


def _rotated(b: np.ndarray, most: float = 1e-15, sweeps: int = 30) -> np.ndarray:
    """Orthogonal matrix that diagonalises the positive matrix ``b``; rotations of disjoint pairs at once."""
    d = len(b)
    b, q = b.copy(), np.eye(d)
    seats = list(range(d)) + [-1] * (d % 2)
    for _ in range(sweeps):
        moved = False
        for _ in range(len(seats) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]) if min(x, y) >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            i, j = (np.array(side) for side in zip(*pairs))
            need = np.abs(b[i, j]) > most * np.sqrt(np.abs(b[i, i] * b[j, j]))
            if not need.any():
                continue
            moved, i, j = True, i[need], j[need]
            tau = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            for m in (b, q):
                m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            b[i], b[j] = c[:, None] * b[i] - s[:, None] * b[j], s[:, None] * b[i] + c[:, None] * b[j]
        if not moved:
            break
    return q


def principal(g: np.ndarray, denominator: int, varied: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), eigenvectors and scaled off-diagonals of ``g / denominator``, ``g`` of Python integers.

    The third result is the matrix in the eigenvectors' basis, each entry over
    the geometric mean of its diagonal entries: the identity, if all is exact.
    ``varied`` is the rank of ``g``; components beyond it aren't corrected.
    """
    v = np.array([[x / denominator for x in row] for row in g.tolist()])
    q = np.linalg.eigh(v)[1][:, ::-1]
    for turn in range(rounds):
        scale = np.rint(q * (1 << 52)).astype(np.int64)
        b = product(scale.T, product(g, scale))
        norms = [sum(x * x for x in column) for column in scale.T.tolist()]
        values = np.array([max(0, x) / (n * denominator) for x, n in zip(b.diagonal().tolist(), norms)])
        unit = 1 << 104
        plain = np.array([[x / (unit * denominator) for x in row] for row in b.tolist()])
        root = np.sqrt(np.maximum(plain.diagonal(), 0))
        scaled = np.divide(plain, np.outer(root, root), out=np.zeros_like(plain), where=np.outer(root, root) > 0)
        beside = np.abs(scaled - np.diag(scaled.diagonal()))[:varied, :varied].max(initial=0)
        if beside <= 1e-13 or turn == rounds - 1:
            break
        q = q @ _rotated(plain)
        q = q / np.linalg.norm(q, axis=0)
        order = np.argsort(-np.einsum("ij,ij->j", q, v @ q), kind="stable")
        q = q[:, order]
    order = np.argsort(-values, kind="stable")
    q, values, scaled = q[:, order], values[order], scaled[np.ix_(order, order)]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(len(q))] < 0, -1.0, 1.0)
    return values, q, scaled


@dataclass
class Whitening:
    """What is fitted for the vectors of one length."""

    n: int
    sums: list[int]
    center: np.ndarray
    rest: list[int]  # sums less n times center: n times the fraction of the mean
    vectors: np.ndarray  # components as columns, over the root of their eigenvalue
    explained: list[float | None]
    identity_error: float | None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return z @ self.vectors

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n * x - S)**2`` of each row, exact."""
        z = x - self.center
        greatest = int(np.abs(z).max(initial=0))
        if len(self.center) * (self.n * (greatest + 1)) ** 2 < 1 << 63:
            y = z * self.n - np.array(self.rest, dtype=np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        squares = (np.einsum("ij,ij->i", z, z) if len(self.center) * greatest**2 < 1 << 63 else (z.astype(object) ** 2).sum(axis=1)).tolist()
        crossed = product(z, np.array(self.rest, dtype=object)[:, None])[:, 0].tolist()
        fixed = sum(r * r for r in self.rest)
        return [self.n * self.n * s - 2 * self.n * c + fixed for s, c in zip(squares, crossed)]


def fit(x: DataFrame, top: int = 16) -> dict[int, Whitening]:
    """Length -> its whitening, from ``x`` (array of longs); every distinct vector counts once."""
    distinct = cut_lineage(x.select("x").distinct(), "whitening-fit")
    counted = _added(distinct, _count_and_sums)
    sums = {d: [own.get(i + 1, 0) for i in range(d)] for d, own in counted.items()}
    centers = {d: np.array([s // counted[d][0] for s in own], dtype=np.int64) for d, own in sums.items()}
    products = _added(distinct, _upper_products(centers)) if sums else {}
    drop(distinct)
    out = {}
    for d, own in sums.items():
        n = counted[d][0]
        rest = [s - n * c for s, c in zip(own, centers[d].tolist())]
        g = np.zeros((d, d), dtype=object)
        for place, (i, j) in enumerate(zip(*(k.tolist() for k in np.triu_indices(d)))):
            g[i, j] = g[j, i] = n * (n * products.get(d, {}).get(place, 0) - rest[i] * rest[j])
        varied, trace = rank(g), sum(g.diagonal().tolist())
        k = min(top, d)
        vectors, explained, error = np.full((d, k), np.nan), [0.0 if trace else None] * k, None
        if varied:
            values, q, scaled = principal(g, n**3, varied)
            some = min(k, varied)
            vectors[:, :some] = q[:, :some] / np.sqrt(values[:some])
            explained[:some] = [float(v / (trace / n**3)) for v in values[:some]]
            # W'VW - 1, with W'VW taken from the exact matrix
            error = float(np.abs(scaled[:some, :some] - np.eye(some)).max())
        out[d] = Whitening(n, own, centers[d], rest, vectors, explained, error)
    return out


def _apply(found: dict[int, Whitening], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch.column("x")):
                own, places = found[d], pa.array(at)
                w = own.whitened(x)
                told = [v if abs(v) < 10**38 else None for v in own.deviations(x)]
                k = w.shape[1]
                flat = pa.array(w.reshape(-1), from_pandas=True)  # no number is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * k, pa.int32()), flat)
                same = lambda v, t: pa.array([v] * len(at), t)  # noqa: B023, E731
                columns = [batch.column(c).take(places) for c in names]
                columns += [same(own.n, pa.int64()), pa.array(told, pa.decimal128(38, 0)), lists, same(own.explained, pa.list_(pa.float64())), same(own.identity_error, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"o{i}" for i in range(len(columns))])

    return run


def whiten(vectors: DataFrame, column: str = "embedding", keep: list[str] | None = None, scale: int = 64, offset: int = 1_000_000, top: int = 16) -> DataFrame:
    """One row for each usable vector: the columns ``keep`` (``vec_id``), ``n``, ``deviation`` (decimal; null beyond 38 digits),
    ``whitened`` and ``explained`` (arrays, a place for each of up to ``top`` components) and ``identity_error``.

    ``identity_error`` is the greatest entry of W'VW - 1 over the components
    with variance, W being the matrix that whitens, V the exact covariance.
    """
    keep = ["vec_id"] if keep is None else keep
    vector = F.col(column)
    rows = vectors.where(usable(vector)).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], integers(vector, scale, offset).alias("x"))
    found = fit(rows, top)
    fields = [T.StructField(f"o{i}", vectors.schema[c].dataType) for i, c in enumerate(keep)]
    made = {"n": T.LongType(), "deviation": T.DecimalType(38, 0), "whitened": T.ArrayType(T.DoubleType()), "explained": T.ArrayType(T.DoubleType()), "identity_error": T.DoubleType()}
    fields += [T.StructField(f"o{len(keep) + i}", t) for i, t in enumerate(made.values())]
    return rows.mapInArrow(_apply(found, [f"c{i}" for i in range(len(keep))]), T.StructType(fields)).toDF(*keep, *made)


def whitened_components(vectors: DataFrame, **options) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = whiten(vectors, **options)
    each = rows.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "x.whitened", "x.explained", "identity_error")
