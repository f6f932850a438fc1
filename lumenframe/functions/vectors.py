"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = vec_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def vec_l2sq(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - vec_dot(a, b) / (vec_norm(a) * vec_norm(b))


def patches(a: Column, width: int = 8) -> Column:
    """A vector seen as rows of ``width``, each of unit length."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1), lambda i: F.slice(a, i * width + 1, width))
    return F.transform(rows, vec_normalize)


def chamfer(a: Column, b: Column) -> Column:
    """Symmetric Chamfer similarity of two patch sets: mean best match of each side's rows, averaged."""
    one = lambda p, q: F.aggregate(F.transform(p, lambda x: F.array_max(F.transform(q, lambda y: vec_dot(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(p)
    return (one(a, b) + one(b, a)) / 2


def topk_patches(p: Column, k: int) -> Column:
    """The ``k`` rows of greatest length."""
    ranked = F.array_sort(F.transform(p, lambda x: F.struct((-vec_norm(x)).alias("n"), x.alias("x"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["x"])
