"""Vector arithmetic on array columns, accumulated in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal query vector."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str, eps: float = 0.0) -> Column:
    """To unit length; with eps, lengths below it count as eps, without, a zero vector becomes null."""
    n = F.greatest(norm(a), F.lit(eps)) if eps else norm(a)
    a = F.col(a) if isinstance(a, str) else a
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def mean_vector(vec: str, dims: int) -> Column:
    """Aggregate: the element-wise mean of vectors of ``dims`` elements."""
    return F.array(*[F.avg(F.get(vec, F.lit(i)).cast("double")) for i in range(dims)])


def to_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)
