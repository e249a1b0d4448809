"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine with one fixed vector, whose norm is a constant of the plan."""
    fixed = F.array(*[F.lit(float(x)) for x in vector])
    size = sum(float(x) ** 2 for x in vector) ** 0.5
    both = norm(a) * F.lit(size)
    return F.when(both == 0, 0.0).otherwise(dot(a, fixed) / both)


def truncated(a: Column, dim: int) -> Column:
    """The first dim values; null for a shorter vector."""
    return F.when(F.size(a) >= dim, F.slice(a, 1, dim))


def bucket_hash(a: Column, dims: int = 32) -> Column:
    """16 hexadecimal digits that stand for a vector's rounded first values."""
    rounded = F.transform(F.slice(a, 1, dims), lambda x: F.floor(x.cast("double") * 1000 + 0.5).cast("string"))
    return F.substring(F.md5(F.array_join(rounded, ",")), 1, 16)


def mean_vector(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(vectors))
