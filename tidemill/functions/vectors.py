"""Vector scalars on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """VEC-01: cosine; 0 if either is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def normalized(v: Column) -> Column:
    """VEC-02: unit vector; zero stays zero."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def mean_vector(v: Column, size: int) -> Column:
    """AGG-14: aggregate; element-wise mean of vectors of a known size, with map-side sums and no list of rows."""
    return F.array(*[F.avg(doubles(v)[k]) for k in range(size)])
