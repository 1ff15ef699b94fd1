"""Vector functions over array columns, in doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; NaN components for a zero vector."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size != 0, x.cast("double") / F.nullif(size, F.lit(0.0))).otherwise(float("nan")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; NaN if either vector is zero, null if either is null or their lengths differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), None).when(size == 0, float("nan")).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))
