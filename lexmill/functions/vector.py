"""Vector expressions on array<float> columns, computed in double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def similarity(distance: Column) -> Column:
    """max(0, 1 - d / 2) of a squared distance; for unit vectors the cosine where it is positive."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (array of arrays) whose mask is not 0."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    n = F.greatest(F.size(kept), F.lit(1))
    total = F.aggregate(
        F.slice(kept, 2, 1 << 20),
        F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double")),
        lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")),
    )
    return F.transform(total, lambda x: (x / n).cast("float"))
