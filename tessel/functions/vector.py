"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """-1 for a null, empty or zero vector, or where the lengths differ."""
    a, b = col(a), col(b)
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = norm(a) * norm(b)
    return F.when(fit, F.when(length > 0, dot(a, b) / length).otherwise(-1.0)).otherwise(-1.0)


def constant(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
