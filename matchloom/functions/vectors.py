"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length: nulls lose every comparison, NaN would win it."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def unit(a: Column, keep_zero: bool = True) -> Column:
    """The vector at length 1. A vector without length stays as it is, or is null if not keep_zero."""
    n = norm(a)
    scaled = F.transform(a, lambda x: x.cast("double") / n)
    return F.when(n > 0, scaled).otherwise(F.transform(a, lambda x: x.cast("double")) if keep_zero else F.lit(None))
