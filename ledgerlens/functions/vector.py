"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine distance; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(v: Column) -> Column:
    """v divided by its length; null where that is zero."""
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm(v)))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
