"""Similarity of vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where it isn't defined: a null or zero vector, other lengths, a missing or non-finite value."""
    c = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(c), c)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine similarity as the sentence chunker counts it: 0 where it isn't defined."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def literal_vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
