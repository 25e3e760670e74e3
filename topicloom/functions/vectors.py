"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col
from .tokens import once


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    a = col(a)
    size = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return once(size, lambda s: F.transform(a, lambda x: x.cast("double") / s))
