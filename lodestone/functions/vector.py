"""Vectors as arrays, compared with higher-order functions inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, otherwise: float = -1.0) -> Column:
    """Cosine similarity; ``otherwise`` where a vector is empty, null, of another length, or zero."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fits, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(otherwise))


def cosine_to(a: Column, query: list[float], otherwise: float = -1.0) -> Column:
    """Cosine similarity to a query that is at hand, whose length is taken once; ``otherwise`` where it has a number that is not finite."""
    if not all(map(math.isfinite, query)):
        return F.lit(otherwise)
    target = F.expr(f"array({', '.join(f'{float(x)!r}D' for x in query)})")
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    fits = (F.size(a) == len(query)) & (norm(a) > 0) & F.lit(len(query) > 0 and length > 0)
    return F.when(fits, dot(a, target) / (norm(a) * length)).otherwise(F.lit(otherwise))


def is_valid(a: Column, dimension: int) -> Column:
    """Of the dimension, with finite numbers only."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimension) & finite, F.lit(False))
