"""Dense-vector column expressions over ``ARRAY<FLOAT|DOUBLE>`` columns.

Built-in higher-order functions only (Spark has no cosine built-in); every
element is widened to double before arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a, b) -> Column:
    """Row-wise cosine; a zero vector gives 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def normalize_vec(a) -> Column:
    """L2-normalised copy (a zero vector stays zero)."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def to_double(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))
