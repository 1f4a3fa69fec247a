"""Vector arithmetic on arrays as Column expressions, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """cosine; ip (the raw product); l2: 1 / (1 + squared distance)."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    if metric == "l2":
        d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + d)
    raise ValueError(f"no such metric: {metric}")


def sound(a: Column, dim: int) -> Column:
    """Not null, of the right dimension, all components finite."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
