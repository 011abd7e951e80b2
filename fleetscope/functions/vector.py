"""Vector distance expressions over ``array<float>`` columns (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import ColumnOrName, _c


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(a: ColumnOrName) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.try_divide(x.cast("double"), n))


def euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(metric: str, a: ColumnOrName, b: ColumnOrName) -> Column:
    metric = metric.lower()
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "dot":
        # negative inner product so that smaller is closer for every metric
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric}")
