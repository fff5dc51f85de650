"""Vector arithmetic on array columns, as built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a norm is zero, so that such a pair never wins a maximum."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def unit(a: Column | str) -> Column:
    """The vector at length one; a vector of length zero stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_col(a), lambda x: x / n)).otherwise(_col(a))
