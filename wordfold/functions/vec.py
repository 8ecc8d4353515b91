"""Dense-vector expressions on ``array<double>`` columns (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """<a, b>; arrays of equal length. Null if either side is null."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def normalize(a) -> Column:
    """Unit L2 length; a zero vector stays zero (no NaN)."""
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x / n)).otherwise(F.transform(_c(a), lambda x: x * 0.0))


def to_double_array(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("double"))


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)
