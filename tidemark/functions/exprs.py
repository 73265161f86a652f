"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(float(low))), F.lit(float(high)))


def flag(cond: Column, kind: str = "int") -> Column:
    """1 where ``cond`` holds, otherwise 0 (a null condition counts as 0)."""
    one, zero = F.lit(1).cast(kind), F.lit(0).cast(kind)
    return F.when(cond, one).otherwise(zero)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_where(cond: Column, value) -> Column:
    """Conditional sum that is 0 on an empty group."""
    return F.coalesce(F.sum(F.when(cond, col(value))), F.lit(0)).cast("double")


def ratio(num, den, eps: float) -> Column:
    return col(num) / (col(den) + F.lit(eps))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def logit(p, eps: float) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def log_amount(x) -> Column:
    """``log1p`` of an amount floored at zero."""
    return F.log1p(F.greatest(col(x).cast("double"), F.lit(0.0)))


def nearest_quantile(values: Column, q: float) -> Column:
    """Nearest-rank quantile of an ascending array."""
    pos = F.round((F.size(values) - 1) * F.lit(q)).cast("int")
    return F.when(F.size(values) > 0, F.get(values, pos))


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def ln_rising(base, count) -> Column:
    """``ln(base) + ln(base + 1) + ... `` over ``count`` terms, the logarithm of
    a ratio of gamma functions when ``count`` is a whole number."""
    steps = F.slice(F.sequence(F.lit(0), col(count).cast("int")), 1, col(count).cast("int"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.log(col(base) + k))
