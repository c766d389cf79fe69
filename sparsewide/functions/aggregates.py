"""Aggregates whose results differ from Spark's own: fixed, truncated scales and values with their counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(x: Column, digits: int) -> Column:
    """Cut towards zero after `digits` decimals."""
    return F.signum(x) * F.floor(F.abs(x) * 10**digits) / 10**digits


def avg4(x: Column, scale: int = 0) -> Column:
    """AVG of an int or decimal(scale) column, cut to 4 decimals; exact, since it divides integers."""
    units = F.sum((x * 10**scale).cast("decimal(38,0)")) * 10 ** (4 - scale)
    return (F.call_function("div", units, F.count(x).cast("decimal(38,0)")) / 10000).cast("decimal(38,4)")


def var6(x: Column) -> Column:
    """Population variance, cut to 6 decimals."""
    return truncated(F.var_pop(x), 6)


def corr6(x: Column, y: Column) -> Column:
    return truncated(F.corr(x, y), 6)


def percentile(field: str, nth: float) -> Column:
    """A value that occurs: the smallest of which at least nth percent are no larger."""
    return F.expr(f"percentile_disc({nth / 100}) WITHIN GROUP (ORDER BY {field})")
