"""Aggregates, with a filter and, for retracting inputs, a weight of +1 or -1 for each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookspan.functions.scalar import _column, divide


def _kept(x: Column, where: Column | None) -> Column:
    return x if where is None else F.when(where, x)


def count(x=None, where: Column | None = None, weight: Column | None = None) -> Column:
    """Rows (x None) or values that are not null."""
    one = _kept(F.lit(1) if x is None else F.when(_column(x).isNotNull(), 1), where)
    return F.count(one) if weight is None else F.coalesce(F.sum(one * weight), F.lit(0)).cast("bigint")


def sum_(x, where: Column | None = None, weight: Column | None = None) -> Column:
    """Sum; null when nothing was added, or all of it retracted."""
    value = _kept(_column(x), where)
    if weight is None:
        return F.sum(value)
    return F.when(F.sum(F.when(value.isNotNull(), weight)) > 0, F.sum(value * weight))


def avg(x, where: Column | None = None, weight: Column | None = None) -> Column:
    """Average of integers, cut towards zero; null when empty."""
    n = count(x, where, weight)
    return divide(sum_(x, where, weight), F.when(n > 0, n))


def min_(x, where: Column | None = None, weight: Column | None = None) -> Column:
    """Smallest value; with weights the rows must be netted first, see `changelog.netted`."""
    return F.min(_kept(_column(x), where))


def max_(x, where: Column | None = None, weight: Column | None = None) -> Column:
    return F.max(_kept(_column(x), where))


def count_distinct(x, where: Column | None = None, weight: Column | None = None) -> Column:
    return F.count_distinct(_kept(_column(x), where))


def last_value(x, seq, where: Column | None = None, weight: Column | None = None) -> Column:
    """The last value by `seq` that is not null."""
    value = _kept(_column(x), where)
    return F.max_by(value, F.when(value.isNotNull(), _column(seq)))


AGGREGATES = {"COUNT": count, "SUM": sum_, "AVG": avg, "MIN": min_, "MAX": max_, "COUNT_DISTINCT": count_distinct, "LAST_VALUE": last_value}


def agg(name: str, *arguments, where: Column | None = None, weight: Column | None = None) -> Column:
    """An aggregate by its name, such as SUM or COUNT_DISTINCT."""
    if name.upper() not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    return AGGREGATES[name.upper()](*arguments, where=where, weight=weight)
