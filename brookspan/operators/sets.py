"""Set operations and sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def union_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def union_distinct(*tables: DataFrame) -> DataFrame:
    return union_all(*tables).distinct()


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_ else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_ else a.subtract(b)


def sort_limit(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted rows; with a limit each task keeps its own best ones only."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)
