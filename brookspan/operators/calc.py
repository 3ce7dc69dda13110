"""Projection, filter, expansion and user functions over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calc(df: DataFrame, select: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """Named expressions over the rows that meet a condition; a null condition drops the row."""
    rows = df if where is None else df.where(where)
    return rows.select(*((F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in select.items()))


def expand(df: DataFrame, projections: list[dict[str, Column]]) -> DataFrame:
    """Every row once for each projection, in one pass."""
    names = list(projections[0])
    if any(list(p) != names for p in projections):
        raise ValueError("all projections have the same columns in the same order")
    rows = F.array(*(F.struct(*(p[n].alias(n) for n in names)) for p in projections))
    return df.select(F.explode(rows).alias("_row")).select("_row.*")


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: dict[str, Column], grouping_id: str | None = None) -> DataFrame:
    """Aggregates by each set of keys; keys outside a set are null, `grouping_id` names the bit mask of those."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    columns = [e.alias(n) for n, e in aggregates.items()] + ([F.grouping_id().alias(grouping_id)] if grouping_id else [])
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*columns)


def rollup(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return df.rollup(*keys).agg(*(e.alias(n) for n, e in aggregates.items()))


def cube(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return df.cube(*keys).agg(*(e.alias(n) for n, e in aggregates.items()))


def map_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A function from a pandas frame to one with as many rows, batch by batch."""

    def run(frames):
        for frame in frames:
            out = function(frame)
            if len(out) != len(frame):
                raise ValueError("a map gives one row for each row")
            yield out

    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, function: Callable) -> DataFrame:
    """Rows for which a function from a pandas frame to a boolean series is true."""

    def run(frames):
        for frame in frames:
            yield frame[function(frame).fillna(False).astype(bool)]

    return df.mapInPandas(run, df.schema)


def flat_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A function from a pandas frame to one with any number of rows, batch by batch."""
    return df.mapInPandas(lambda frames: map(function, frames), schema)


def side_split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition, and all others."""
    return df.where(condition), df.where(~F.coalesce(condition, F.lit(False)))
