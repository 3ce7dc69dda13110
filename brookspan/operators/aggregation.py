"""Keyed aggregation and running reduction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookspan.operators.changelog import netted, weight


def group_agg(df: DataFrame, keys: list[str], aggregates: dict[str, Column], row_kind: str | None = None) -> DataFrame:
    """Aggregates by key.  With `row_kind` the input is a changelog: it is netted first, so every aggregate, MIN, MAX
    and COUNT DISTINCT included, sees the rows that are left, and groups without rows are gone."""
    rows = df if row_kind is None else netted(df, row_kind)
    columns = [e.alias(n) for n, e in aggregates.items()]
    return rows.groupBy(*keys).agg(*columns) if keys else rows.agg(*columns)


def distinct_counts(df: DataFrame, keys: list[str], values: list[str], wheres: dict[str, Column | None], name: Callable[[str, str], str]) -> DataFrame:
    """For each value column and condition (None: every row) how many different values a key has; the column is named name(condition, value).

    Each value column is grouped once with its key, keeping for every condition
    whether a row meets it; the groups are then counted.  So rows are never
    copied for their conditions, and both steps aggregate before they shuffle.
    """
    out = None
    for value in values:
        met = {c: F.bool_or(F.coalesce(w, F.lit(False))) if w is not None else F.lit(True) for c, w in wheres.items()}
        seen = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"), *(e.alias(f"_met_{c}") for c, e in met.items() if wheres[c] is not None))
        kept = {c: F.col(value).isNotNull() & (F.col(f"_met_{c}") if wheres[c] is not None else F.lit(True)) for c in wheres}
        counts = seen.groupBy(*keys).agg(*(F.count_if(e).alias(name(c, value)) for c, e in kept.items()))
        out = counts if out is None else beside(out, counts, keys)
    return out


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregations by the same keys as one; null keys meet."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, "inner").drop(*(f"_right_{k}" for k in keys))


def weighted_agg(df: DataFrame, keys: list[str], aggregates: dict[str, Column], row_kind: str = "row_kind") -> DataFrame:
    """Aggregates of a changelog without netting: for COUNT, SUM and AVG made with `weight=changelog.weight()`.  One shuffle."""
    alive = F.sum(weight(row_kind)).alias("_alive")
    return df.groupBy(*keys).agg(*(e.alias(n) for n, e in aggregates.items()), alive).where("_alive > 0").drop("_alive")


def running(df: DataFrame, keys: list[str], seq: list[str], reductions: dict[str, Column]) -> DataFrame:
    """Each row with the reduction of its key's rows so far; reductions: aggregates such as F.sum("x")."""
    so_far = Window.partitionBy(*keys).orderBy(*seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *(e.over(so_far).alias(n) for n, e in reductions.items()))


def reduce_running(df: DataFrame, keys: list[str], seq: list[str], function: Callable[[dict, dict], dict]) -> DataFrame:
    """A user reduction by key in the order of `seq`: the first row as it is, then function(so far, row) for each further row.

    Keys are dealt to tasks and streamed in order, so a task holds one state and a batch of rows, however large a key is.
    """

    def run(frames):
        key, state = None, {}
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                own = tuple(row[k] for k in keys)
                state = row if own != key else function(state, row)
                key = own
                out.append(state)
            yield pd.DataFrame(out, columns=frame.columns).astype(frame.dtypes.to_dict())

    return df.repartition(*keys).sortWithinPartitions(*keys, *seq).mapInPandas(run, df.schema)
