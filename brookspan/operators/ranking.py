"""Top-N, top-1 and deduplication by row time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(order: list[tuple[str, bool]], nulls_last: bool = True) -> list[Column]:
    """Sort columns from (name, ascending)."""
    kinds = {(True, True): "asc_nulls_last", (True, False): "asc_nulls_first", (False, True): "desc_nulls_last", (False, False): "desc_nulls_first"}
    return [getattr(F.col(n), kinds[up, nulls_last])() for n, up in order]


def top_n(
    df: DataFrame, keys: list[str], order: list[tuple[str, bool]], end: int | Column, start: int = 1, seq: str | None = None,
    rank: str | None = "rank", nulls_last: bool = True,
) -> DataFrame:
    """Rows `start` to `end` of each key; of ties the earlier by `seq`.  The planner limits each task's rows before the shuffle."""
    if not keys:
        raise ValueError("top_n has partition keys")
    by = [*ordering(order, nulls_last), *([F.col(seq).asc()] if seq else [])]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    rows = df.withColumn("_rank", place).where(F.col("_rank") <= end)
    rows = rows.where(F.col("_rank") >= start) if start > 1 else rows
    return rows.withColumnRenamed("_rank", rank) if rank else rows.drop("_rank")


def top_1(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], seq: str | None = None, nulls_last: bool = True) -> DataFrame:
    """The best row of each key; an equal later row does not replace it."""
    return top_n(df, keys, order, 1, seq=seq, rank=None, nulls_last=nulls_last)


def deduplicate(df: DataFrame, keys: list[str], time: str, keep: str = "first", seq: str | None = None) -> DataFrame:
    """The first or last row of each key by row time; of ties the earlier (first) or later (last) by `seq`.

    A hash aggregation: partial results shrink each task's rows to one a key before the shuffle.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    order = F.struct(time, *([seq] if seq else []))
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return found.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))
