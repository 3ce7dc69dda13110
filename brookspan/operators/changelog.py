"""Changelogs: rows with a kind, and what is left after replaying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE = "+I", "-U", "+U", "-D"
KINDS = (INSERT, UPDATE_BEFORE, UPDATE_AFTER, DELETE)


def weight(kind: str = "row_kind") -> Column:
    """+1 for rows that are added, -1 for rows that are taken back."""
    return F.when(F.col(kind).isin(INSERT, UPDATE_AFTER), 1).otherwise(-1)


def netted(df: DataFrame, kind: str = "row_kind") -> DataFrame:
    """The bag of rows that a changelog leaves: each row as often as it was added more than taken back."""
    columns = [c for c in df.columns if c != kind]
    left = df.groupBy(*columns).agg(F.sum(weight(kind)).alias("_left")).where("_left > 0")
    return left.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("_left").cast("int"))).alias("_one")).drop("_one")


def materialize(df: DataFrame, keys: list[str], seq: str, kind: str = "row_kind") -> DataFrame:
    """The table a changelog builds, one row a key: the last change by `seq` counts, unless it takes the row back.

    One hash aggregation by key, with partial results before the shuffle.
    """
    rest = [c for c in df.columns if c not in (*keys, seq, kind)]
    order = F.struct(F.col(seq), weight(kind).alias("w"))  # of two changes at once the one that adds is later
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest, F.col(kind).alias(kind)), order).alias("_last"))
    return last.where(F.col(f"_last.{kind}").isin(INSERT, UPDATE_AFTER)).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest))


def changes(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The changelog of a stream of upserts: +I for a key's first row, then -U of the row before and +U of the new one; equal rows give none."""
    values = [c for c in df.columns if c not in (*keys, seq)]
    before = F.lag(F.struct(*values)).over(Window.partitionBy(*keys).orderBy(seq))
    new, old = F.struct(*values), F.col("_before")
    change = F.when(old.isNull(), F.array(F.struct(F.lit(INSERT).alias("kind"), new.alias("row")))).when(
        old != new, F.array(F.struct(F.lit(UPDATE_BEFORE).alias("kind"), old.alias("row")), F.struct(F.lit(UPDATE_AFTER).alias("kind"), new.alias("row")))
    )
    rows = df.withColumn("_before", before).select(*keys, seq, F.explode(change).alias("_c"))
    return rows.select(*keys, seq, F.col("_c.kind").alias("row_kind"), *(F.col(f"_c.row.{c}").alias(c) for c in values))
