"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(df: DataFrame) -> DataFrame:
    """Each task's rows stay where they are."""
    return df


def rebalance(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows evenly over tasks."""
    return df.repartition(n) if n else df.hint("rebalance")


def rescale(df: DataFrame, n: int) -> DataFrame:
    """Fewer tasks without a shuffle."""
    return df.coalesce(n)


def global_(df: DataFrame) -> DataFrame:
    """One task; only for results known to be small."""
    return df.coalesce(1)


def by_key(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Rows of a key in one task."""
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def salted(df: DataFrame, keys: list[str], salts: int, n: int | None = None) -> DataFrame:
    """Rows of a key over up to `salts` tasks, by a hash of the whole row; adds the column `salt`."""
    rows = df.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return by_key(rows, [*keys, "salt"], n)


def shuffle(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows at random but the same on a rerun."""
    return df.repartition(n, F.xxhash64(F.lit(seed), *df.columns))


def broadcast(df: DataFrame) -> DataFrame:
    """All rows to every task; the caller knows that they are few."""
    return F.broadcast(df)
