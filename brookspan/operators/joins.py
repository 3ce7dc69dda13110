"""Regular, window and lookup joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, IntegralType, StringType, TimestampNTZType, TimestampType

KINDS = {"inner", "left", "right", "full", "left_semi", "left_anti"}
#: A lookup table is broadcast up to this size as the planner estimates it; beyond that the planner chooses.
LOOKUP_BYTES = 64 << 20
#: A side up to this size that meets a broadcast table is dealt over the whole cluster first, so many tasks a core.
SPREAD_BYTES, SPREAD_TASKS = 64 << 20, 4
#: Most rows in a block of a small side and in one of a broadcast table with repeated keys: a page of a Parquet file, 20,000 rows,
#: has the first many times, and the pairs of two blocks are held at once.
BLOCK_ROWS, TABLE_ROWS = 252, 64
#: Types, with plain strings, of which equal values are the same; a double's zeros are not.
SAME = (IntegralType, BooleanType, DateType, TimestampType, TimestampNTZType, BinaryType)


def join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", condition: Column | None = None, null_safe: bool = False,
    many_pairs: bool = False,
) -> DataFrame:
    """Joins on pairs of columns and a further condition; null keys match nothing unless `null_safe`.

    Columns of the two sides have different names.  A key with many rows on both sides gives all their pairs; a small table
    has one file split or few, so where the other side is broadcast its rows are dealt evenly first, whatever their keys.
    `many_pairs`: keys repeat on both sides, so where one is broadcast, the rows of a key meet in blocks, which makes a pair
    cheaper, on disk too; name the result's columns by strings then.
    """
    if how not in KINDS:
        raise ValueError(f"unknown join {how!r}")
    flow = _flow(left, right, how)
    if flow is not None:
        tasks = SPREAD_TASKS * left.sparkSession.sparkContext.defaultParallelism
        left, right = (left, right.repartition(tasks)) if flow else (left.repartition(tasks), right)
        if many_pairs and keys and condition is None and how in ("inner", "left", "right"):
            sides = (right, left, [(b, a) for a, b in keys]) if flow else (left, right, keys)
            return _gathered(*sides, how != "inner", null_safe, tasks).select(*map(_quoted, left.columns + right.columns))
    on = reduce(lambda x, y: x & y, [*_equal(left, right, keys, null_safe), *([] if condition is None else [condition])])
    return left.join(right, on, how)


def _equal(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_safe: bool) -> list[Column]:
    return [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in keys]


def _flow(left: DataFrame, right: DataFrame, how: str) -> int | None:
    """Which side's rows go past a broadcast table, 0 or 1, if that side is small too."""
    if how == "full" or left.isStreaming or right.isStreaming:
        return None
    sizes = size_bytes(left), size_bytes(right)
    flow = int(how == "right" or how == "inner" and sizes[0] < sizes[1])
    return None if sizes[flow] > SPREAD_BYTES or sizes[1 - flow] > _broadcast_bytes(left.sparkSession) else flow


def _gathered(rows: DataFrame, table: DataFrame, keys: list[tuple[str, str]], outer: bool, null_safe: bool, tasks: int) -> DataFrame:
    """Every row with the table's rows of its key; blocks of rows of a key meet blocks of the broadcast table, as arrays.

    A hash table with repeated keys is walked entry by entry, an array is read in order.  A block's rows are given again for each
    row of the other block, so in files the table's values are runs and the rows' values come again within a page; pairs in the
    order of the rows repeat nothing that near, and take many times the disk.
    """
    blocks, own, of_row = _blocks(rows, [a for a, _ in keys], BLOCK_ROWS, "__own")
    groups, values, of_key = _blocks(table, [b for _, b in keys], TABLE_ROWS, "__key")
    on = _equal(blocks := blocks.repartition(tasks), groups, [(of_row[a], of_key[b]) for a, b in keys], null_safe)
    joined = blocks.join(F.broadcast(groups), reduce(lambda x, y: x & y, on), "left" if outer else "inner")
    # as many partitions as there are, but a border of generated code, which holds all that one row of its input gives
    joined = joined.coalesce(tasks)
    kept = [F.col(k).alias(c) for named, inside in ((of_row, own), (of_key, values)) for c, k in named.items() if c not in inside]
    pairs = joined.select("__own", *kept, _taken_apart("__key", values, outer))
    return pairs.select(*(_quoted(c) for c in pairs.columns if c != "__own"), _taken_apart("__own", own, False))


def _blocks(df: DataFrame, keys: list[str], most: int, name: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Blocks of up to `most` rows of a key as the array `name`; the columns in there, and the names of the keys beside it.

    Equal keys of the types in `SAME` are the same value, so the array leaves them out.
    """
    kinds, of_key = {f.name: f.dataType for f in df.schema}, {k: f"{name}{i}" for i, k in enumerate(keys)}
    values = [c for c in df.columns if c not in of_key or not (isinstance(kinds[c], SAME) or kinds[c] == StringType())] or df.columns
    listed = F.collect_list(F.struct(*map(_quoted, values)))
    if len(values) == 1:
        listed = F.transform(listed, lambda row: row.getField(values[0]))
    order = dict.fromkeys([*keys, *(c for c in df.columns if not re.search("map<|variant", kinds[c].simpleString()))])
    numbered = df.sortWithinPartitions(*map(_quoted, order)).withColumn("__block", F.floor(F.monotonically_increasing_id() / most))
    grouped = numbered.groupBy(*(_quoted(k).alias(n) for k, n in of_key.items()), "__block").agg(listed.alias(name))
    return grouped.drop("__block"), values, of_key


def _taken_apart(name: str, values: list[str], outer: bool) -> Column:
    """The rows of an array that `_blocks` made."""
    if len(values) == 1:
        return (F.explode_outer if outer else F.explode)(name).alias(values[0])
    return (F.inline_outer if outer else F.inline)(name)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _broadcast_bytes(spark: SparkSession) -> int:
    """Up to which size the planner broadcasts a table by itself; less than 0: never."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def window_join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", condition: Column | None = None,
    windows: tuple[tuple[str, str], ...] = (("window_start", "right_window_start"), ("window_end", "right_window_end")),
) -> DataFrame:
    """Joins rows of one window: equal keys and equal window columns of both sides."""
    return join(left, right, [*keys, *windows], how, condition)


def size_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(stream: DataFrame, table: DataFrame, key: tuple[str, str], how: str = "inner", selected: list[str] | None = None) -> DataFrame:
    """Adds columns of a lookup table by one key; the table is broadcast while its size allows.

    A key that the table has more than once gives a row for each.
    """
    if how not in ("inner", "left"):
        raise ValueError("a lookup join is inner or left")
    if selected is not None:
        table = table.select(*dict.fromkeys([key[1], *selected]))
    if size_bytes(table) <= LOOKUP_BYTES:
        table = F.broadcast(table)
    return join(stream, table, [key], how)
