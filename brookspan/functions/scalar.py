"""Scalar functions; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def divide(a, b) -> Column:
    """Integer division towards zero; null where the divisor is null."""
    return F.call_function("div", _column(a), _column(b))


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend."""
    return _column(a) % _column(b)


def lower(s) -> Column:
    return F.lower(_column(s))


def char_length(s) -> Column:
    """Code points, trailing blanks included."""
    return F.char_length(_column(s))


def coalesce(*columns) -> Column:
    return F.coalesce(*map(_column, columns))


def split_index(s, delimiter: str, index: int) -> Column:
    """The part of that number (from 0) between literal delimiters; null when there is none."""
    if index < 0:
        return F.lit(None).cast("string")
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.try_element_at(F.split(_column(s), quoted), F.lit(index + 1))


def count_char(s, character: str) -> Column:
    """How often a character occurs."""
    s = _column(s)
    return (F.char_length(s) - F.char_length(F.replace(s, F.lit(character), F.lit("")))).cast("bigint")


def date_format(ts, pattern: str) -> Column:
    return F.date_format(_column(ts), pattern)


def hour(ts) -> Column:
    return F.hour(_column(ts)).cast("bigint")


def regex_extract(s, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null when nothing matches."""
    s = _column(s)
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def json_value(s, path: str) -> Column:
    """The scalar at a path as text; null for objects, arrays and nothing."""
    found = F.get_json_object(_column(s), path)
    return F.when(~_nested(_column(s), path), found)


def json_query(s, path: str) -> Column:
    """The object or array at a path as JSON text; null for scalars and nothing."""
    found = F.get_json_object(_column(s), path)
    return F.when(_nested(_column(s), path), found)


def _nested(s: Column, path: str) -> Column:
    """Whether an object or array, and not a text that looks like one, is at the path."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(s), path, "variant"))
    return F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))


def to_timestamp_ltz(n, precision: int = 0) -> Column:
    """An instant from seconds (0) or milliseconds (3) of the epoch."""
    if precision not in (0, 3):
        raise ValueError("the precision is 0 or 3")
    return F.timestamp_seconds(_column(n)) if precision == 0 else F.timestamp_millis(_column(n))


def proctime() -> Column:
    """Wall clock, one value for a batch or micro-batch, in whole milliseconds."""
    return F.date_trunc("millisecond", F.current_timestamp())


def window_rowtime(end) -> Column:
    """The row time of a window: a millisecond before its end."""
    return _column(end) - F.expr("INTERVAL '0.001' SECOND")


def hash_code(*columns) -> Column:
    """A 32-bit Murmur 3 hash, for dealing rows into buckets."""
    return F.hash(*map(_column, columns))


def register(spark: SparkSession, name: str, function, returns: str = "string", vectorised: bool = True) -> None:
    """Makes a Python function callable in SQL: over pandas series, or row by row."""
    made = F.pandas_udf(function, returns) if vectorised else F.udf(function, returns)
    spark.udf.register(name, made)
