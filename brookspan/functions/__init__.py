"""Scalar and aggregate functions with streaming-SQL semantics, all as column expressions."""

from brookspan.functions.aggregates import AGGREGATES, agg, avg, count, count_distinct, last_value, max_, min_, sum_
from brookspan.functions.scalar import (
    char_length, coalesce, count_char, date_format, divide, hash_code, hour, json_query, json_value, lower, mod, proctime,
    regex_extract, register, split_index, to_timestamp_ltz, window_rowtime,
)

__all__ = [
    "AGGREGATES", "agg", "avg", "char_length", "coalesce", "count", "count_char", "count_distinct", "date_format", "divide", "hash_code", "hour",
    "json_query", "json_value", "last_value", "lower", "max_", "min_", "mod", "proctime", "regex_extract", "register", "split_index", "sum_",
    "to_timestamp_ltz", "window_rowtime",
]
