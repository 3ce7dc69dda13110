"""SQL type names of streaming plans as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(),
    "BOOLEAN": T.BooleanType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "CHAR": T.StringType(), "VARCHAR": T.StringType(),
    "STRING": T.StringType(), "BINARY": T.BinaryType(), "BYTES": T.BinaryType(), "VARBINARY": T.BinaryType(), "DATE": T.DateType(),
    "TIME": T.LongType(), "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_LTZ": T.TimestampType(), "TIMESTAMP_WITH_LOCAL_TIME_ZONE": T.TimestampType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "TIMESTAMP WITH LOCAL TIME ZONE": T.TimestampType(), "TIMESTAMP WITHOUT TIME ZONE": T.TimestampNTZType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name such as `DECIMAL(38, 2) NOT NULL` or `TIMESTAMP(3) *ROWTIME*`.

    TIME is milliseconds of the day.  A name that is not known is an error.
    """
    text = re.sub(r"\*\w+\*|NOT NULL\s*$", "", name.strip().upper()).strip()
    if found := re.fullmatch(r"(?:DECIMAL|NUMERIC|DEC)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text):
        return T.DecimalType(int(found[1] or 10), int(found[2] or 0))
    if found := re.fullmatch(r"ARRAY\s*<(.*)>", text):
        return T.ArrayType(spark_type(found[1]))
    if found := re.fullmatch(r"MULTISET\s*<(.*)>", text):
        return T.MapType(spark_type(found[1]), T.IntegerType())
    if found := re.fullmatch(r"MAP\s*<(.*)>", text):
        key, value = _split(found[1])
        return T.MapType(spark_type(key), spark_type(value))
    if found := re.fullmatch(r"ROW\s*[<(](.*)[>)]", text):
        fields = [part.split(None, 1) for part in _split(found[1])]
        return T.StructType([T.StructField(n.strip("`").lower(), spark_type(t)) for n, t in fields])
    if text.startswith("INTERVAL"):
        return T.YearMonthIntervalType() if re.search("YEAR|MONTH", text) else T.DayTimeIntervalType()
    plain = re.sub(r"\s*\(\s*\d+\s*\)", "", text)
    if plain not in _PLAIN:
        raise ValueError(f"unknown type {name!r}")
    return _PLAIN[plain]


def _split(text: str) -> list[str]:
    """Parts between commas that are in no bracket."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(text[last:i].strip())
            last = i + 1
    return [*parts, text[last:].strip()]


def schema(fields: dict[str, str]) -> T.StructType:
    """A schema of column names and type names; `NOT NULL` makes a column not nullable."""
    return T.StructType([T.StructField(n, spark_type(t), not t.strip().upper().endswith("NOT NULL")) for n, t in fields.items()])
