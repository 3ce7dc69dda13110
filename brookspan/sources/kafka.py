"""Kafka topics of JSON or plain text; the connector is a package of its own that the cluster provides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_source(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType | None = None, starting: str = "earliest", ending: str | None = None,
    per_trigger: int | None = None, properties: dict[str, str] | None = None,
) -> DataFrame:
    """A stream of a topic, or with `ending` a bounded table.  schema None: the value as text, else JSON rows."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    options |= {f"kafka.{k}": v for k, v in (properties or {}).items()}
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    reader = spark.read if ending else spark.readStream
    if ending:
        options["endingOffsets"] = ending
    rows = reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
    return rows if schema is None else json_rows(rows, schema)


def json_rows(df: DataFrame, schema: T.StructType, value: str = "value", malformed: str = "fail") -> DataFrame:
    """Columns from a text column of JSON; missing fields and JSON nulls are null, malformed text fails or is null."""
    mode = {"fail": "FAILFAST", "null": "PERMISSIVE"}[malformed]
    return df.select(F.from_json(value, schema, {"mode": mode}).alias("_row")).select("_row.*")


def to_json_value(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON text a row, timestamps as `yyyy-MM-dd HH:mm:ss.SSS` without trailing zeros."""

    def shown(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.regexp_replace(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSS"), r"\.000$|(?<=\.[0-9]{1,2})0+$", "").alias(f.name)
        return F.col(f.name)

    fields = [f for f in df.schema if f.name != key]
    value = F.to_json(F.struct(*map(shown, fields)), {"ignoreNullFields": "false"}).alias("value")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, guarantee: str = "at-least-once", properties: dict[str, str] | None = None):
    """Writes rows as JSON.  Guarantees: `none` and `at-least-once`; Spark's sink offers no more."""
    if guarantee not in ("none", "at-least-once"):
        raise ValueError("Kafka gets rows at least once")
    options = {"kafka.bootstrap.servers": servers, "topic": topic} | {f"kafka.{k}": v for k, v in (properties or {}).items()}
    rows = to_json_value(df)
    if not df.isStreaming:
        rows.write.format("kafka").options(**options).save()
        return None
    return rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
