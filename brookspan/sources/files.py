"""CSV sources, file sinks with rolling, and the commit of finished partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookspan.operators.windows import millis

#: Field separator, quote and escape of the CSV dialect.
DIALECT = {"sep": ",", "quote": '"', "escape": "\\"}


def _typed(rows: DataFrame, schema: T.StructType, null: str) -> DataFrame:
    """Text columns as their types; the null literal and what cannot be read are null."""

    def value(f: T.StructField):
        text = F.when(F.col(f.name) != null, F.col(f.name))
        return (text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)).alias(f.name)

    return rows.select(*map(value, schema))


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, null: str = "null") -> DataFrame:
    """A table of CSV files; only the chosen columns are parsed."""
    rows = spark.read.options(**DIALECT).schema(_as_text(schema)).csv(path)
    kept = schema if columns is None else T.StructType([schema[c] for c in columns])
    return _typed(rows, kept, null)


def csv_source(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1, null: str = "null") -> DataFrame:
    """A stream of CSV files."""
    rows = spark.readStream.options(**DIALECT).option("maxFilesPerTrigger", files_per_batch).schema(_as_text(schema)).csv(folder)
    return _typed(rows, schema, null)


def discard(df: DataFrame) -> None:
    """Computes everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def file_sink(
    df: DataFrame, path: str, partition_by: list[str], checkpoint: str | None = None, form: str = "csv", rows_per_file: int = 0, interval: str | None = None
):
    """Writes partition folders `key=value`; a new file begins after so many rows and with each micro-batch.

    For a stream gives the running query; without an interval it takes what is there and ends.
    """
    options = {"maxRecordsPerFile": str(rows_per_file)} if rows_per_file else {}
    if not df.isStreaming:
        df.write.mode("append").options(**options).partitionBy(*partition_by).format(form).save(path)
        return None
    writer = df.writeStream.options(**options, checkpointLocation=checkpoint).partitionBy(*partition_by).format(form)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start(path)


def commit_partitions(
    spark: SparkSession, path: str, time_of: Callable[[dict[str, str]], int], now_ms: int, delay: str = "0 seconds", policy: str = "success-file",
    on_commit: Callable[[str], None] | None = None,
) -> list[str]:
    """Marks partitions that are complete: those whose time (in milliseconds, from their keys) plus the delay the
    watermark or clock `now_ms` has passed.  Policies: `success-file` writes `_SUCCESS`, `callback` calls `on_commit`.

    Uses the file system of the path, lists folders only, and is safe to repeat.
    """
    if policy not in ("success-file", "callback"):
        raise ValueError(f"unknown policy {policy!r}")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done: list[str] = []

    def visit(folder, keys: dict[str, str]) -> None:
        inner = [s.getPath() for s in files.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        for child in inner:
            name, value = child.getName().split("=", 1)
            visit(child, {**keys, name: value})
        if inner or not keys or time_of(keys) + millis(delay) > now_ms:
            return
        mark = spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        if policy == "success-file":
            if files.exists(mark):
                return
            files.create(mark, True).close()
        else:
            on_commit(folder.toString())
        done.append(folder.toString())

    visit(root, {})
    return sorted(done)
