"""Running streams: table-backed sources in micro-batches and collected results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stream_of(spark: SparkSession, folder: str, schema, form: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream over the files of a folder, oldest first, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def collected(df: DataFrame, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there and gives what it emitted, in memory; for tests and small results."""
    name = "s" + uuid.uuid4().hex
    query = (
        df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.table(name)
