"""What the operators share: the shared folder, reading tables, Arrow helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts, as patterns of Java, Python and RE2.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else one made for this session."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brookspan-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 8 << 20):
    """Arrow batches cut into slices of few rows and about `size` bytes, so that what is made of one stays small."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, int(n * size / max(1, batch.nbytes)))) if n else 1
        for at in range(0, n, step):
            yield batch.slice(at, step)


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors, once, unless PYTHONPATH already leads them to it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) in known or getattr(context, "_brookspan_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/brookspan", "zip", root, "brookspan")
    context.addPyFile(made)
    context._brookspan_shipped = True


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` with a plain function from one record batch to one record batch, applied to small slices."""

    def run(batches):
        for batch in slices(batches):
            yield function(batch)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str):
    """The text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
