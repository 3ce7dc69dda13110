"""Query of the sorted-string-table output; SQL cannot express the encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookspan.llm.common import table
from brookspan.llm.sstable import read_shards, shard_folder, write_shards


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shard_folder(docs)
    found = read_shards(write_shards(docs, folder), folder)
    return found.select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {"op2_sstable": op2_sstable}
