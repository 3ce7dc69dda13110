"""Query of toxicity scoring; checked by held-out labels and brute-force neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookspan.llm.common import table
from brookspan.llm.toxicity import score_toxicity


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op4_toxicity": op4_toxicity}
