"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, the rest is packed.

Every stage takes (spark, docs, sf_dir) and gives documents with the columns
they came with; the last one gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookspan.llm.common import stored, table
from brookspan.llm.exact_dedup import without_duplicates
from brookspan.llm.mixing import mixed_documents
from brookspan.llm.near_dedup import without_near_duplicates
from brookspan.llm.packing import pack
from brookspan.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go; a quarter of the labels is never learned from.

    Every other row stays as it is: with null text or identifier, and repeated ones too.
    """
    learning = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return without_toxic(docs, table(spark, sf_dir, "labels"), learning)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the smallest identifier stays; one row where it is repeated or null. A null text is empty."""
    return without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles or more, the smallest identifier stays.

    Texts without words are linked with nothing and stay; rows without an identifier of their own count as documents of their own.
    """
    return without_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn, the null source last; documents are repeated, cut or left out to meet the targets, those without words always."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 4096; null identifiers and repeated rows are packed each on its own.

    The memo is small, since the workers still hold what earlier stages needed.
    """
    return pack(docs, memo=160_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the scores nor the encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
