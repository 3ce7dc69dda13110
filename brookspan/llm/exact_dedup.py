"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text's bytes are cut into chunks.  Each chunk's hash is a polynomial in a
fixed base modulo two primes of 31 bits, and hashes combine by length-shifted
arithmetic, H(a + b) = H(a) * base^len(b) + H(b), so chunks of a huge document
can be hashed apart and in any grouping.  Rows of one (fingerprint, length)
form a candidate class.  Its members are compared with the class's first row in
chunks; a row that differs is put into a class of its own kind by its SHA-256.

A large class is dealt over many tasks: the first row's chunks are copied once
for every `GROUP` members, which are joined on (class, part, chunk).

Nulls: a null text is empty.  Rows with a null identifier take part, and never
name a class that has another row.  Rows repeated with one identifier each stay
in the result.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookspan.llm.common import SPACES, fresh_name, mapped, stored, text_or_empty

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Bytes hashed at once, and characters compared at once.
CHUNK = 1 << 16
COMPARED = 1 << 18
#: Members that share one copy of the first row's chunks.
GROUP = 256

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_POWERS: list[np.ndarray] = []


def normalised(text: str) -> bytes:
    """UTF-8 of the text with each run of white space as one blank."""
    data = text.encode().translate(_SPACES)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def _powers() -> list[np.ndarray]:
    """base^(CHUNK-1), ..., base, 1 modulo each prime."""
    if not _POWERS:
        for prime, base in zip(PRIMES, BASES, strict=True):
            powers, x = np.empty(CHUNK, np.int64), 1
            for i in range(CHUNK - 1, -1, -1):
                powers[i] = x
                x = x * base % prime
            _POWERS.append(powers)
    return _POWERS


def chunk_hash(chunk: bytes) -> tuple[int, int, int]:
    """(hash modulo either prime, length) of at most CHUNK bytes."""
    data = np.frombuffer(chunk, np.uint8).astype(np.int64)
    n = len(data)
    return (*(int(np.dot(data + 1, powers[CHUNK - n :])) % prime for powers, prime in zip(_powers(), PRIMES, strict=True)), n)


def combined(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The hash of the concatenation; associative, (0, 0, 0) is neutral."""
    return (*((a[k] * pow(BASES[k], b[2], PRIMES[k]) + b[k]) % PRIMES[k] for k in (0, 1)), a[2] + b[2])


def fingerprint(data: bytes) -> tuple[int, int, int]:
    """The hash of bytes of any length, made of its chunks' hashes."""
    whole = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        whole = combined(whole, chunk_hash(data[at : at + CHUNK]))
    return whole


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (62 bits), n_bytes, sha256 of each row's normalised text."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, lengths, digests = [], [], []
        for text in batch.column(1).to_pylist():
            data = normalised(text)
            a, b, n = fingerprint(data)
            prints.append(a << 31 | b)
            lengths.append(n)
            digests.append(hashlib.sha256(data).digest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary())],
            ["doc_id", "print", "n_bytes", "sha256"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return mapped(rows, hashed, "doc_id long, print long, n_bytes long, sha256 binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stored(fingerprints(docs, id_col, text_col), "exact-prints")
    key = ["print", "n_bytes"]
    classes = rows.groupBy(*key).agg(
        F.min("doc_id").alias("first_id"),
        F.min_by("sha256", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("first_sha"),
        F.count(F.lit(1)).alias("rows"),
    )
    several = stored(classes.where("rows > 1"), "exact-classes")
    parts = F.ceil(F.col("rows") / GROUP)
    members = (
        rows.join(several, key)
        .where(~F.col("doc_id").eqNullSafe(F.col("first_id")) | (F.col("sha256") != F.col("first_sha")))
        .select("doc_id", "sha256", *key, F.pmod(F.xxhash64("doc_id", "sha256"), parts).alias("part"))
        .distinct()
    )
    heads = several.select(
        F.col("first_id").alias("doc_id"), F.col("first_sha").alias("sha256"), *key,
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
    )
    plain = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.regexp_replace(text_or_empty(text_col), SPACES, " ").alias("_text")
    )

    def chunks(of: DataFrame, name: str) -> DataFrame:
        """The chunks of the normalised texts of some rows."""
        joined = of.join(plain, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.sha2("_text", 256)) == F.col("sha256")))
        at = F.explode(F.sequence(F.lit(0), F.floor(F.length("_text") / COMPARED).cast("int"))).alias("chunk")
        return joined.select(*of.columns, "_text", at).select(
            *of.columns, "chunk", F.substring("_text", F.col("chunk") * COMPARED + 1, F.lit(COMPARED)).alias(name)
        )

    ours = chunks(members, "_ours")
    theirs = chunks(heads, "_theirs").drop("doc_id", "sha256")
    compared = (
        ours.join(theirs, [*key, "part", "chunk"], "left")
        .groupBy(*key, "doc_id", "sha256")
        .agg(F.bool_and(F.coalesce(F.col("_ours") == F.col("_theirs"), F.lit(False))).alias("same"))
    )
    other = stored(compared.where(~F.col("same")).select(*key, "doc_id", "sha256"), "exact-others")
    if other.isEmpty():  # no fingerprint of two different texts
        final = rows.join(several.drop("first_sha"), key, "left")
        keep = F.when(F.col("rows") > 1, F.col("first_id")).otherwise(F.col("doc_id"))
        return final.select(
            "doc_id", keep.alias("keep_id"), F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
            keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"),
        )
    own = rows.join(other.withColumn("kind", F.col("sha256")), [*key, "doc_id", "sha256"], "left").withColumn(
        "kind", F.coalesce("kind", F.lit(b""))
    )
    kinds = own.groupBy(*key, "kind").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return own.join(kinds, [*key, "kind"]).select(
        "doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns; of rows with one identifier (or none) and text, one."""
    id_, sha, kept_sha = (fresh_name(docs, name) for name in ("_id", "_sha256", "_kept"))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(kept_sha)).distinct()
    hashed = docs.withColumn(sha, F.sha2(F.regexp_replace(text_or_empty(text_col), SPACES, " "), 256))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(kept_sha))
    return hashed.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
