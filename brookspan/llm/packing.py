"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are encoded, an end id is appended, and each is cut into pieces of
`length` ids and a remainder.  Pieces are dealt by a seeded hash into groups of
about `group_bytes` of text; in a group the pieces, longest first, go to the
first bin with room.  The tree's leaves are the bins' free places and an inner
node is the larger of its children, so the leftmost bin with room is found in
log2(bins) steps.  A group is all that a task holds at once, whatever the input;
the hash is of the row's place in the input, so that rows without identifier or
with one in common are spread too.

The bin that stays emptiest in a group is about half full on average, and short
pieces fill the gaps of the others, so padding is near half a sequence a group.

Nulls: a null text is empty, its only id is the end id; null identifiers are
kept.  Repeated rows are packed each on its own.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookspan.llm.common import mapped, text_or_empty
from brookspan.llm.tokens import encoder, tokenizer_path

#: Rows for which there is a group at least, however short their texts.
GROUP_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class CapacityTree:
    """Free places of bins in a tournament tree."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Takes `size` places of the first bin that has them: (bin, free places there before)."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        before = free[node]
        if before < size:
            raise ValueError("no bin has room")
        bin_, free[node] = node - self.leaves, before - size
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return bin_, before


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces in the order given where lengths tie."""
    tree = CapacityTree(max(1, min(len(lengths), 2 * sum(lengths) // capacity + 2)), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, before = tree.place(lengths[i])
        out[i] = bin_, capacity - before
    return out


def pieces(
    docs: DataFrame, length: int = 4096, vocabulary: str | None = None, keeps_space: bool = False, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text", memo: int = 400_000,
) -> DataFrame:
    """The encoded documents cut into pieces of at most `length` ids; `row` tells rows of one identifier apart."""
    end = struct.pack("<I", end_id)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(vocabulary or tokenizer_path("word_bpe_49k.json"), keeps_space, memo)
        columns: list[list] = [[], [], [], [], [], []]
        for doc_id, value, row in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
            value += end
            n = len(value) // 4
            for start in range(0, n, length):
                piece = value[4 * start : 4 * (start + length)]
                for column, x in zip(columns, (doc_id, start, len(piece) // 4, piece, n, row), strict=True):
                    column.append(x)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "row"]
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return mapped(rows, cut, f"{PIECES}, row long")


def pack(
    docs: DataFrame, length: int = 4096, vocabulary: str | None = None, keeps_space: bool = False, end_id: int = 2,
    group_bytes: int = 8 << 20, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", memo: int = 400_000,
) -> DataFrame:
    """`memo`: pieces of text in one generation of a worker's memo, some 0.2 KB each.

    One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    total, rows = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    groups = max(1, math.ceil((total or 0) / group_bytes), math.ceil(rows / GROUP_ROWS))
    cut = pieces(docs, length, vocabulary, keeps_space, end_id, id_col, text_col, memo)
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups))).drop("row")

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_pylist()
        placed = np.array(first_fit_decreasing(lengths, length), np.int64)
        first = group.column("group")[0].as_py() << 31
        return group.drop(["group"]).append_column("sequence_id", pa.array(placed[:, 0] + first)).append_column("offset", pa.array(placed[:, 1]))

    return dealt.groupBy("group").applyInArrow(fill, f"{PIECES}, sequence_id long, offset long")
