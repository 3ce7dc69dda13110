"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending identifier order:

    magic | block ... block | sparse index | Bloom filter | footer

* Key: the identifier as 8 bytes, big-endian, sign bit flipped, so that bytes
  sort as numbers; a null identifier has the empty key and sorts first.
* Block (zstd): entries `shared u8, rest u8, size u32, key rest, value`; a key
  is the first `shared` bytes of the key before it and the rest.  The value is
  the document's ids, unsigned 32-bit little-endian, end id included.
* Sparse index: per block `key size u8, first key (8 bytes, padded), offset
  u64, bytes u32, documents u32, ids before the block u64`.
* Bloom filter over the keys: 10 bits a key, 7 probes.
* Footer (fixed size, at the end): offsets and sizes of index and filter,
  documents, ids, CRC of index and filter, magic.

`Shard` finds a key by the filter, a binary search over the sparse index and a
look into one block.  Shards are written by the tasks of a range-partitioned,
sorted table under names that no other attempt uses; the manifest, a Parquet
table with a row per shard, is what counts, so files of lost attempts are never
read.  The folder must be one that pyarrow can write and Spark can read.

Nulls: a null text is empty, its only id is the end id; a null identifier is
kept.  Rows with equal identifiers all stay, next to one another.  An empty
table gives an empty manifest and result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookspan.llm.common import fresh_path, ship, slices, stored, text_or_empty
from brookspan.llm.tokens import encoder, tokenizer_path

MAGIC = b"BSSTAB01"
FOOTER = struct.Struct("<QQQQQQII8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<B8sQIIQ")
#: Bytes of ids before a block, and of compressed blocks before a shard, is closed.
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 16 << 20
BITS_PER_KEY, PROBES = 10, 7
#: Pieces in one generation of a writing task's memo, which has the worker to itself: some 80 MB.
MEMO = 400_000
#: Bytes of ids that a reading task gives at once.
READ_BYTES = 8 << 20
MANIFEST = "file string, part long, number long, documents long, ids long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects documents in key order and gives the bytes of a shard."""

    def __init__(self):
        self.out = bytearray(MAGIC)
        self.index, self.keys = [], []
        self.documents = self.ids = 0
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last, self.count, self.before = bytearray(), None, b"", 0, self.ids

    def add(self, doc_id: int | None, value: bytes) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.count += 1
        self.documents += 1
        self.ids += len(value) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.count:
            packed = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            self.index.append(INDEX.pack(len(self.first), self.first, len(self.out), len(packed), self.count, self.before))
            self.out += packed
            self._open()

    def finish(self) -> bytes:
        self._close()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index, at = b"".join(self.index), len(self.out)
        check = zlib.crc32(bytes(bloom), zlib.crc32(index))
        footer = FOOTER.pack(at, len(index), at + len(index), len(bloom), self.documents, self.ids, check, bits, MAGIC)
        return bytes(self.out) + index + bytes(bloom) + footer


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        at, size, bloom_at, bloom_size, self.documents, self.ids, check, self.bits, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        index, self.bloom = self.data[at : at + size], self.data[bloom_at : bloom_at + bloom_size]
        if magic != MAGIC or check != zlib.crc32(self.bloom, zlib.crc32(index)):
            raise ValueError("not a shard, or a damaged one")
        self.blocks = [INDEX.unpack_from(index, i) for i in range(0, size, INDEX.size)]
        self.firsts = [first[:n] for n, first, *_ in self.blocks]

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, _, at, size, count, _ = self.blocks[number]
        raw = zstandard.ZstdDecompressor().decompress(self.data[at : at + size])
        key, at = b"", 0
        for _ in range(count):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for number in range(len(self.blocks)):
            for key, value in self.block(number):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of all documents with this identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        first = max(0, bisect_left(self.firsts, key) - 1)
        return [v for number in range(first, bisect_right(self.firsts, key)) for k, v in self.block(number) if k == key]


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str | None = None, keeps_space: bool = True, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encodes the documents, writes shards into `folder`, gives the manifest in key order of (part, number)."""
    spark = docs.sparkSession
    ship(spark)
    end = struct.pack("<I", end_id)
    pyarrow.fs.FileSystem.from_uri(_uri(folder))[0].create_dir(pyarrow.fs.FileSystem.from_uri(_uri(folder))[1])

    def write(batches):
        store, base = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        ids = encoder(vocabulary or tokenizer_path("byte_bpe_50k.json"), keeps_space, MEMO)
        part, number, shard = TaskContext.get().partitionId(), 0, ShardWriter()

        def close():
            name = f"shard-{part:07d}-{number:05d}-{uuid.uuid4().hex}.sst"
            data = shard.finish()
            with store.open_output_stream(f"{base}/{name}") as file:
                file.write(data)
            row = {"file": name, "part": part, "number": number, "documents": shard.documents, "ids": shard.ids, "bytes": len(data)}
            return pa.RecordBatch.from_pylist([row])

        for batch in slices(batches):
            for doc_id, value in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), strict=True):
                shard.add(doc_id, value + end)
                if len(shard.out) >= SHARD_BYTES:
                    yield close()
                    number, shard = number + 1, ShardWriter()
        if shard.documents:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() // 100_000)
    in_order = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return stored(in_order.mapInArrow(write, MANIFEST), "shard-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary) of each document, from the files.

    The ids before each shard come from the manifest, so that a task reads and
    numbers its files by itself.
    """
    spark = manifest.sparkSession
    ship(spark)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        store, base = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}") as file:
                    shard = Shard(file.read())
                rows, size = ([], [], []), 0
                for doc_id, value in shard:
                    for column, x in zip(rows, (doc_id, start, value), strict=True):
                        column.append(x)
                    start, size = start + len(value) // 4, size + len(value)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, rows, kinds.types)), schema=kinds)
                        rows, size = ([], [], []), 0
                yield pa.RecordBatch.from_arrays(list(map(pa.array, rows, kinds.types)), schema=kinds)

    running = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(running(Window.orderBy("part"))), F.lit(0)).alias("before_part"))  # a row a part
    inside = F.coalesce(F.sum("ids").over(running(Window.partitionBy("part").orderBy("number"))), F.lit(0))
    places = manifest.withColumn("inside", inside).join(parts, "part").select("file", (F.col("before_part") + F.col("inside")).alias("before"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + manifest.count() // 16)
    return places.repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, ids binary")


def shard_folder(docs: DataFrame) -> str:
    """A new folder for shards beside the session's other shared files."""
    return fresh_path(docs.sparkSession, "shards")
