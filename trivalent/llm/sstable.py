"""Tokenised documents in sorted-string-table shards.

A shard holds documents in ascending key order, in blocks of about 64 KB. Within a block keys are
prefix-compressed (shared length, rest); values are token ids, little-endian; a block is compressed with zstd.
After the blocks come a sparse index (the first key, place, size, documents and tokens of each block), a Bloom
filter over the keys, and a fixed footer. `SSTable` reads a shard: `get` asks the Bloom filter, binary-searches
the index and reads the blocks that can hold the key; `scan` reads all blocks in order.

The table is dealt by ranges of (doc_id, text hash), so that even one id with a third of all rows is spread;
each task streams its rows into shards of bounded size. A shard's name holds the task attempt, and only the
manifest, a Parquet table that Spark commits, says which shards count: a lost executor leaves at most an
unreferenced file. A document's start is a prefix sum over the manifest, one row a shard, plus its place within.

Defined cases: a null or empty text has only the end id; a null doc_id has the empty key, before all others;
rows of one doc_id stand together, ordered by a hash of the text and then the text, repeated rows each; a very long
text is a value like any other, its block as large as it; an empty table has no shard; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trivalent.llm.common import shared_dir, stored
from trivalent.llm.tokens import encoder

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
READERS = 20_000
END_ID = 1
MAGIC = b"TVSSTAB1"
FOOTER = struct.Struct("<QQQQIIQQ8s")
ENTRY = struct.Struct("<QIIQ")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Eight bytes that sort as the ids do; a null sorts first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while data[at] > 127:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | data[at] << shift, at + 1


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key, 7)
    step = h >> 32 | 1
    return [(h + i * step) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream, from keys in ascending order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.at = self.n_docs = self.n_tokens = self.size = 0
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.block_size, self.block_docs, self.block_tokens = [], 0, 0, 0
        self.first = self.last = None
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        if key != self.last or not self.keys:
            self.keys.append(key)
        self.last = key
        n = len(value) // self.width
        self.block_size += len(entry) + len(value)
        self.block_docs, self.block_tokens = self.block_docs + 1, self.block_tokens + n
        self.n_docs, self.n_tokens, self.size = self.n_docs + 1, self.n_tokens + n, self.size + len(value)
        if self.block_size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data), self.block_docs, self.block_tokens))
            self.out.write(data)
            self.at += len(data)
            self.block, self.block_size, self.block_docs, self.block_tokens = [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(bytes([len(k)]) + k + ENTRY.pack(*rest) for k, *rest in self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        bloom[[p for k in self.keys for p in _bloom_places(k, bits)]] = True
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), bits, self.width, self.n_docs, self.n_tokens, MAGIC))


class SSTable:
    """Reads a shard through read(start, length)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        index_at, index_len, bloom_at, bloom_len, self.bits, self.width, self.n_docs, self.n_tokens, magic = FOOTER.unpack(read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.bloom = np.frombuffer(read(bloom_at, bloom_len), np.uint8) if bloom_len else np.zeros(0, np.uint8)
        data, at, self.first, self.blocks = read(index_at, index_len) if index_len else b"", 0, [], []
        while at < len(data):
            n = data[at]
            self.first.append(data[at + 1 : at + 1 + n])
            self.blocks.append(ENTRY.unpack_from(data, at + 1 + n))
            at += 1 + n + ENTRY.size
        self.dtype = np.dtype(f"<u{self.width}")
        self.unpack = zstandard.ZstdDecompressor()

    def _entries(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, size, _, _ = self.blocks[i]
        data, at, key = self.unpack.decompress(self.read(at, size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + length]
            at += rest + length

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self._entries(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The token ids of each row with this id."""
        import bisect

        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        found = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            found += [np.frombuffer(value, self.dtype) for k, value in self._entries(i) if k == key]
        return found


def open_shard(uri: str) -> SSTable:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)
    return SSTable(lambda at, n: file.read_at(n, at), file.size())


MANIFEST = "shard string, part long, nth long, n_docs long, n_tokens long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode, sort and write docs; returns the manifest, in the shared folder: a row for each shard."""
    folder = folder or shared_dir(docs.sparkSession, "sstables")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, run = encoder(tokenizer), TaskContext.get(), uuid.uuid4().hex[:8]
        end = np.array([end_id], encode.dtype).tobytes()
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        state: list = [None, None, 0, None]  # stream, writer, number, first id

        def close() -> pa.RecordBatch:
            stream, writer, nth, first = state
            writer.close()
            stream.close()
            row = [f"{folder}/{name(nth)}", task.partitionId(), nth, writer.n_docs, writer.n_tokens, first, id_of(writer.last)]
            state[:] = [None, None, nth + 1, None]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=[x.split()[0] for x in MANIFEST.split(", ")])

        def name(nth: int) -> str:
            return f"part-{task.partitionId():06d}-{nth:04d}-{task.taskAttemptId()}-{run}.sst"

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, value in zip(ids, encode.encode(batch.column(1)), strict=True):
                if state[1] is None:
                    state[0] = system.open_output_stream(f"{path}/{name(state[2])}")
                    state[1], state[3] = Writer(state[0], encode.dtype.itemsize), doc_id
                state[1].add(key_of(doc_id), value + end)
                if state[1].size >= shard_bytes:
                    yield close()
        if state[1] is not None:
            yield close()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = chosen.withColumn("h", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(dealt.mapInArrow(write, MANIFEST), "manifest")


def _tasks(manifest: DataFrame) -> int:
    """A task for each shard, up to READERS: a number that adaptive execution leaves alone, however small the manifest is."""
    return max(1, min(manifest.count(), READERS))


def read_shards(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the shards; with ids also the ids."""
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).select("shard", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = [[] for _ in range(5)]
                held = 0
                for key, value in (table := open_shard(shard)).scan():
                    values = np.frombuffer(value, table.dtype)
                    for column, x in zip(rows, (id_of(key), at, len(values), zlib.crc32(values.astype("<u4").tobytes()), values if ids else None), strict=True):
                        column.append(x)
                    at, held = at + len(values), held + len(value) * ids + 32
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [[] for _ in range(5)], 0
                if rows[0]:
                    yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=False)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)])

    return placed.repartition(_tasks(manifest)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the rows with these ids (a list that the caller holds), by Bloom filter and binary search in the shards whose range can hold them."""
    wanted = sorted(set(doc_ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = None
                for doc_id in wanted:
                    if (row["first_id"] is None or row["first_id"] <= doc_id) and row["last_id"] is not None and doc_id <= row["last_id"]:
                        table = table or open_shard(row["shard"])
                        found = table.get(doc_id)
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found)), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return manifest.select("shard", "first_id", "last_id").repartition(_tasks(manifest)).mapInArrow(search, "doc_id long, ids array<int>")
