"""Helpers that several operators share: the shared folder, Arrow text batches and word hashing.

Word hashing works on the UTF-8 bytes of many texts at once with numpy, in slices of a few MB,
so a Python worker holds tens of MB whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trivalent.session import shared_dir

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, for every executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that is free in this worker back to the machine: workers are reused, and what one stage held would stand beside the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to at most limit; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n+1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for each slice of the column."""
    if not len(column):
        return
    raw, at = text_bytes(column)
    for a, b in slices(np.diff(at), limit):
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]


def spans(is_word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row borders, and the n+1 borders of each row's words."""
    before, after = np.zeros_like(is_word), np.zeros_like(is_word)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    inner = at[(at > 0) & (at < len(is_word))]
    before[inner], after[inner - 1] = False, False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a to z, and all of non-ASCII letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of bytes: a polynomial over the ring of 64-bit integers, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row borders and hashes of the lower-cased alphanumeric words of a slice."""
    low = LOWER[raw]
    starts, ends, border = spans(ALNUM[low], at)
    return starts, ends, border, word_hashes(low, starts, ends)


def mapped(docs: DataFrame, each, fields: str, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Columns that each(texts) gives for Arrow batches of whole texts, beside what is kept of the row.

    With id_col, that column is kept, as doc_id; without, the whole row, as the struct `row`, whatever its
    columns are called. each takes an Arrow array of texts and returns a list of Arrow arrays, in fields' order.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if id_col:
        chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text_"))
    else:
        chosen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        place = docs.columns.index(text_col)
    schema = T.StructType([chosen.schema[0], *T.StructType.fromDDL(fields).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1) if id_col else batch.column(0).field(place)
            yield pa.RecordBatch.from_arrays([batch.column(0), *each(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))], names=names)
            del texts, batch
            release()

    return chosen.mapInArrow(run, schema)


class HashIndex:
    """Places, from 1, of 64-bit hashes in a fixed set; 0 for hashes outside it. One look-up in a table of top bits."""

    def __init__(self, hashes: np.ndarray, spare: int = 5) -> None:
        """spare: bits of the table beyond those of the number of hashes; fewer take less memory and more searches."""
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        bits = max(10, int(len(hashes)).bit_length() + spare)
        self.shift = np.uint64(64 - bits)
        slots = (self.hashes >> self.shift).astype(np.int64)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[slots] = np.arange(1, len(slots) + 1)
        taken, times = np.unique(slots, return_counts=True)
        self.table[taken[times > 1]] = -1
        self.place = np.concatenate([[0], self.order + 1]).astype(np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        found = self.table[(hashes >> self.shift).astype(np.int64)]
        if len(crowded := np.flatnonzero(found < 0)):
            found[crowded] = np.minimum(np.searchsorted(self.hashes, hashes[crowded]), len(self.hashes) - 1) + 1
        some = np.flatnonzero(found)
        at = found[some]
        found[some] = np.where(self.hashes[at - 1] == hashes[some], self.place[at], 0)
        return found


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, so many."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
