"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a slice of a partition, a few MB of whole documents. Its words are ranked in the benchmark's vocabulary; a
word outside it ends every match. Suffixes with whose first words no window begins are left out of the array, and windows
with whose first words no suffix does need no search, which loses no match and makes the work follow the matches, not
the benchmark's size. The remaining suffixes are sorted (to the depth of a window), every test suffix that is left is
binary-searched for its first and last place, and all places between are occurrences. Consecutive occurrences along one
diagonal of (document word, item word) join to the longest verbatim match and its place (of equal ones the first).
Words in any occurrence are hit; documents with enough of them go.

The packed benchmark, about 16 bytes a word, goes to the executors as a broadcast while it is below `broadcast_bytes`, and
is read from the shared folder beyond that. A worker keeps it, up to `held_bytes`; a benchmark beyond that is read block by
block, once for every `SHARDS` shards of documents. The result is the same.

Defined cases: a null, empty or wordless text has no words and is never contaminated; a wordless item
never occurs; items of one id count once; a null item_id marks words but isn't listed; a very long text is a shard of
its own; an empty benchmark hits nothing, and an empty table has no rows; repeated rows and ties each return; extra
columns, whatever their names, are not read by matches and come back from decontaminate.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import HashIndex, mapped, ranges, spans, stored, text_slices, words_of

WINDOW = 13
#: Packed benchmark bytes up to which it is broadcast.
BROADCAST_BYTES = 24 << 20
#: Bytes of benchmark text in a block, and of blocks that a worker keeps.
PACK_BYTES = 8 << 20
HELD_BYTES = 512 << 20
#: Words of a head, and windows searched at once.
HEAD = 4
SEARCHED = 1 << 16
#: Shards that a task holds at once: it reads a benchmark that isn't kept once for so many.
SHARDS = 96
FIELDS = "n_words long, n_hit long, items array<string>, longest_words long, longest_at long"


def _keys(ranks: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int, fill: int = 0) -> np.ndarray:
    """The ranks from each place on, to its end, as fixed-width byte strings that sort as the suffixes do."""
    index = at[:, None] + np.arange(depth)
    beyond = index >= ends[:, None]
    index[beyond] = 0
    values = ranks[index].astype(">u4")
    values[beyond] = fill
    return np.ascontiguousarray(values).view(f"S{4 * depth}")[:, 0]


def _heads(ranks: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """One number for the first words of each suffix: equal beginnings have equal ones."""
    found = np.zeros(len(at), np.uint64)
    for k in range(words):
        found = (found ^ ranks[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


@dataclass
class Block:
    """A part of the benchmark: its words' hashes, each word's rank among them, the items' borders, and every window's start by head.

    A window's head is of its first HEAD words, or of all if it has fewer; by_head holds, for each number of words, the
    heads in order and the starts beside them. That is 16 bytes a word, and no window's key is held.
    """

    ids: list[str | None]
    hashes: np.ndarray
    ranks: np.ndarray
    border: np.ndarray
    by_head: dict[int, tuple[np.ndarray, np.ndarray]]
    window: int

    def __post_init__(self) -> None:
        self.vocabulary = HashIndex(self.hashes, spare=2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vocabulary"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.ranks, self.border, self.vocabulary.table, *(a for pair in self.by_head.values() for a in pair)))


def pack(ids: list[str | None], texts: pa.Array, window: int = WINDOW) -> Iterator[Block]:
    """The benchmark in blocks."""
    for a, b, raw, at in text_slices(texts, PACK_BYTES):
        _, _, border, hashes = words_of(raw, at)
        if not len(hashes):
            continue
        vocabulary, ranks = np.unique(hashes, return_inverse=True)
        ranks = ranks.astype(np.uint32) + 1
        n = np.diff(border)
        wide = np.minimum(n, window)
        windows = np.where(n > 0, n - wide + 1, 0)
        starts = ranges(border[:-1], windows)
        head = np.repeat(np.minimum(wide, HEAD), windows)
        by_head = {}
        for words in np.unique(head).tolist():
            own = starts[head == words]
            heads = _heads(ranks, own, words)
            order = np.argsort(heads, kind="stable")
            by_head[words] = (heads[order], own[order].astype(np.int32))
        yield Block(ids[a:b], vocabulary, ranks, border.astype(np.int32), by_head, window)


def suffix_array(block: Block, ranks: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and places of all suffixes of the shard that some test suffix could match, and the starts of those test suffixes.

    A suffix is left out if no window begins with its first words, and a window if no suffix of the shard does; neither loses a match.
    """
    starts, ends, _ = spans(ranks > 0, border)
    at = ranges(starts, ends - starts)
    until = np.repeat(ends, ends - starts)
    kept, wanted = np.zeros(len(at), bool), []
    for words, (heads, places) in block.by_head.items():
        fit = np.flatnonzero(until - at >= words)
        own = _heads(ranks, at[fit], words)
        low = np.searchsorted(heads, own, "left")
        there = heads[np.minimum(low, len(heads) - 1)] == own
        kept[fit[there]] = True
        first = np.unique(low[there])
        n = np.searchsorted(heads, heads[first], "right") - first
        wanted.append(places[ranges(first, n)])
    at, until = at[kept], until[kept]
    keys = _keys(ranks, at, until, block.window)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order], np.concatenate(wanted) if wanted else np.zeros(0, np.int32)


def occurrences(block: Block, keys: np.ndarray, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, item, offset) of every occurrence of these windows in the shard, by binary search."""
    out = []
    for i in range(0, len(starts), SEARCHED):
        own = starts[i : i + SEARCHED].astype(np.int64)
        item = np.searchsorted(block.border, own, "right") - 1
        end = np.minimum(own + block.window, block.border[item + 1])
        low = np.searchsorted(keys, _keys(block.ranks, own, end, block.window), "left")
        n = np.searchsorted(keys, _keys(block.ranks, own, end, block.window, 0xFFFFFFFF), "right") - low
        of = np.repeat(np.arange(len(own)), n)
        out.append((places[ranges(low, n)], (end - own)[of], item[of], (own - block.border[item])[of]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _longest(doc: np.ndarray, item: np.ndarray, offset: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, words, place) of each document's longest verbatim match: runs of occurrences along a diagonal."""
    order = np.lexsort((place, place - offset, item))
    doc, item, place, diagonal, length = doc[order], item[order], place[order], (place - offset)[order], length[order]
    new = np.ones(len(doc), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    words = np.diff(np.append(first, len(doc))) - 1 + length[first]
    best = np.lexsort((place[first], -words, doc[first]))
    doc, words, place = doc[first][best], words[best], place[first][best]
    one = np.ones(len(doc), bool)
    one[1:] = doc[1:] != doc[:-1]
    return doc[one], words[one], place[one]


def scan(texts: pa.Array, blocks: Callable[[], Iterator[Block]]) -> list[pa.Array]:
    """For each text: words, words hit, the items that occur, and the longest match with its first word."""
    out: tuple[list, ...] = ([], [], [], [], [])
    shards: list[Shard] = []

    def search() -> None:
        """Each block is read once for all the shards held."""
        for block in blocks():
            for shard in shards:
                shard.search(block)
        for shard in shards:
            for column, values in zip(out, shard.found(), strict=True):
                column.append(values)
        shards.clear()

    for _, _, raw, at in text_slices(texts):
        _, _, border, hashes = words_of(raw, at)
        shards.append(Shard(border, hashes))
        if len(shards) == SHARDS:
            search()
    search()
    whole = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    words, hits, items, longest, longest_at = out
    most = whole(longest)
    return [pa.array(whole(words)), pa.array(whole(hits)), pa.array([x for some in items for x in some], pa.list_(pa.string())), pa.array(most), pa.array(whole(longest_at), mask=most == 0)]


class Shard:
    """The words of a slice of texts, and what was found in them."""

    def __init__(self, border: np.ndarray, hashes: np.ndarray) -> None:
        self.border, self.hashes = border, hashes
        n = len(border) - 1
        self.marks = np.zeros(len(hashes) + 1, np.int32)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.most, self.where = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def search(self, block: Block) -> None:
        place, length, item, offset = occurrences(block, *suffix_array(block, block.vocabulary(self.hashes), self.border))
        if not len(place):
            return
        np.add.at(self.marks, place, 1)
        np.add.at(self.marks, place + length, -1)
        doc = np.searchsorted(self.border, place, "right") - 1
        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
            if block.ids[i] is not None:
                self.items[d].add(block.ids[i])
        doc, n, place = _longest(doc, item, offset, place, length)
        place = place - self.border[doc]
        more = (n > self.most[doc]) | ((n == self.most[doc]) & (place < self.where[doc]))  # of equal ones the first place, whatever the order of blocks
        self.most[doc[more]], self.where[doc[more]] = n[more], place[more]

    def found(self) -> tuple:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.marks[:-1]) > 0)])
        return np.diff(self.border), np.diff(hit[self.border]), [sorted(x) for x in self.items], self.most, self.where


_LOADED: dict[str, list[Block]] = {}


def _source(benchmark: DataFrame, item_col: str, text_col: str, window: int, broadcast_bytes: int, held_bytes: int) -> Callable[[], Iterator[Block]]:
    """A function for the executors that gives the benchmark's blocks; a worker keeps those that it has read, up to held_bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = list(pack(batch.column(0).to_pylist(), batch.column(1), window))
            blobs = [pickle.dumps(x) for x in blocks]
            columns = [pa.array(blobs, pa.binary()), pa.array([len(x) for x in blobs], pa.int64()), pa.array([x.size for x in blocks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "size", "held"])

    chosen = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(chosen.mapInArrow(packed, "block binary, size long, held long"), "benchmark")
    size, held = (x or 0 for x in blocks.agg(F.sum("size"), F.sum("held")).first())
    name = uuid.uuid4().hex
    if size <= broadcast_bytes:
        sent = benchmark.sparkSession.sparkContext.broadcast([bytes(r.block) for r in blocks.select("block").collect()])

        def read() -> Iterator[Block]:
            return map(pickle.loads, sent.value)

    else:
        files = blocks.inputFiles()

        def read() -> Iterator[Block]:
            import pyarrow.fs
            import pyarrow.parquet as pq

            for uri in files:
                system, path = pyarrow.fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(batch_size=1, columns=["block"]):
                        yield pickle.loads(batch.column(0)[0].as_py())

    if held > held_bytes:
        return read

    def kept() -> Iterator[Block]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = list(read())
        return iter(_LOADED[name])

    return kept


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """For each document n_words, n_hit, items, longest_words and longest_at; without id_col beside the whole row."""
    blocks = _source(benchmark, item_col, item_text_col, window, broadcast_bytes, held_bytes)
    return mapped(docs, lambda texts: scan(texts, blocks), FIELDS, id_col, text_col)


#: A document is contaminated if a twentieth of its words, and one at least, are hit.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    return matches(docs, benchmark, id_col=None).where(f"NOT ({CONTAMINATED})").select("row.*")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows in DuckDB SQL, by joining windows.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT iid, item_id, w, least({WINDOW}, len(w)) AS n FROM i WHERE len(w) > 0),
ik AS (SELECT iid, item_id, n, o AS off, array_to_string(w[o + 1:o + n], ' ') AS k FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS o FROM iw)),
dk AS (SELECT rid, n, p, array_to_string(w[p + 1:p + n], ' ') AS k FROM (SELECT d.*, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
occ AS (SELECT rid, iid, item_id, n, p, off FROM dk JOIN ik USING (n, k)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM occ)) GROUP BY rid),
its AS (SELECT rid, list(DISTINCT item_id::VARCHAR ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY rid),
run AS (SELECT rid, min(p) AS spot, count(*) - 1 + min(n) AS words FROM (SELECT *, p - row_number() OVER (PARTITION BY rid, iid, p - off ORDER BY p) AS g FROM occ) GROUP BY rid, iid, p - off, g),
lon AS (SELECT rid, max(words) AS words, arg_max(spot, words * 1000000000 - spot) AS spot FROM run GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(words, 0)::BIGINT AS longest_words, spot AS longest_at
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN lon USING (rid)
"""
