"""Target-distribution importance resampling over partition-local word tries.

Features are runs of 1 to `longest` consecutive words, hashed by CRC-32 into buckets. A task keeps a trie of the words
that it meets: a node stands for one run, holds how often it was passed and the CRC state of its bytes, so that a child's
checksum goes on from its parent's and a run is hashed once a task, however often it occurs. Counting passes end in
bucket totals, one row a bucket and task, merged by one aggregation; the totals of both sides, a row a bucket, give every
bucket's gain. Scoring walks tries again, whose nodes now hold the gain of their bucket, and adds up along the paths.

Tries are bounded: one of more than `NODES` nodes is emptied (counts go to the totals first), between pieces of a text
too, so a worker's memory follows neither the vocabulary nor a text's length. Features are Gumbel-perturbed weights; the draw
sorts them by ranges and ranks by a prefix sum over the ranges' sizes, so no task sees all rows. Rows that are equal in all
that the order looks at are spread by their place in the stored table.

Defined cases: a null or empty text has no features and weight 0; very long texts are walked whole, piece by piece; repeated
rows each count, score and draw (of equal ones, each takes a rank); a null doc_id hashes like the empty text and loses ties;
empty documents have no rows; an empty target has T = 0; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import ALNUM, LOWER, release, stored, text_bytes

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Nodes that a trie holds at most, and bytes of a text that are walked at once.
NODES = 1 << 20
PIECE = 1 << 20

#: Bytes to bytes: words in lower case, all else blank.
_BLANK = np.where(ALNUM[LOWER], LOWER, 32).astype(np.uint8).tobytes()


def pieces(raw: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, a list for each limit bytes of it; no word is cut."""
    text, at = raw.translate(_BLANK), 0
    while at < len(text):
        end = text.find(b" ", at + limit) if at + limit < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Words(dict):
    """Nodes of the first level by their word."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.add(crc32(word), word)
        return node


class _Longer(dict):
    """Nodes below the first level by parent and word, packed."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie

    def __missing__(self, key: int) -> int:
        trie, parent = self.trie, key >> 32
        node = self[key] = trie.add(crc32(b" " + trie.words[key & 0xFFFFFFFF], trie.states[parent]), b"")
        return node


class Trie:
    """Runs of words as paths; a node holds its run's CRC state and, with gains, the gain of its bucket."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS, gains: np.ndarray | None = None) -> None:
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.states: list[int] = []
        self.words: list[bytes] = []
        self.first, self.longer = _Words(self), _Longer(self)
        self.counts = np.zeros(1024, np.int64)
        self.held = np.zeros(0, np.int64)

    def add(self, state: int, word: bytes) -> int:
        self.states.append(state)
        self.words.append(word)
        return len(self.states) - 1

    def walk(self, words: list[bytes], before: list[int]) -> Iterator[np.ndarray]:
        """The nodes of all runs that end in these words, a level at a time; before: the nodes of up to longest - 1 words that stand before."""
        own = np.fromiter(map(self.first.__getitem__, words), np.int64, len(words))
        yield own
        line = np.concatenate([np.array(before, np.int64), own])
        nodes = line
        for level in range(2, self.longest + 1):
            keys = (nodes[: len(line) - level + 1] << 32) | line[level - 1 :]
            nodes = np.fromiter(map(self.longer.__getitem__, keys.tolist()), np.int64, len(keys))
            yield nodes[max(0, len(before) - level + 1) :]

    def count(self, nodes: np.ndarray) -> None:
        if len(self.states) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(2 * len(self.states) - len(self.counts), np.int64)])
        np.add.at(self.counts, nodes, 1)

    def of_buckets(self) -> np.ndarray:
        return np.fromiter(self.states, np.int64, len(self.states)) % self.buckets

    def totals(self) -> np.ndarray:
        """Counts by bucket; the trie is empty after."""
        found = np.zeros(self.buckets, np.int64)
        np.add.at(found, self.of_buckets(), self.counts[: len(self.states)])
        self.clear()
        return found

    def gain(self, nodes: np.ndarray) -> int:
        if len(self.held) < len(self.states):
            new = np.fromiter(self.states[len(self.held) :], np.int64)
            self.held = np.concatenate([self.held, self.gains[new % self.buckets]])
        return int(self.held[nodes].sum())

    def runs(self, raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(level, nodes) over a whole text. Between pieces a full trie is emptied, through `full`, and the last words are entered anew."""
        tail: list[bytes] = []
        for words in pieces(raw):
            if len(self.states) > NODES:
                self.full()
            before = [self.first[w] for w in tail]
            for level, nodes in enumerate(self.walk(words, before)):
                yield level, nodes
            tail = [*tail, *words][-(self.longest - 1) :] if self.longest > 1 else []

    def full(self) -> None:
        self.clear()


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        yield batch, *text_bytes(batch.column(column))


def bucket_totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        trie = Trie(longest, buckets)
        trie.full = lambda: np.add(total, trie.totals(), out=total)
        for _, raw, at in _texts(batches, 0):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for _, nodes in trie.runs(raw[a:b].tobytes()):
                    trie.count(nodes)
            release()
        total += trie.totals()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    found = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row for each bucket
        found[r.bucket] = r.n
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket in target and source, in floored thousandths."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), float(len(source))
    ratios = (target + 1.0) * (s_all + n) / ((source + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, in floored thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, len(gains), gains)
        for batch, raw, at in _texts(batches, 1):
            ids = batch.column(0).to_pylist()
            found = np.zeros((len(ids), 3), np.int64)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for level, nodes in trie.runs(raw[a:b].tobytes()):
                    found[i] += (len(nodes) if not level else 0, len(nodes), trie.gain(nodes) if len(nodes) else 0)
            scores = found[:, 2] + np.fromiter((noise(x, seed) for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T.copy()), pa.array(scores)], names=["doc_id", "n_words", "n_features", "weight", "score"])
            release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The columns of weights() and rank: 1, 2, 3 ... over the drawn share of the rows with enough words, null for others."""
    scored = stored(scored, "weights").withColumn("place", F.monotonically_increasing_id())
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("place")]
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the upper bits of this number are the range, the lower 33 the place in it
    ranged = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place").withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, "ranges")
    part = F.shiftright("at", 33)
    sizes = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    total, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, total))
        total += sizes[p]
    starts = F.broadcast(scored.sparkSession.createDataFrame(rows or [(0, 0)], "part long, start long"))
    nth = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(nth <= percent * total // 100, nth))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(rest.select(names))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs with its weight towards the target's texts, its perturbed score, and its rank where it is drawn."""
    gains = bucket_gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    return draw(weights(docs, gains, longest, seed), percent, least_words)


#: The contract's run in DuckDB SQL: CRC-32 by a byte table made from its polynomial, once for each distinct word.
SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
words AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
coded AS (SELECT w, list_transform(range(1, (strlen(w) + 1)::BIGINT), lambda i: instr('0123456789ABCDEF', substr(hex(w), 2 * i - 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(w), 2 * i, 1)) - 17) AS bytes FROM (SELECT DISTINCT w FROM words)),
bucketed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM coded, tab),
counted AS (SELECT side, id, bucket, count(*) AS n FROM words JOIN bucketed USING (w) GROUP BY ALL),
tally AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM tally),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
hashed AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)), lambda a, x: a * 16 + x) AS h
  FROM documents LEFT JOIN weighed ON doc_id = id),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM hashed),
ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS nth, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * able // 100 THEN nth END AS rank FROM ranked
"""
