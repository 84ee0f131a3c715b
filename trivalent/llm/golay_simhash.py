"""SimHash near-duplicates, joined through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Each segment is a word of the perfect binary
(23, 12, 7) Golay code's space, padded with zeros: decoding takes it to the one codeword within distance three. A
segment is indexed under its own codeword, and probed under the codewords of itself and of all words one flip away,
one to six of them; so segments one flip apart always meet.

Of two fingerprints that differ in at most three bits, either a segment is equal and another differs in at most one
bit, or every segment differs in exactly one, and so one half of the last is equal (pigeonhole). Hence eight kinds of
key: a whole segment with a codeword of another (six ordered pairs, 33 or 34 bits), and a codeword of each of the
first two segments with a half of the last (two, 34 or 35 bits). The join condition verifies the Hamming distance, so
only true links leave the join. Fingerprints are made distinct first, so exact copies, however many, are one row.
Links form components by alternating large-star and small-star rounds, each written to the shared folder; they settle
in a number of rounds that grows with the logarithm of the longest chain, and `max_rounds` raises rather than return
components that have not.

A link is about the bits, as the contract fixes them: near copies whose fingerprints differ in more than three bits,
as happens with short texts or more than a few changed words, aren't linked.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; very long
texts are hashed whole, in pieces of bounded size; repeated rows each return; a null doc_id never names a component
unless no other row is in it; an empty table has no rows; extra columns, whatever their names, are not read by
near_duplicates and come back from keep_one. keep_one takes a row for each component, whatever ids its rows have:
null, or shared with other components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import release, stored

#: Generator polynomial of the binary Golay code, a fixed value: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: Shift and width of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Kinds of key: (segment taken whole, segment by codeword), then the halves (shift and width) of the last segment.
ORDERED = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
HALVES = ((10, 11), (0, 10))
SEED = 42
#: Fingerprints of at least one in so many rows get their component by a broadcast, not a shuffle.
HOT_SHARE = 1000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each 12-bit message, and the error pattern of each 11-bit syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    parity = np.array([remainder(m << 11) for m in range(4096)], np.int32)
    error = np.zeros(2048, np.int32)
    flips = [1 << i for i in range(23)]
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                word = flips[i] | flips[j] | flips[k]
                error[remainder(word)] = word
    return parity, error


PARITY, ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndrome = PARITY[words >> 11] ^ (words & 2047)
    return (words ^ ERROR[syndrome]) >> 11


def near_codes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and its one-flip neighbours, sorted, and a mask of the distinct ones."""
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(width, dtype=np.int32))], axis=1)
    codes = np.sort(decode(around), axis=1)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    return codes, first


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int32) for shift, width in SEGMENTS]


def _key(kind: int, exact: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A kind, the bits that must be equal, and the codeword indices."""
    return (np.int64(kind) << 48) | (exact.astype(np.int64) << 24) | codes


def index_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): one key of each kind."""
    segments = _segments(prints)
    codes = [decode(s) for s in segments]
    keys = [_key(i, segments[a], codes[b]) for i, (a, b) in enumerate(ORDERED)]
    both = (codes[0] << 12) | codes[1]
    keys += [_key(len(ORDERED) + i, segments[2] >> shift & ((1 << width) - 1), both) for i, (shift, width) in enumerate(HALVES)]
    return np.tile(np.arange(len(prints)), len(keys)), np.concatenate(keys)


def probe_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a key of each kind for each near codeword, or pair of them."""
    segments = _segments(prints)
    near = []
    for segment, (_, width) in zip(segments, SEGMENTS, strict=True):
        codes, first = near_codes(segment, width)
        near.append((np.nonzero(first)[0], codes[first], first.sum(1)))
    rows, keys = [], []
    for i, (a, b) in enumerate(ORDERED):
        row, codes, _ = near[b]
        rows.append(row)
        keys.append(_key(i, segments[a][row], codes))
    (_, one, n_one), (_, two, n_two) = near[:2]
    n = n_one * n_two
    row = np.repeat(np.arange(len(prints)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    both = (one[(np.cumsum(n_one) - n_one)[row] + nth // n_two[row]] << 12) | two[(np.cumsum(n_two) - n_two)[row] + nth % n_two[row]]
    for i, (shift, width) in enumerate(HALVES):
        rows.append(row)
        keys.append(_key(len(ORDERED) + i, (segments[2] >> shift & ((1 << width) - 1))[row], both))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None) -> int:
    """The SimHash of the 3-word shingles of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * total > len(h)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, texts = batch.columns
        prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "print"])
        release()


def _keyed(batches: Iterator[pa.RecordBatch], keys) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 4096):
            prints = batch.column(0).slice(i, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = keys(prints)
            yield pa.RecordBatch.from_arrays([pa.array(prints[row].view(np.int64)), pa.array(key)], names=["print", "key"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and 64-bit fingerprint (signed, as Spark's long) of each row."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_fingerprints, "doc_id long, print long")


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs u < v of distinct fingerprints at most `distance` (3 or less) bits apart; a pair may return more than once."""
    if distance > 3:
        raise ValueError("the segments guarantee links of three bits or fewer")
    keyed = [prints.select("print").mapInArrow(partial(_keyed, keys=k), "print long, key long") for k in (probe_keys, index_keys)]
    probe, index = (k.select(F.col("print").alias(name), "key") for k, name in zip(keyed, "uv", strict=True))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    return probe.join(index, (probe.key == index.key) & (F.col("u") < F.col("v")) & near).select("u", "v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root the smallest node that it reaches."""
    edges = stored(edges.where("u <> v").distinct(), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components have not settled")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (signed long) and component_id of every row; n_links counts links to other fingerprints."""
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    edges = stored(links(classes, distance).distinct(), "links")
    ends = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    roots = components(edges)
    named = roots.join(classes, roots.node == classes.print)
    least = named.groupBy("root").agg(F.min("first_id").alias("component"))
    linked = roots.join(least, "root").select(F.col("node").alias("print"), "component")
    linked = linked.join(ends, linked.print == ends.u).select("print", "component", "n_links")
    by_class = classes.join(linked, "print", "left").select("print", "n", F.coalesce("component", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    by_class = stored(by_class, "components")
    rows = prints.count()
    hot = F.broadcast(by_class.where(F.col("n") * HOT_SHARE >= rows).drop("n"))  # at most HOT_SHARE rows: each stands for so large a share of all
    many = prints.join(hot, "print")
    few = prints.join(hot.select("print"), "print", "left_anti").join(by_class.drop("n"), "print")
    return many.unionByName(few).select("doc_id", "print", "component_id", "n_links")


def as_hex(column: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of its smallest doc_id (a null is the last), of several the one of the least hash of the text, then of the row."""
    from pyspark.sql import Window

    # a row's component depends on its text only, so id and text (by 128 bits) name the row that stays, but for its other columns
    doc_id = F.col("doc_id").cast("long")
    key = {"id_": F.coalesce(doc_id, F.lit(0)), "h1_": F.xxhash64(doc_id.isNull(), "text"), "h2_": F.xxhash64(F.lit(1), doc_id.isNull(), "text")}
    chosen = docs.select(doc_id.isNull().alias("none_"), *[c.alias(n) for n, c in key.items()], F.col("text").cast("string").alias("text"))
    prints = stored(chosen.mapInArrow(_fingerprints, "none_ boolean, id_ long, h1_ long, h2_ long, print long"), "prints")
    classes = stored(prints.groupBy("print").agg(F.min(F.struct("none_", *key)).alias("least")), "classes")
    roots = components(stored(links(classes).distinct(), "links"))
    named = classes.join(roots, classes.print == roots.node, "left").groupBy(F.coalesce("root", "print").alias("root")).agg(F.min("least").alias("least"))
    stay = named.select(*[f"least.{n}" for n in key])
    once = Window.partitionBy(*key).orderBy(F.xxhash64("row"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in key.items()])  # so no name of docs can clash
    return rows.join(stay, [*key], "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
