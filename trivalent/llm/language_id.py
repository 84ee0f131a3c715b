"""Language identification by rank-order n-gram profiles.

A profile is the K most frequent letter n-grams (one to three letters, with word borders; ties by code point) in
rank order. Language profiles come from a bounded, hash-chosen sample of labelled documents of each language
(`per_language`, a parameter). A document's own profile, of its whole text, is compared to each by the
out-of-place distance: how far each of its n-grams is from its rank in the language's profile, or K if it isn't
there. The least distance wins; ties go to the first name.

The score is d2 / (d1 + d2) for the least and second-least distance: a half when they can't be told apart, one
for a perfect fit. It is 0 for `und`.

Defined cases: a null text, or one without a letter, is `und`; with nothing learned every text is; rows with null
labels, texts or ids teach nothing; an id that stands in several rows teaches by each; very long texts count whole;
an empty table has no rows; repeated rows each return; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.llm.common import mapped, stored

TOP = 300
PER_LANGUAGE = 1500
UNKNOWN = "und"
FIELDS = "lang_pred string, score double, distance double"

_OTHER: list[np.ndarray] = []


def no_letters() -> np.ndarray:
    """Whether each code point is something else than a letter."""
    if not _OTHER:
        _OTHER.append(np.array([not chr(i).isalpha() for i in range(0x110000)]))
    return _OTHER[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed, ascending, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[no_letters()[codes.astype(np.int64)]] = 0
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    codes = np.concatenate([np.zeros(1, np.uint64), codes[keep], np.zeros(1, np.uint64)])
    if len(codes) > 2 and codes[-2] == 0:
        codes = codes[:-1]
    if not codes.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = (codes[:-2] << np.uint64(42) | two[1:])[codes[1:-1] > 0]
    grams = np.sort(np.concatenate([codes[codes > 0] | np.uint64(3 << 62), two | np.uint64(1 << 63), three]))
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def profile(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:top]]


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether a row is of the fold that must not be learned from."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % folds == fold


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The profile of each language, from the documents of at most per_language ids of each, those of the least hash."""
    base = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    hashed = base.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    # hashes are evenly spread: the least four times as many as wanted are in this part of their range, so few of each language reach one task
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))  # a row for each language
    part = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    near = hashed.select("lang", "h").join(F.broadcast(stored(sizes, "languages")), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= part)
    least = Window.partitionBy("lang").orderBy("h")
    cuts = near.groupBy("lang", "h").count().withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= per_language).groupBy("lang").agg(F.max("h").alias("cut"))
    sample = hashed.join(F.broadcast(stored(cuts, "cuts")), "lang").where("h <= cut").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for lang in np.unique(langs).tolist() if len(langs) else []:
                pairs = [ngrams(batch.column(1)[int(i)].as_py()) for i in np.flatnonzero(langs == lang)]
                grams, of = np.unique(np.concatenate([g for g, _ in pairs]), return_inverse=True)
                n = np.bincount(of, np.concatenate([c for _, c in pairs]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # unsigned order of the packed n-grams, as in a document's profile
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    rows = grams.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= top).select("lang", "gram", "nth").collect()
    learned: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        learned.setdefault(r.lang, []).append((r.nth, r.gram))
    return {lang: np.array([g for _, g in sorted(found)], np.int64).view(np.uint64) for lang, found in sorted(learned.items())}


class Identifier:
    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP) -> None:
        self.names, self.top = list(profiles), top
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for i, grams in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.grams, grams), i] = np.arange(len(grams))

    def __call__(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, score and mean out-of-place distance (as a share of K)."""
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0, None
        own = profile(grams, counts, self.top)
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        there = self.ranks[at]
        out = np.where(there < 0, self.top, np.minimum(np.abs(there - np.arange(len(own))[:, None]), self.top)).sum(0) / (self.top * len(own))
        order = np.argsort(out, kind="stable")
        best = float(out[order[0]])
        second = float(out[order[1]]) if len(order) > 1 else 1.0
        return self.names[order[0]], second / (best + second) if best + second else 0.5, best


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred, score and distance of every row, beside its id or, without id_col, the whole row."""
    known = Identifier(profiles, top)

    def each(texts: pa.Array) -> list[pa.Array]:
        found = [known(x.as_py()) for x in texts]
        return [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))]

    return mapped(docs, each, FIELDS, id_col, text_col)


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Rows whose language is identified: no `und`, and nearer than 1.0, the distance of a text that shares no n-gram with any profile."""
    return identify(docs, profiles, id_col=None).where((F.col("lang_pred") != UNKNOWN) & (F.col("distance") < 1)).select("row.*")
