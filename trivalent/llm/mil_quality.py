"""A document-quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words, all of its text. Each passage is encoded by features of
its bytes and words (shares of character classes, word lengths, symbol-laden words, repetition within the passage
and across the document). A small network, trained here, embeds a passage, gives it a gated attention weight
(tanh and sigmoid branches), and scores the document by the attention-weighted mean of its passage embeddings; only
documents have labels. Weights are learned by Adam, on the driver, on a bounded, hash-chosen sample of labelled
documents (`sample` documents and `passages` passages at most, both parameters; a document that would go beyond ends
it); scoring covers every passage of every document, in the partition where the document is.

Defined cases: a null or empty text is one empty passage and gets a score like any other; null labels teach
nothing; a document labelled twice teaches twice; with labels of one class, or none, every score is that class's
share (a half without labels); an id that stands in several rows teaches by each of them; very long texts are scored
whole; an empty table has no rows; repeated rows each return; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.llm.common import LOWER, SOLID, mapped, spans, stored, text_slices, word_hashes

PASSAGE_WORDS = 50
SAMPLE = 6000
PASSAGES = 300_000
KEEP_SCORE = 0.7
FIELDS = "score double, n_passages long, top_passage long, top_weight double"

#: Classes of bytes: lower, upper, digit, blank, line end, hash, star, dollar, percent, ampersand, bar, angle, exclamation, sentence, other ASCII, beyond ASCII.
CLASSES = 16
_CLASS = np.full(256, 14, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 3, 4, 15
for _k, _chars in ((5, b"#"), (6, b"*"), (7, b"$"), (8, b"%"), (9, b"&"), (10, b"|"), (11, b"<>"), (12, b"!"), (13, b".,;:?")):
    _CLASS[list(_chars)] = _k
FEATURES = CLASSES + 7


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurred before, and whether it occurs twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return before, twice


def encode(raw: np.ndarray, at: np.ndarray, width: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The features of all passages of a slice of texts, and the n+1 borders of each text's passages."""
    starts, ends, border = spans(SOLID[raw], at)
    n = np.diff(border)
    passages = np.maximum(1, -(-n // width))
    first = np.concatenate([[0], np.cumsum(passages)])
    row = np.repeat(np.arange(len(n)), n)
    of = first[row] + (np.arange(len(starts)) - border[row]) // width
    total = int(first[-1])
    head = np.searchsorted(of, np.arange(total))
    empty = np.append(of, -1)[head] != np.arange(total)
    begin = np.append(starts, len(raw))[head]
    begin[first[:-1]] = at[:-1]
    begin[empty] = at[:-1][n == 0]
    sizes = np.diff(np.append(begin, len(raw)))
    counts = np.bincount(np.repeat(np.arange(total), sizes) * CLASSES + _CLASS[raw], minlength=total * CLASSES).reshape(total, CLASSES)
    x = np.zeros((total, FEATURES))
    x[:, :CLASSES] = counts / np.maximum(1, sizes)[:, None]
    words = np.maximum(1, np.bincount(of, minlength=total))
    mean = lambda values: np.bincount(of, values, minlength=total) / words
    length = (ends - starts).astype(float)
    x[:, CLASSES] = mean(length) / 10
    x[:, CLASSES + 1] = mean(np.minimum(length, 60) ** 2) / 100
    x[:, CLASSES + 2] = mean(~np.isin(_CLASS[raw[ends - 1]], (0, 1, 2, 13, 15)) if len(ends) else length)
    h = word_hashes(LOWER[raw], starts, ends)
    mix = np.uint64(0x9E3779B97F4A7C15)
    x[:, CLASSES + 3] = mean(_firsts(h * mix + of.astype(np.uint64))[0])
    three = h.copy()
    three[:-1] += (h[1:] ^ mix) * np.uint64(0xD6E8FEB86659FD93)
    three[:-2] += (h[2:] ^ mix) * np.uint64(0xCA9B0B3F8E5D2A17)
    three[:-1][row[1:] != row[:-1]] += mix
    x[:, CLASSES + 4] = mean(_firsts((three * mix) ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xCA9B0B3F8E5D2A17))[1])
    x[:, CLASSES + 5] = np.log1p(np.repeat(n, passages)) / 8
    x[:, CLASSES + 6] = words / width
    return x, first


class Model:
    """Gated-attention multiple-instance network; bags are runs of rows."""

    def __init__(self, inputs: int = FEATURES, hidden: int = 24, gate: int = 12, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"W": draw(inputs, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": np.zeros(gate), "c": draw(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(inputs), np.ones(inputs), None

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w, starts, n = self.w, first[:-1], np.diff(first)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        weight = e / np.repeat(np.add.reduceat(e, starts), n)
        z = np.add.reduceat(h * weight[:, None], starts, axis=0)
        return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -30, 30)))}

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, n = self._scaled(x), np.diff(first)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            f, w = self._forward(x, first), self.w
            d = (f["p"] - y) / len(y)
            dz = np.repeat(d[:, None] * w["c"], n, axis=0)
            da = (dz * f["h"]).sum(1)
            de = f["weight"] * (da - np.repeat(np.add.reduceat(f["weight"] * da, first[:-1]), n))
            dts = de[:, None] * w["a"]
            dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
            dh = (dz * f["weight"][:, None] + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "d": np.array([d.sum()])}
            for k, g in grads.items():
                g = g + decay * w[k]
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def predict(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and the attention weight of each passage."""
        f = self._forward(self._scaled(x), first)
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant), f["weight"]
        return f["p"], f["weight"]


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, passages: int = PASSAGES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on labelled documents for which learn holds, those of the least hash of the id: `sample` at most, of `passages` at most in all."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "y"]
    chosen = known.where(learn).orderBy(*order).limit(sample)
    bags = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(stored(chosen, "labelled")), "doc_id")  # at most `sample` rows

    def encoded(texts: pa.Array) -> list[pa.Array]:
        bags, n = [], []
        for _, _, raw, at in text_slices(texts):
            x, first = encode(raw, at)
            bags += [x[a:b].astype("<f4").tobytes() for a, b in zip(first, first[1:])]
            n += np.diff(first).tolist()
        return [pa.array(bags, pa.binary()), pa.array(n, pa.int64())]

    found = stored(mapped(bags, encoded, "x binary, n long", id_col=None).select("row.doc_id", "row.y", "n", "x"), "bags")
    order += ["n", "x"]
    few = found.orderBy(*order).limit(sample)  # an id that stands in many rows brings them all
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over `sample` rows at most
    rows = few.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= passages).select("doc_id", "y", "n", "x").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.n, r.x))
    if not rows:
        return Model().fit(np.zeros((0, FEATURES)), np.zeros(1, int), np.zeros(0))
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model().fit(np.concatenate(bags).astype(float), first, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """score, n_passages, and the passage of most attention with its weight, beside the id or, without id_col, the whole row."""

    def each(texts: pa.Array) -> list[pa.Array]:
        scores, n, top, most = [np.zeros(0)], [np.zeros(0, np.int64)], [], []
        for _, _, raw, at in text_slices(texts):
            x, first = encode(raw, at)
            p, weight = model.predict(x, first)
            scores.append(p)
            n.append(np.diff(first))
            best = [int(np.argmax(weight[a:b])) for a, b in zip(first, first[1:])]
            top += best
            most += weight[first[:-1] + np.array(best)].tolist()
        return [pa.array(np.concatenate(scores)), pa.array(np.concatenate(n)), pa.array(top, pa.int64()), pa.array(most, pa.float64())]

    return mapped(docs, each, FIELDS, id_col, text_col)


def keep_good(docs: DataFrame, model: Model, least: float = KEEP_SCORE) -> DataFrame:
    return score(docs, model, id_col=None).where(F.col("score") >= least).select("row.*")
