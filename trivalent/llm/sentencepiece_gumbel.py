"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has an edge for each vocabulary piece that stands in it (and, for a character that is no piece,
one edge of its byte pieces). Pieces have Zipf log-probabilities by their rank in the vocabulary, so each whole
segmentation has a probability, and the k segmentations of the largest Gumbel-perturbed log-probabilities are a
sample of k without replacement.

The perturbed A-star search finds them without listing segmentations. A node is a set of segmentations: a prefix of
pieces, with some next pieces excluded; its bound is the largest perturbed value in it, which is drawn, not searched:
a Gumbel variable at the log-probability of the set, truncated at the bound of the node it was split from. Taking
the node of the highest bound fixes one segmentation that attains it, drawn by forward sampling with backward
probabilities; what is left of the node falls apart into one node for each piece of the segmentation (same prefix,
another next piece), each with a bound of its own. The search takes k nodes. The bound of the next, kappa, gives the
inclusion score, the log of 1 - exp(-exp(log_prob - kappa)): the estimated log-probability that a segmentation with
this log_prob is in the sample.

No piece crosses from a non-space to a space, so a text's lattice is a chain of lattices of its words. These are built
once for each distinct word of a slice of texts with numpy; a worker keeps those of words that recur, up to a bound.
All texts of a slice are searched side by side: a round takes one node of each text's agenda, finishes the word in
which it splits off, and walks the words after it. All random numbers are hashes of (seed, row key, sample, word,
step): a row's sample is the same wherever it runs.

Memory: a slice is `SLICE_CHARS` characters of whole texts, or one longer text; arrays are of its size.

Defined cases: a null or empty text has the one empty segmentation; a text with fewer than k segmentations returns all
of them; a null row key is a key of its own; repeated rows return the same samples; very long texts are searched whole; an
empty table has no rows; extra columns, whatever their names, are not read by sample and come back from decode, but for one
named `decoded`, which is replaced; null ids decode to null.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import HashIndex, _powers, ranges, release, slices

SPACE = "▁"
SAMPLES = 3
SEED = 20
ZIPF_SHIFT = 10.0
SLICE_CHARS = 1 << 18
SAMPLE_TYPE = "struct<n_pieces:long,ids_crc32:long,log_prob:double,perturbed:double,log_inclusion:double,ids:array<int>>"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_UNIT_LINES = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: No Gumbel variable drawn here is further than this above its mean: uniform() is at most 1 - 2^-53.
REACH = 37.0
#: Steps whose bounds are drawn together.
CHUNK = 256
#: Words and edges at most whose lattices a worker keeps between slices.
KEPT_WORDS, KEPT_EDGES = 50_000, 1_500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of each number."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1."""
    return ((mixed(x) >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def _finish(h: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Spread the polynomial hash of a run of characters over all bits."""
    h = h + np.uint64(length) if isinstance(length, int) else h + length.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= _M1
    return h ^ (h >> np.uint64(29))


def _hash_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return _finish((total[ends] - total[starts]) * down[starts], ends - starts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Pieces:
    """The vocabulary of a SentencePiece model file, with Zipf log-probabilities by rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in normal]
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in texts):
            raise ValueError("a piece goes across a space")
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.of_byte = np.array([self.byte_ids.get(b, 0) for b in range(256)], np.int32)
        self.surface = {i: t.encode() for i, t in zip(normal, texts, strict=True)} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        written = [self.surface.get(i, b"") for i in range(n)]
        self.sizes = np.array([len(x) for x in written], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(written), np.uint8)
        self.ids = np.array(normal, np.int32)
        self.lines = not any("\n" in t for t in texts)
        heads = list(dict.fromkeys(t[:n] for t in texts for n in range(1, len(t) + 1)))
        sizes = np.array([len(t) for t in heads])
        ends = np.cumsum(sizes)
        self.index = HashIndex(_hash_runs(_codes("".join(heads)), ends - sizes, ends))  # of all beginnings of pieces
        place = {t: i for i, t in enumerate(heads)}
        self.piece_of = np.full(len(heads) + 1, -1, np.int32)  # which piece a beginning is, if it is one
        self.piece_of[[place[t] + 1 for t in texts]] = np.arange(len(texts))
        self.longest = max(len(t) for t in texts)
        weight = np.log(np.arange(len(normal) + 256) + ZIPF_SHIFT)  # pieces are in the order of their rank
        norm = np.log(np.exp(-weight).sum())
        self.log_prob = -weight[: len(normal)] - norm
        self.byte_log_prob = float(-weight[-1] - norm)

    def words(self, text: str) -> list[str]:
        """The stretches of a text that no piece goes across."""
        if not text:
            return []
        if not self.lines:
            return _UNIT.findall(SPACE + text.replace(" ", SPACE))
        if "  " in text or SPACE in text or text[0] == " ":
            return _UNIT_LINES.findall(SPACE + text.replace(" ", SPACE))
        return [w for w in (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ") if w]

    def written(self, ids: np.ndarray) -> bytes:
        """The pieces end to end, in UTF-8."""
        return self.letters[ranges(self.places[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.written(ids).decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


class Lattice:
    """The lattices of distinct words, end to end, in buffers that grow. A word has a place before each of its characters and one after
    the last, which no edge leaves. The edges of a place stand together, those of long pieces first: they are the likeliest."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.n_words = self.n_places = self.n_edges = 0
        self.start = self.stop = np.empty(0, np.int32)  # by word
        self.border = np.zeros(1, np.int32)  # by place: its first edge
        self.total = np.empty(0)
        self.end = self.piece = np.empty(0, np.int32)  # by edge; a piece below zero is a character in bytes
        self.log = self.share = np.empty(0)  # its log-probability given its place, and the sum of probabilities up to it

    def _write(self, name: str, at: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if len(old) < at + len(values):
            setattr(self, name, np.empty(max(at + len(values), len(old) * 5 // 4), old.dtype))
            getattr(self, name)[:at] = old[:at]
        getattr(self, name)[at : at + len(values)] = values

    def keep(self, words: int) -> None:
        """Forget all but the first so many words."""
        self.n_words = words
        self.n_places = int(self.stop[words - 1]) + 1 if words else 0
        self.n_edges = int(self.border[self.n_places])

    def add(self, words: list[str]) -> None:
        if not words:
            return
        pieces = self.pieces
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = _codes("".join(words))
        n = len(codes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
        place_of = np.arange(n) + np.repeat(np.arange(len(words)), sizes)
        up = _powers(pieces.longest + 1)[0]
        plus = codes.astype(np.uint64) + np.uint64(1)
        hashed, at = np.zeros(n, np.uint64), np.arange(n)
        degree = np.zeros(n, np.int64)
        begins, found = [], []
        lone = np.zeros(0, np.int64)
        for length in range(1, pieces.longest + 1):
            if length > 1:
                fits = room[at] >= length
                at, hashed = at[fits], hashed[fits]
            if not len(at):
                break
            hashed = hashed + plus[at + (length - 1)] * up[length - 1]
            head = pieces.index(_finish(hashed, length))
            piece = pieces.piece_of[head]
            hit = np.flatnonzero(piece >= 0)
            begins.append(at[hit])
            found.append(piece[hit])
            degree[begins[-1]] += 1
            if length == 1:
                lone = np.flatnonzero(piece < 0)
                degree[lone] += 1
            begun = np.flatnonzero(head)
            at, hashed = at[begun], hashed[begun]
        leaving = np.zeros(n + len(words), np.int64)
        leaving[place_of] = degree
        border = np.concatenate([[0], np.cumsum(leaving)])
        edges = int(border[-1])
        end, which, raw = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        free = border[place_of]
        for length in range(len(begins), 0, -1):
            at, piece = begins[length - 1], found[length - 1]
            slot = free[at]
            end[slot], which[slot], raw[slot] = place_of[at] + length, piece, pieces.log_prob[piece]
            free[at] += 1
        slot = free[lone]
        end[slot], which[slot], raw[slot] = place_of[lone] + 1, -codes[lone].astype(np.int64) - 1, pieces.byte_log_prob * utf8_size(codes[lone])
        back = np.zeros(n + len(words))
        log, share = np.empty(edges), np.empty(edges)
        by_room = np.argsort(room.astype(np.uint16) if room.max() < 1 << 16 else room, kind="stable")
        counts = np.bincount(room)[1:]
        stops = np.cumsum(counts)
        for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):  # from the last characters of words backwards
            many = degree[by_room[a:b]]
            place = place_of[by_room[a:b]]
            edge = ranges(border[place], many)
            value = raw[edge] + back[end[edge]]
            first = np.cumsum(many) - many
            top = np.maximum.reduceat(value, first)
            part = np.exp(value - np.repeat(top, many))
            whole = np.add.reduceat(part, first)
            back[place] = top + np.log(whole)
            share[edge] = part / np.repeat(whole, many)
            log[edge] = np.where(np.repeat(many, many) > 1, np.minimum(value - np.repeat(back[place], many), -1e-300), 0.0)
        place, nth = np.flatnonzero(leaving > 1), 1
        while len(place):
            edge = border[place] + nth
            share[edge] += share[edge - 1]
            nth += 1
            place = place[leaving[place] > nth]
        total = np.zeros(n + len(words))
        total[place_of] = share[border[place_of + 1] - 1]
        starts = np.cumsum(sizes + 1) - sizes - 1
        self._write("start", self.n_words, starts + self.n_places)
        self._write("stop", self.n_words, starts + sizes + self.n_places)
        self._write("border", self.n_places, border + self.n_edges)
        self._write("total", self.n_places, total)
        for name, values in (("end", end + self.n_places), ("piece", which), ("log", log), ("share", share)):
            self._write(name, self.n_edges, values)
        self.n_words, self.n_places, self.n_edges = self.n_words + len(words), self.n_places + n + len(words), self.n_edges + edges

    def place_of(self, edge: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.border[: self.n_places + 1], edge, "right") - 1

    def choose(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each place, by its conditional probability."""
        edge = self.border[place]
        goal = u * self.total[place]
        more = np.flatnonzero(self.share[edge] < goal)
        while len(more):
            edge[more] += 1
            more = more[self.share[edge[more]] < goal[more]]
        return edge

    def walk(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A segmentation of each word: edges, words in order, and the n+1 borders."""
        place, stop, live = self.start[words], self.stop[words], np.arange(len(words))
        counts = np.zeros(len(words) + 1, np.int64)
        steps, owners = [], []
        while len(live):
            edge = self.choose(place, uniform(keys))
            steps.append(edge)
            owners.append(live)
            counts[live + 1] += 1
            place = self.end[edge]
            more = np.flatnonzero(place < stop)
            place, stop, live, keys = place[more], stop[more], live[more], keys[more] + _M2
        border = np.cumsum(counts)
        edges = np.empty(border[-1], np.int32)
        for i, (edge, owner) in enumerate(zip(steps, owners, strict=True)):
            edges[border[owner] + i] = edge
        return edges, border


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def log_exponential(u: np.ndarray) -> np.ndarray:
    """The log of an exponential variable: less it, a mean becomes a Gumbel variable."""
    return np.log(-np.log(u))


def truncated(mean: np.ndarray, bound: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel variables at mean, truncated at bound, from log_exponential noise."""
    return mean - np.logaddexp(mean - bound, noise)


class Draws:
    """Uniform numbers for rows, one after the other for each."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.n = keys ^ _M1, np.zeros(len(keys), np.uint64)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        self.n[rows] += np.uint64(1)
        return uniform(self.keys[rows] + self.n[rows] * _STEP)


class Paths:
    """One segmentation of each text: a stretch of an earlier one, new steps that finish the word where it splits off, and a walk of the later words."""

    def __init__(self, lattice: Lattice, of: np.ndarray, border: np.ndarray, keys: np.ndarray, split: Split, earlier: list[Paths]) -> None:
        self.split = split
        words = border[1:] - split.word
        self.occurrences = ranges(split.word, words)
        walked, self.word_border = lattice.walk(of[self.occurrences], mixed(keys[self.occurrences]))
        self.walk_border = self.word_border[np.concatenate([[0], np.cumsum(words)])]
        n = np.diff(self.walk_border)
        self.steps = split.keep + split.n_new + n
        self.border = np.concatenate([[0], np.cumsum(self.steps)])
        self.edges = np.empty(self.border[-1], np.int32)
        for i, path in enumerate(earlier):
            rows = np.flatnonzero((split.parent == i) & (split.keep > 0))
            self.edges[ranges(self.border[rows], split.keep[rows])] = path.edges[ranges(path.border[rows], split.keep[rows])]
        at = self.border[:-1] + split.keep
        self.edges[ranges(at, split.n_new)] = split.new
        self.edges[ranges(at + split.n_new, n)] = walked

    def word_at(self, rows: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The word, among all of the slice, that a step of a text is in."""
        own = step - self.split.keep[rows] - self.split.n_new[rows]
        at = np.searchsorted(self.word_border, self.walk_border[rows] + np.maximum(own, 0), "right") - 1
        return np.where(own < 0, self.split.word[rows] - 1, np.append(self.occurrences, 0)[np.minimum(at, len(self.occurrences))])

    def draw_bounds(self, lattice: Lattice, keys: np.ndarray, bound: np.ndarray, best: np.ndarray, k: int) -> None:
        """Draw the bounds of the nodes that the paths leave behind, a step each. A later step's mean is no higher than the prefix before it; once
        that is too far below the k best bounds known for any draw to reach them, the steps from there on can't be taken, and are left out."""
        self.first = self.split.keep + (self.split.n_new > 0)  # what else could follow where a path splits off is a node of its parent's
        step, before = self.first.copy(), self.split.before.copy()
        self.slot = np.concatenate([[0], np.cumsum(np.maximum(self.steps - self.first, 0) + 1)])  # the first of a row is no step, so that none is empty
        self.values, self.prefixes = np.full(self.slot[-1], -np.inf), np.zeros(self.slot[-1])
        self.best = np.full((len(step), k), -np.inf)
        rows = np.flatnonzero(bound > -np.inf)
        while len(rows := rows[(step[rows] < self.steps[rows]) & (before[rows] + REACH >= best[rows].min(1))]):
            each = step[rows, None] + np.arange(min(CHUNK, int((self.steps[rows] - step[rows]).max())))
            inside = each < self.steps[rows, None]
            log = np.where(inside, lattice.log[self.edges[np.where(inside, self.border[rows, None] + each, 0)]], 0.0)
            prefix = np.cumsum(np.concatenate([before[rows, None], log], axis=1), axis=1)
            with np.errstate(divide="ignore"):
                others = np.log(-np.expm1(log))  # of an edge that has no fellows, and beyond the end, nothing
            value = truncated(prefix[:, :-1] + others, bound[rows, None], log_exponential(uniform(keys[rows, None] + each.astype(np.uint64) * _M2)))
            slot = (each + (self.slot[rows] - self.first[rows] + 1)[:, None])[inside]
            self.values[slot], self.prefixes[slot] = value[inside], prefix[:, :-1][inside]
            before[rows] = prefix[:, -1]
            step[rows] += each.shape[1]
            self.best[rows], best[rows] = _best(self.best[rows], value, k), _best(best[rows], value, k)
        self.top = np.maximum.reduceat(self.values, self.slot[:-1])

    def highest(self, rows: np.ndarray) -> np.ndarray:
        """The slot of the highest bound of each row."""
        n = np.diff(self.slot)[rows]
        slot = ranges(self.slot[rows], n)
        at = np.flatnonzero(self.values[slot] == np.repeat(self.top[rows], n))
        return slot[at[np.searchsorted(at, np.cumsum(n) - n)]]

    def lower(self, rows: np.ndarray, slot: np.ndarray, value: np.ndarray) -> None:
        """A node was taken: what is left of it has this bound."""
        self.values[slot] = value
        self.best[rows, self.best[rows].argmax(1)] = value
        n = np.diff(self.slot)[rows]
        if len(rows):
            self.top[rows] = np.maximum.reduceat(self.values[ranges(self.slot[rows], n)], np.cumsum(n) - n)


class Split:
    """Where each text's next segmentation begins: after `keep` steps of the paths `parent`, with new steps, and from which word on it is free."""

    def __init__(self, n: int, word: np.ndarray) -> None:
        self.parent = np.full(n, -1)
        self.keep, self.n_new = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.new, self.before = np.zeros(0, np.int32), np.zeros(n)
        self.word = word


def _best(known: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row."""
    both = np.concatenate([known, values], axis=1)
    return np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


def search(lattice: Lattice, of: np.ndarray, border: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray, np.ndarray]:
    """The perturbed A-star search of texts whose words are of[border[i]:border[i + 1]]: k paths of each, their bounds (-inf where there is
    no further segmentation), and the bound of the node that would come next."""
    n = len(keys)
    row = np.repeat(np.arange(n), np.diff(border))
    base = mixed(keys[row] ^ (np.arange(len(of)) - border[row]).astype(np.uint64) * _STEP)
    draws = Draws(keys)
    bound = -log_exponential(draws(np.arange(n)))
    split = Split(n, border[:-1])
    paths: list[Paths] = []
    bounds, taken = [], []
    while True:
        r = len(paths)
        path = Paths(lattice, of, border, base + np.uint64(r), split, paths)
        best = np.full((n, k), -np.inf)
        for p in paths:
            best = _best(best, p.best, k)
        path.draw_bounds(lattice, mixed(keys ^ np.uint64((r + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)), bound, best, k)
        paths.append(path)
        bounds.append(bound)
        tops = np.stack([p.top for p in paths], axis=1)
        parent, bound = tops.argmax(1), tops.max(1)
        if len(paths) == k or not (rows := np.flatnonzero(bound > -np.inf)).size:
            return paths, np.stack(bounds, axis=1), bound
        parent = parent[rows]

        def of_parent(value) -> np.ndarray:
            """value(path, rows, places among rows), each row's from its parent."""
            parts = [(at, value(p, rows[at], at)) for i, p in enumerate(paths) if len(at := np.flatnonzero(parent == i))]
            out = np.empty(len(rows), np.result_type(*[v for _, v in parts]))
            for at, v in parts:
                out[at] = v
            return out

        slot = of_parent(lambda p, rows, _: p.highest(rows))
        step = of_parent(lambda p, rows, at: p.first[rows] + slot[at] - p.slot[rows] - 1)
        prefix = of_parent(lambda p, rows, at: p.prefixes[slot[at]])
        old = of_parent(lambda p, rows, at: p.edges[p.border[rows] + step[at]])
        word = of_parent(lambda p, rows, at: p.word_at(rows, step[at]))
        place = lattice.place_of(old)
        first, many = lattice.border[place], np.diff(lattice.border)[place]
        nth = np.arange(many.max())
        option = first[:, None] + nth
        free = (nth < many[:, None]) & (option != old[:, None])
        for seen_parent, seen_step, seen_edge in taken:
            free &= ~((seen_parent[rows] == parent) & (seen_step[rows] == step))[:, None] | (option != seen_edge[rows][:, None])
        share = np.where(free, np.exp(lattice.log[np.where(free, option, 0)]), 0.0)
        sums = np.cumsum(share, axis=1)
        pick = (free & (sums >= (draws(rows) * sums[:, -1])[:, None])).argmax(1)
        new = option[np.arange(len(rows)), pick]
        left = np.cumsum(np.where(nth == pick[:, None], 0.0, share), axis=1)[:, -1]
        with np.errstate(divide="ignore"):
            again = truncated(prefix + np.log(left), bound[rows], log_exponential(draws(rows)))
        for i, p in enumerate(paths):
            at = np.flatnonzero(parent == i)
            p.lower(rows[at], slot[at], again[at])
        seen = np.full((3, n), -1)
        seen[:, rows] = parent, step, new
        taken.append(tuple(seen))
        stop, steps = lattice.stop[of[word]], [new]
        at, live = lattice.end[new], np.arange(len(rows))
        while len(live := live[at[live] < stop[live]]):
            edge = lattice.choose(at[live], draws(rows[live]))
            at[live] = lattice.end[edge]
            steps.append(np.full(len(rows), -1))
            steps[-1][live] = edge
        steps = np.stack(steps, axis=1)
        split = Split(n, border[1:].copy())
        split.parent[rows], split.keep[rows], split.n_new[rows] = parent, step, (steps >= 0).sum(1)
        split.new = steps[steps >= 0].astype(np.int32)
        split.before[rows], split.word[rows] = prefix + lattice.log[new], word + 1


class Words(dict):
    """Numbers of words, given as they are first met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Sampler:
    """Samples slices of texts; keeps the lattices of words that stood twice in a slice, until there are enough of them."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.lattice, self.known = pieces, Lattice(pieces), Words()

    def __call__(self, texts: list[str], keys: np.ndarray, k: int) -> dict[str, np.ndarray]:
        """By text and sample, best first: present, n (pieces), log_prob, perturbed and log_inclusion; and for each sample the ids of all texts."""
        kept, before = self.lattice.n_words, self.lattice.n_edges
        units, counts = [], []
        for text in texts:
            words = self.pieces.words(text)
            units.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        of = np.concatenate([*units, np.zeros(0, np.int64)])
        names = list(self.known)[kept:]
        often = np.bincount(of, minlength=len(self.known))[kept:] > 1
        order = np.argsort(~often, kind="stable")  # words that recur first
        renamed = np.arange(len(self.known))
        renamed[kept + order] = np.arange(kept, len(self.known))
        names = [names[i] for i in order.tolist()]
        self.lattice.add(names)
        found = self._found(renamed[of], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), keys, k)
        stay = min(int(often.sum()), KEPT_WORDS - kept) if before < KEPT_EDGES else 0
        self.lattice.keep(kept + stay)
        for name in names:
            del self.known[name]
        for name in names[:stay]:
            self.known[name]  # numbered anew, in the lattice's order
        return found

    def _found(self, of: np.ndarray, border: np.ndarray, keys: np.ndarray, k: int) -> dict[str, np.ndarray]:
        paths, bounds, kappa = search(self.lattice, of, border, keys, k)
        log_prob, n, ids = np.zeros(bounds.shape), np.zeros(bounds.shape, np.int64), []
        for r, path in enumerate(paths):
            some = np.flatnonzero(path.steps)
            if len(some):
                log_prob[some, r] = np.add.reduceat(self.lattice.log[path.edges], path.border[some])
            own, at = self.ids_of(self.lattice.piece[path.edges])
            n[:, r] = np.diff(at[path.border])
            ids.append(own)
        present = bounds > -np.inf
        gap = np.where(present, log_prob, 0.0) - np.where(kappa == -np.inf, 0.0, kappa)[:, None]
        with np.errstate(over="ignore"):
            inclusion = np.where(gap > -30, np.log(-np.expm1(-np.exp(np.clip(gap, -30, 50)))), gap)
        return {"present": present, "n": n, "log_prob": log_prob, "perturbed": bounds, "log_inclusion": np.where((kappa == -np.inf)[:, None], 0.0, inclusion), "ids": ids}

    def ids_of(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's ids of pieces, characters in bytes spelled out, and where each piece's begin."""
        lone = np.flatnonzero(piece < 0)
        if not len(lone):
            return self.pieces.ids[piece], np.arange(len(piece) + 1)
        codes = -(piece[lone].astype(np.int64) + 1)
        n = np.ones(len(piece), np.int64)
        n[lone] = utf8_size(codes)
        at = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(at[-1], np.int32)
        normal = np.flatnonzero(piece >= 0)
        out[at[normal]] = self.pieces.ids[piece[normal]]
        spelled = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out[ranges(at[lone], n[lone])] = self.pieces.of_byte[np.frombuffer(spelled, np.uint8)]
        return out, at


def sample_slice(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int) -> list[list[tuple]]:
    """For each text its samples, best first: (ids, log_prob, perturbed, log_inclusion)."""
    found = Sampler(pieces)(texts, keys, k)
    ends = np.cumsum(found["n"], axis=0)
    one = lambda i, r: (found["ids"][r][ends[i, r] - found["n"][i, r] : ends[i, r]], *[float(found[x][i, r]) for x in ("log_prob", "perturbed", "log_inclusion")])
    return [[one(i, r) for r in np.flatnonzero(found["present"][i]).tolist()] for i in range(len(texts))]


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    """A key for each row, from its id and the seed."""
    values = np.array([0x5EED if x is None else x for x in ids.to_pylist()], np.int64).view(np.uint64)
    return mixed(values ^ mixed(np.full(len(values), seed, np.uint64) + np.array([x is None for x in ids.to_pylist()], np.uint64)))


_SAMPLERS: dict[str, Sampler] = {}


def sampler_of(model: str) -> Sampler:
    """This worker's sampler for a model file."""
    if model not in _SAMPLERS:
        _SAMPLERS[model] = Sampler(pieces_of(model))
    return _SAMPLERS[model]


def _as_arrow(found: dict, texts: list[str], pieces: Pieces, with_ids: bool) -> tuple[pa.Array, pa.Array]:
    """The samples as a list of structs for each text, and whether all of them decode to it."""
    present, n = found["present"], found["n"]
    plain = [(SPACE + text.replace(" ", SPACE)).encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    whole, sizes = b"".join(plain), np.array([len(x) for x in plain])
    crc, same = np.zeros(n.shape, np.int64), np.ones(len(texts), bool)
    ends = np.cumsum(n, axis=0)
    for r, ids in enumerate(found["ids"]):
        raw = memoryview(ids.astype("<u4").tobytes())
        crc[:, r] = [zlib.crc32(raw[4 * (b - m) : 4 * b]) for b, m in zip(ends[:, r].tolist(), n[:, r].tolist(), strict=True)]
        written, there = pieces.written(ids), present[:, r]
        if written != whole or not there.all():
            length = np.concatenate([[0], np.cumsum(pieces.sizes[ids])])
            at = length[np.concatenate([[0], ends[:, r]])].tolist()
            same &= [not t or written[a:b] == x for t, a, b, x in zip(there.tolist(), at, at[1:], plain, strict=False)]
    lengths = n[present]
    if with_ids:
        stops = np.cumsum(lengths)
        starts = np.zeros(n.shape, np.int64)
        starts[present] = stops - lengths
        values = np.empty(lengths.sum(), np.int32)
        for r, ids in enumerate(found["ids"]):
            values[ranges(starts[:, r], n[:, r])] = ids
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(values))
    else:
        listed = pa.nulls(len(lengths), pa.list_(pa.int32()))
    columns = [pa.array(lengths), pa.array(crc[present]), *[pa.array(found[x][present]) for x in ("log_prob", "perturbed", "log_inclusion")], listed]
    rows = pa.StructArray.from_arrays(columns, ["n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(present.sum(1))]), pa.int32()), rows), pa.array(same)


def sample(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, samples (best first) and round_trip: whether every sample decodes to the text (with the space sign as a space)."""

    def run(batches):
        sampler = sampler_of(model)
        for batch in batches:
            keys = row_keys(batch.column(0), seed)
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                samples, same = _as_arrow(sampler(texts, keys[a:b], k), texts, sampler.pieces, ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), samples, same], names=["doc_id", "samples", "round_trip"])
            release()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, samples array<{SAMPLE_TYPE}>, round_trip boolean")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows with the text that the piece ids stand for, as the column decoded."""
    from pyspark.sql import types as T

    encoded = encoded.drop("decoded")

    def run(batches):
        pieces = pieces_of(model)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
