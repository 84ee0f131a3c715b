"""Token ids of whole texts, each distinct piece between ASCII white space encoded once by the tokenizers library.

ASCII white space ends every pre-token of the word-level vocabulary, so a text's ids are those of its pieces in
order; tests hold this against the library on whole texts. A vocabulary of another kind (told by its normalizer,
pre-tokenizer and post-processor) is not cut: its whole texts go to the library. Arrow cuts a MB of texts at a
time and numbers their distinct pieces, so Python looks up each of those once, and numpy lays out the ids of all.
The memory has two generations of `remember` pieces: when the younger is full it becomes the older, from which
pieces that recur come back.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trivalent.llm.common import SLICE_BYTES, ranges, slices


#: The byte-level alphabet of the vocabulary: printable bytes stand for themselves, the others for the code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
#: Bytes of words, each as the code point of the same number, to that alphabet; a blank stays between words.
_SPELLED = {b: c for b, c in _ALPHABET.items() if b != 32}
#: Lower-case Latin letters, which normalising leaves alone, and marks that compose with nothing.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c)
_WORD = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[.,;:!?#$%&*]*)$"


def word_level(tokenizer) -> bool:
    """Whether this is a vocabulary whose pre-tokens end at white space and whose case is dropped, so that texts may be encoded by pieces."""
    import json

    made = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
    model = made["model"]
    return steps == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") == "</w>" and (made.get("pre_tokenizer") or {}).get("type") == "Sequence"


class Memory:
    """Numbers pieces from 0, which is the empty one, and holds their ids one after another."""

    def __init__(self, dtype: np.dtype) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.ids = np.zeros(1 << 16, dtype)
        self.starts = np.zeros(1 << 14, np.int64)  # of a number's ids; where the last one's end, the next start says

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, or -1."""
        return np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """Pieces, distinct and new, and how many of ids each has."""
        n = len(self.numbers)
        ends = self.starts[n] + np.cumsum(counts)
        if len(pieces):
            self.ids, self.starts = _room(self.ids, ends[-1]), _room(self.starts, n + len(pieces) + 1)
            self.ids[ends[-1] - len(ids) : ends[-1]] = ids
            self.starts[n + 1 : n + len(pieces) + 1] = ends
            self.numbers.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces in order, and how many each has."""
        starts = self.starts[numbers]
        counts = self.starts[numbers + 1] - starts
        return self.ids[ranges(starts, counts)], counts


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, with room for n at least."""
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    def __init__(self, path: str, special_as_text: bool = False, remember: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.by_piece = word_level(self.tokenizer)
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ending[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.remember = remember
        self.known, self.older = Memory(self.dtype), Memory(self.dtype)

    def _whole(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _numbers(self, pieces: list[bytes], learn, turn: bool = False) -> np.ndarray:
        """The numbers of distinct pieces; those in neither generation go to learn first. turn: the generation may end here."""
        found = self.known.find(pieces)
        if turn and len(self.known.numbers) + np.count_nonzero(found < 0) > self.remember:
            self.known, self.older = Memory(self.dtype), self.known
            found = self.known.find(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            missed = [pieces[i] for i in new.tolist()]
            again = self.older.find(missed)
            back = np.flatnonzero(again >= 0)
            self.known.add([missed[i] for i in back.tolist()], *self.older.ids_of(again[back]))
            learn([missed[i] for i in np.flatnonzero(again < 0).tolist()])
            found[new] = self.known.find(missed)
        return found

    def _learn(self, pieces: list[bytes]) -> None:
        """Lower-case Latin words, with or without marks after them, are one pre-token and one of marks, which normalising leaves alone.
        Others, once in lower case, may be such words; the rest go to the library as they stand."""
        rest = self._learn_words(pieces, pa.array(pieces, pa.binary()).cast(pa.string()))
        rest = self._learn_words(rest, pa.array([p.decode("utf-8").lower() for p in rest], pa.string()))
        self._learn_whole(rest)

    def _learn_whole(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 10_000):
            some = pieces[i : i + 10_000]
            ids = self._whole([p.decode("utf-8") for p in some])
            self.known.add(some, np.concatenate(ids), np.array([len(x) for x in ids]))

    def _learn_words(self, pieces: list[bytes], texts: pa.Array) -> list[bytes]:
        """Learns the pieces whose texts are words; returns the others."""
        parts = pc.extract_regex(texts, _WORD)
        is_word = parts.is_valid().to_numpy(zero_copy_only=False)
        parts = parts.drop_null()
        numbers = []
        for column, learn in zip(parts.flatten(), (self._learn_letters, self._learn_whole), strict=True):
            column = column.dictionary_encode()
            numbers.append(self._numbers(_bytes(column.dictionary), learn)[column.indices.to_numpy()])
        ours = [pieces[i] for i in np.flatnonzero(is_word).tolist()]
        both = np.stack(numbers, 1)[new := np.flatnonzero(self.known.find(ours) < 0)]  # a word without marks is known by now
        ids, counts = self.known.ids_of(both.ravel())
        self.known.add([ours[i] for i in new.tolist()], ids, counts.reshape(-1, 2).sum(1))
        return [pieces[i] for i in np.flatnonzero(~is_word).tolist()]

    def _learn_letters(self, words: list[bytes]) -> None:
        """The model takes many words at once. Where one ends in its ids, a piece that ends a word says."""
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            spelled = b" ".join(some).decode("latin-1").translate(_SPELLED)
            ids = np.array(self.plain.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("a word's last piece does not end it")
            self.known.add(some, ids, np.diff(ends, prepend=0))

    def encode(self, texts: Iterable[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        if not self.by_piece:
            for text in texts.to_pylist() if isinstance(texts, pa.Array) else texts:
                yield self._whole([text or ""])[0].tobytes()
            return
        for group in self._groups(texts):
            low = pc.ascii_lower(group)  # case is dropped anyway, but for the names of special tokens
            if pc.any(special := pc.match_substring(group, "<|")).as_py():
                low = pc.if_else(special, group, low)
            cut = pc.ascii_split_whitespace(low)
            pieces = cut.flatten().dictionary_encode()
            numbers = self._numbers(_bytes(pieces.dictionary), self._learn, turn=True)
            ids, counts = self.known.ids_of(numbers[pieces.indices.to_numpy()])
            borders = cut.offsets.to_numpy()
            at = np.concatenate([[0], np.cumsum(counts)])[borders - borders[0]] * self.dtype.itemsize
            raw = ids.tobytes()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield raw[a:b]

    @staticmethod
    def _groups(texts: Iterable[str | None] | pa.Array) -> Iterator[pa.Array]:
        """Some texts at a time; a null is an empty one."""
        if isinstance(texts, pa.Array):
            texts = pc.fill_null(texts, "")
            for a, b in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                yield texts.slice(a, b - a).cast(pa.string())
            return
        group, held = [], 0
        for text in texts:
            group.append(text or "")
            held += len(group[-1])
            if held > SLICE_BYTES:
                yield pa.array(group, pa.string())
                group, held = [], 0
        if group:
            yield pa.array(group, pa.string())


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, special_as_text)
    return _ENCODERS[key]
