"""Token files, shards, the sampler and chat windows: round trips and plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trivalent.llm import chat_windows as cw
from trivalent.llm import sentencepiece_gumbel as sg
from trivalent.llm import separator_scan as ss
from trivalent.llm import sstable
from trivalent.llm.queries import ADDED, vocabulary
from trivalent.llm.tokens import PieceEncoder

ODD = [
    "a\x0bb", "x\x1cy", "don't stop", "Áb", "<|endoftext|> a <|ENDOFTEXT|>x", " q r", "퟿ İ ß K", "'s 's' \"a.\" ... é'l", "", "\x85z", "ΑΣ ΑΣΑ σ", "1 234",
    "ärger, ÉTÉ! niño;; ßß?!. œuvre ŉ a ĳ ſ ǅ word.word. ...a", "naïve., ﬁn ʼn", "é é.", "?!", "\n \t",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_pieces_encode_as_whole_texts_do(library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aAéÉß .,;!'\"#$1\n\t ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for encoder in (PieceEncoder(vocabulary("word_bpe_49k.json")), PieceEncoder(vocabulary("word_bpe_49k.json"), remember=50)):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_capitals_and_marks_are_not_taken_one_by_one(library):
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    words = [f"{a}{b}{marks}" for a, b, marks in zip(letters, [*letters[7:], *letters[:7]], [".", "$$$", "", ",###", "&%*!"] * len(letters))]
    texts = [" ".join(words), None, "Êmenté$$$ ueta.### word.", "", " Ñarco,\tßß&&& word\x0b", *words]

    class Watched(PieceEncoder):
        taken: list = []

        def _whole(self, pieces):
            self.taken += pieces
            return super()._whole(pieces)

    encoder = Watched(vocabulary("word_bpe_49k.json"))
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    for given in (column, column.cast(pa.large_string()), texts):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(given)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    odd = [p for p in encoder.taken if any(c.isalpha() for c in p)]
    assert len(odd) == len(set(odd)) and all(any(c == "İ" or c.lower() >= "\u0250" for c in p) for p in odd)


def test_another_vocabulary_is_not_cut():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encoder = PieceEncoder(vocabulary("byte_bpe_50k.json"))
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([*ODD, None, "two  blanks\n\n"])] == [other.encode(t, add_special_tokens=False).ids for t in [*ODD, "", "two  blanks\n\n"]]


def test_shards_round_trip_and_look_up(spark, library):
    rng = random.Random(2)
    data = [(rng.randrange(-50, 400), rng.choice(ODD) + " word" * rng.randint(0, 30)) for _ in range(300)] + [(None, "null id"), (7, None), (7, ""), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    manifest = sstable.write_shards(docs, vocabulary("word_bpe_49k.json"), shard_bytes=2000)
    assert manifest.count() > 3
    got = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in data)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    found = Counter((r.doc_id, tuple(r.ids)) for r in sstable.lookup(manifest, [7, 8, -3, 99999]).collect())
    assert found == Counter({k: v for k, v in want.items() if k[0] in (7, 8, -3)})
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


def test_one_shard_in_memory():
    import io

    out = io.BytesIO()
    writer = sstable.Writer(out, 2)
    for i in range(0, 5000, 3):
        writer.add(sstable.key_of(i), np.arange(i % 50, dtype="<u2").tobytes())
    writer.close()
    data = out.getvalue()
    table = sstable.SSTable(lambda at, n: data[at : at + n], len(data))
    assert len(table.blocks) > 1 and [len(x) for x in table.get(3000)] == [0] and [len(x) for x in table.get(3003)] == [3] and table.get(3001) == []
    assert sum(table.may_hold(sstable.key_of(i)) for i in range(1, 5000, 3)) < 100
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(1), b"")


@pytest.mark.parametrize("block", [6, 16, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block):
    rng = random.Random(3)
    want = {}
    for f in range(4):
        ids = [rng.choice([9, 1, 2, 3, 4, 5]) for _ in range(rng.randint(0, 60))] if f else []
        (tmp_path / f"f{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        out, at = [], 0
        for i, x in enumerate(ids):
            if x == 9:
                out.append((len(out), at, i - at, True))
                at = i + 1
        if at < len(ids):
            out.append((len(out), at, len(ids) - at, False))
        want[f"f{f}.bin"] = out
    found = {}
    for r in ss.scan(ss.files_in(spark, f"file://{tmp_path}"), 9, 2, block).orderBy("file", "nth").collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.nth, r.start, r.n_tokens, r.terminated))
    assert found == {k: v for k, v in want.items() if v}


def test_counts_are_those_of_the_library(spark, library):
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id here"), (3, None), (3, None)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in ss.counts(spark.createDataFrame(data, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), 49407).collect())
    library.encode_special_tokens = True
    want = sorted((d is not None, d or 0, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in data)
    library.encode_special_tokens = False
    assert got == want
    assert ss.counts(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json"), 49407).count() == 0


# ---- Gumbel top-k


@pytest.fixture(scope="module")
def pieces():
    return sg.Pieces(vocabulary("piece_bpe_32k.model"))


def all_segmentations(text, pieces):
    t = sg.SPACE + text.replace(" ", sg.SPACE)
    known = {s.decode(): i for i, s in pieces.surface.items() if i not in pieces.byte_ids.values()}
    log = dict(zip(pieces.ids.tolist(), pieces.log_prob.tolist()))
    out = {}

    def go(i, ids, total):
        if i == len(t):
            out[tuple(ids)] = total
            return
        for n in range(1, pieces.longest + 1):
            if i + n <= len(t) and (p := known.get(t[i : i + n])) is not None:
                go(i + n, [*ids, p], total + log[p])
        if t[i] not in known:
            raw = t[i].encode()
            go(i + 1, ids + [pieces.byte_ids[b] for b in raw], total + pieces.byte_log_prob * len(raw))

    go(0, [], 0.0)
    top = max(out.values())
    norm = top + math.log(sum(math.exp(v - top) for v in out.values()))
    return {k: v - norm for k, v in out.items()}


@pytest.mark.parametrize("text", ["ab", "the cat", "a ①b", "x\ny", "  the"])
def test_samples_follow_the_lattice_without_replacement(pieces, text):
    want = all_segmentations(text, pieces)
    n = 3000
    found = sg.sample_slice([text] * n, sg.row_keys(pa.array(list(range(n))), 5), pieces, 3)
    for samples in found:
        ids = [tuple(s[0].tolist()) for s in samples]
        assert len(set(ids)) == len(ids) == min(3, len(want))
        assert all(abs(want[i] - s[1]) < 1e-8 for i, s in zip(ids, samples))
        assert all(a[2] >= b[2] for a, b in zip(samples, samples[1:]))
    p = {k: math.exp(v) for k, v in want.items()}
    first = Counter(tuple(s[0][0].tolist()) for s in found)
    second = Counter(tuple(s[1][0].tolist()) for s in found if len(s) > 1)
    for k in p:
        assert abs(first[k] / n - p[k]) < 0.04
        if len(p) > 1:
            assert abs(second[k] / n - sum(p[i] * p[k] / (1 - p[i]) for i in p if i != k)) < 0.04
    if len(want) <= 3:
        assert all(s[3] == 0.0 for s in found[0])


def test_sampling_is_by_row_key_and_decodes(spark, pieces):
    data = [(i, t) for i, t in enumerate(["Hello wörld\nagain", " lead  double ", "", None, "▁ odd", "日本語 text", "x" * 3000, "same", "same"])] + [(7, "same"), (None, "n"), (None, "n")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    once = {(r.doc_id, tuple(tuple(s.ids) for s in r.samples)) for r in sg.sample(docs, vocabulary("piece_bpe_32k.model")).collect()}
    again = {(r.doc_id, tuple(tuple(s.ids) for s in r.samples)) for r in sg.sample(docs.repartition(7), vocabulary("piece_bpe_32k.model")).collect()}
    assert once == again
    assert all(r.round_trip for r in sg.sample(docs, vocabulary("piece_bpe_32k.model"), ids=False).collect())
    assert len({s for d, s in once if d == 7}) == 1 and {s for d, s in once if d == 2} == {((),)}
    back = sg.decode(sg.sample(docs, vocabulary("piece_bpe_32k.model")).selectExpr("doc_id", "samples[0].ids AS ids"), vocabulary("piece_bpe_32k.model"))
    assert {r.decoded for r in back.where("doc_id = 0").collect()} == {"Hello wörld\nagain"}
    assert sg.sample(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


# ---- Chat windows


def test_windows_round_trip(spark):
    rng = random.Random(4)
    turns, want = [], {}
    texts = [ADDED, None, "", "a\\b # < </turn>\n### user\n", "plain words " * 30, "é\n</turn>\n", "\\\\"]
    for c in [1, 2, 3, None, -7]:
        own = []
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c in (1, 3) else rng.choice(["user", "assistant", "assistant", "odd role/\n"])
            own.append((t, role, rng.choice(texts)))
        turns += [(c, t, r, x, "extra") for t, r, x in own]
        want[c] = [(r, x or "") for _, r, x in own]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, window string")
    windows = cw.format_windows(df, budget=60, history=20)
    for r in cw.read_back(windows).collect():
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
    got = windows.orderBy("conv_id", "window").collect()
    assert all(w.text.startswith("### system\n") for w in got if w.conv_id in (1, 3))
    assert any(w.n_repeated > 1 for w in got) and {w.conv_id for w in got} == set(want)
    for w in got:
        own = [t for t in want[w.conv_id]][0][0] == "system"
        assert w.over_budget == (w.n_tokens > 60) and (not w.over_budget or w.n_turns - w.n_repeated <= 1 + (own and w.window == 0))
        assert not w.over_budget or w.n_repeated <= own
    digest = {r.conv_id: r for r in cw.digests(windows).collect()}
    for c in want:
        assert digest[c].n_windows == sum(w.conv_id == c for w in got) and digest[c].n_over_budget == sum(w.over_budget for w in got if w.conv_id == c)
    for c, own in want.items():
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert digest[c].formatted_chars == sum(len(w.text) for w in got if w.conv_id == c)


def test_no_turns_and_one_window(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cw.format_windows(df).count() == 0
    small = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], df.schema)
    w = cw.format_windows(small).collect()
    assert len(w) == 1 and w[0].n_repeated == 0 and [w[0].text[s.start : s.start + s.length] for s in w[0].loss] == ["b"]


@pytest.mark.parametrize("run", [3, 1024])
def test_spans_are_cut_greedily(spark, run, monkeypatch):
    monkeypatch.setattr(cw, "RUN", run)
    rng = random.Random(run)
    sizes = {c: [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))] for c in range(12)}
    rows = [(c, i, "system" if c % 3 == 0 and i == 0 else rng.choice(["user", "assistant"]), "w " * n) for c, some in sizes.items() for i, n in enumerate(some)]
    budget, history = 70, 15
    found = {(r.conv_id, r.window): r for r in cw.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history).collect()}
    for c, some in sizes.items():
        opens = c % 3 == 0
        tokens = [n + cw.HEAD_TOKENS for n in some]
        system = tokens[0] if opens else 0
        room, spans, used = max(1, budget - history - system), [0], 0
        for i, n in enumerate(tokens):
            body = 0 if opens and i == 0 else n
            if i and (i % run == 0 or (used and used + body > room + (history if len(spans) == 1 else 0))):
                spans.append(0)
                used = 0
            used += body
            spans[-1] += 1
        windows = [found[c, k] for k in range(max(k for d, k in found if d == c) + 1)]
        if opens and len(tokens) > 1 and spans[0] == 1:  # a system turn alone goes with what follows
            spans[:2] = [sum(spans[:2])]
        assert [w.n_turns - w.n_repeated for w in windows] == spans
        assert all(w.n_tokens <= budget or w.n_turns - w.n_repeated <= 2 for w in windows)
