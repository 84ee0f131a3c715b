"""Contextual extraction, whitening and importance resampling against plain versions, with nulls, empty tables and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex

from trivalent.llm import contextual_pii as cp
from trivalent.llm import importance_resampling as ir
from trivalent.llm import whitening as wh

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# ---- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_valid(kind, v):
    digits = [int(c) for c in v if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(t):
    return [(i, m.start(), m.end()) for i, k in enumerate(cp.KINDS) for m in re.finditer(PLAIN[k], t or "") if is_valid(k, m[0])]


def plain_find(texts):
    """Base and all spans of each text, by dictionaries."""
    occurrences = []
    for row, t in enumerate(texts):
        t, last = t or "", 0
        base = plain_base(t)
        matches = list(regex.finditer(cp.SCAN, t))
        for m, after in zip(matches, [*matches[1:], None]):
            before, behind = t[last : m.start()][-48:].lower(), t[m.end() : after.start() if after else len(t)][:48].lower()
            last = m.end()
            find = lambda p, s: " ".join((regex.search(p, s) or {1: ""})[1].rstrip(" \t\n\r\v\f(\"'[{<+").lstrip(" \t\n\r\v\f)\"']}>").split())
            one, two, right = find(r"(?<!\p{L})(\p{L}+[^\p{L}]*)$", before), find(r"(?<!\p{L})(\p{L}+[^\p{L}]+\p{L}+[^\p{L}]*)$", before), find(r"^([^\p{L}]*\p{L}+)", behind)
            patterns = [p for p, there in ((f"{4 if one[-1:] in set(':=#') else 1}|{one}", one), (f"2|{two}", two), (f"3|{one}|{right}", one and right)) if there]
            kind = next((k for k in cp.KINDS if re.fullmatch(PLAIN[k], m[0]) and is_valid(k, m[0])), None)
            able = kind is None and 6 <= len(m[0]) <= 64 and ("@" in m[0] or sum(c.isdigit() for c in m[0]) >= 3) and not any(a < m.end() and m.start() < b for _, a, b in base)
            occurrences.append((row, m.start(), m.end(), m[0].lower(), kind, patterns, able))
    members, kinds, can = collections.defaultdict(set), {}, set()
    for _, _, _, v, kind, patterns, able in occurrences:
        for p in patterns:
            members[p].add(v)
            can |= {(p, v)} if able else set()
        kinds[v] = kind
    believed, accepted = {}, {}
    for _ in range(cp.ROUNDS):
        accepted = {}
        for p, vs in members.items():
            z, n = cp.STRICT[p[0]], len(vs)
            for k in cp.KINDS:
                belief = sum(1000 if kinds[v] == k else believed.get((v, k), 0) if (p, v) in can else 0 for v in vs)
                share = belief / 1000 / n
                low = (share + z * z / (2 * n) - z * math.sqrt(max(0, share * (1 - share) / n + z * z / (4 * n * n)))) / (1 + z * z / n)
                if belief >= 3000 and n >= 3 and low >= 0.5 and any(kinds[v] for v in vs):
                    accepted[p, k] = low
        believed = {}
        for (p, k), low in accepted.items():
            for v in members[p]:
                if (p, v) in can:
                    believed[v, k] = max(believed.get((v, k), 0), math.floor(1000 * low))
    spans = [set(plain_base(t)) for t in texts]
    for row, a, b, _, _, patterns, able in occurrences:
        best = max(((low, -cp.KINDS.index(k)) for (p, k), low in accepted.items() if able and p in patterns), default=None)
        if best:
            spans[row].add((-best[1], a, b))
    return [(plain_base(t), sorted(s)) for t, s in zip(texts, spans)]


def personal_texts():
    rng = random.Random(5)
    phone = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    words = "the of and ouen thion be ath ré é wh lo".split()
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{filler(5)} you can reach Anna at {phone()} every day {filler(3)}" for _ in range(12)]
    texts += [f"{filler(4)} you can reach Anna at (0{i}7) 555-{7000 + i} every day" for i in range(3)]  # unseen: no plus
    texts += [f"{filler(4)} mobile number: (0{i}7) 555-{7000 + i}, {filler(2)}" for i in range(3)]  # the same, where no seed stands
    texts += [f"{filler(4)} mobile number: 0{i}7-555-8000, {filler(2)}" for i in range(2)]
    texts += [f"mobile number: {phone()}, {filler(2)}" for _ in range(2)]  # too few to accept at first: two of seven
    texts += [f"write to user{i}@mail.example.com today" for i in range(9)] + ["write to user77@localhost today", "write to 12345 today"]
    texts += [f"{rng.choice(words)}{i} fax: {phone()} {rng.choice(words)}" for i in range(6)] + [f"{rng.choice(words)}x{i} fax: (0{i}) 123-45{i} {rng.choice(words)}" for i in range(3)]  # a label and nothing else in common
    texts += [f"{filler(3)} the {rng.randrange(10**6)} and" for _ in range(15)] + [f"see the {rng.randrange(200)}.1.2.{i} and" for i in range(4)]
    texts += ["see the 4111 1111 1111 1111 and 4111 1111 1111 1112 or 999.1.1.1 or 1.2.3.4.5.6.7.8", "a@b.c_d@e.f.. g@h", "😀é x@y.zz +49 (0)30 1234-567 1.02.003.255", None, "", " \n", "+1 (826) 555-4081 190.137.223.204"]
    return texts + texts[:3]


def test_contextual_pii_matches_brute_force(spark):
    texts = personal_texts()
    docs = spark.createDataFrame([(None if i == 7 else i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, row string, spans string").repartition(3)
    found = cp.find(docs).collect()
    want = plain_find(texts)
    key = lambda d, a, b: (-1 if d is None else d, [tuple(x) for x in a], [tuple(x) for x in b])
    assert sorted(key(r.doc_id, r.base, r.spans) for r in found) == sorted(key(None if i == 7 else i, *w) for i, w in enumerate(want))
    text_of = lambda i: {texts[i][a:b] for k, a, b in set(want[i][1]) - set(want[i][0])}
    assert [text_of(i) for i in range(12, 15)] == [{f"0{i}7) 555-{7000 + i}"} for i in range(3)]  # discovered in an accepted context
    assert text_of(texts.index("write to user77@localhost today")) == {"user77@localhost"}
    assert [text_of(i) for i, t in enumerate(texts) if t and " fax: (0" in t] == [{f"0{i}) 123-45{i}"} for i in range(3)]
    assert not any(text_of(i) for i, t in enumerate(texts) if t and " the " in t and not any(w in t for w in ("mobile", "reach", "fax:")))


def test_contextual_pii_digests_and_very_long_texts(spark):
    long = "a" * 10_000 + " " + "1 " * 20_000 + "9" * 5_000 + " x@y.z " + " ".join(f"k{i}@m.de" for i in range(3000))
    docs = spark.createDataFrame([(1, long), (2, "5.6.7.8 +123456789")], "doc_id long, text string")
    one, two = sorted(cp.digests(cp.find(docs)).collect())
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (3001, 0, 0, 0)
    base = ",".join(f"email:{a}:{b}" for _, a, b in plain_base(long))
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and one.spans == base
    assert two.spans == "ip:0:7,phone:8:18"
    empty = cp.digests(cp.find(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0


# ---- whitening


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x.astype(object) - s) ** 2).sum(1), ((x - s / n) @ axes[:, order]) / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize(("d", "tile", "numbers"), [(5, 2, 60), (20, 7, 100), (20, 64, 1 << 19)])
def test_whitening_matches_numpy(spark, d, tile, numbers):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) * 10 + 5).tolist()
    vectors += vectors[:3] * 20
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [float("nan")] * d, 1), (1003, [float("inf")] + [1.0] * (d - 1), 1), (1004, [None] + [1.0] * (d - 1), 1), (1005, [1.0] * (d + 1), 1)]
    found = wh.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component int").repartition(4), tile=tile, numbers=numbers).toPandas().sort_values(["vec_id", "component"])
    k = min(d, 16)
    n, deviation, whitened, explained = plain_whitening(vectors)
    assert len(found) == len(rows) * k and set(found.n) == {n} and n == 300
    assert found.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == deviation.tolist()
    got = found.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(got, whitened * np.sign((got * whitened).sum(0)), atol=1e-8)
    assert np.allclose(found.explained.to_numpy().reshape(-1, k), explained, rtol=1e-9) and found.identity_error.max() < 1e-9


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert wh.whiten(spark.createDataFrame([], kind)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, kind)).count() == 0  # no spread, no component
    flat = wh.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, round(r.whitened, 9), r.explained) for r in flat) == [(0, 1, 2, 128**2, -1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0)]
    wide = wh.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.0, 1.0])], kind)).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {None} and all(math.isfinite(r.whitened) for r in wide)


def test_packed_integers_keep_their_value():
    for values in ([0, -5, 300], [32767, -32768], [1 << 20], [1 << 40, -3]):
        assert wh.unpack(wh.pack(np.array(values))).tolist() == values


# ---- importance resampling


def plain_resample(docs, target, longest, buckets, percent=10, least=20):
    def features(t):
        w = WORD.findall((t or "").translate(UPPER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    hashed = lambda t: [zlib.crc32(f.encode()) % buckets for f in features(t)[1]]
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(hashed(text))
    for text in target:
        t.update(hashed(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        weight = sum(map(gain, hashed(text)))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, *features(text)[:1], len(features(text)[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2], r[3]))
    drawn = collections.defaultdict(list)
    for nth, r in enumerate(able, 1):
        drawn[r].append(nth if nth <= percent * len(able) // 100 else None)
    return [(*r, drawn[r].pop(0) if r in drawn else None) for r in rows]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_matches_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(ir, "NODES", 40)  # tries are emptied again and again
    rng = random.Random(8)
    words = "the The of and ouen thion be ath ré É wh 42 don't x_y".split() + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "\x1f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)] + [(200, None), (201, ""), (202, "!?"), (None, text(30)), (203, text(400))]
    docs += [docs[3]] * 40 + [(204, docs[5][1])]
    target = [text(40) for _ in range(5)] + [None]
    data = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, place int").repartition(5)
    found = ir.resample(data, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=97, percent=30).collect()
    key = lambda r: tuple(math.inf if x is None else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_resample(docs, target, longest, 97, 30), key=key)


def test_resampling_walks_a_long_text_piece_by_piece(monkeypatch):
    rng = random.Random(9)
    words = [f"w{rng.randrange(50)}" for _ in range(4000)]
    monkeypatch.setattr(ir, "PIECE", 100)
    monkeypatch.setattr(ir.pieces, "__defaults__", (100,))
    trie, plain = ir.Trie(longest=3, buckets=10_000), collections.Counter()
    for _, nodes in trie.runs(" ".join(words).encode()):
        trie.count(nodes)
    for k in (1, 2, 3):
        plain.update(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for i in range(len(words) - k + 1))
    found = trie.totals()
    assert {b: n for b, n in enumerate(found.tolist()) if n} == dict(plain)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ir.resample(none, some).count() == 0
    (row,) = ir.resample(some, none).collect()
    assert (row.n_features, row["rank"]) == (3, None)
