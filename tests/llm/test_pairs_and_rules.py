"""SimHash, decontamination, licenses and quality rules against plain versions, with nulls, empty and repeated rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trivalent.llm import golay_simhash as gs
from trivalent.llm import license_join as lj
from trivalent.llm import quality_rules as qr
from trivalent.llm import suffix_decontam as sd

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def text(rng, n, words="the of and ouen thion be ath ré é wh".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "x", "yz"]) for _ in range(n))


def rows(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


# ---- SimHash


def plain_print(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_is_perfect_and_near_words_share_a_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 5000).astype(np.int32)
    index = gs.decode(words)
    code = (index << 11) | gs.PARITY[index]
    assert max(int(x).bit_count() for x in (code ^ words)) <= 3
    for width in (21, 22):
        a = rng.integers(0, 1 << width, 3000).astype(np.int32)
        b = a ^ (1 << rng.integers(0, width, 3000)).astype(np.int32)
        near, _ = gs.near_codes(a, width)
        assert (near == gs.decode(b)[:, None]).any(1).all() and (near == gs.decode(a)[:, None]).any(1).all()
        assert max(len(set(r)) for r in near.tolist()) <= 6


def test_keys_meet_for_all_prints_three_bits_apart():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    probe, index = {}, {}
    for store, keys, prints in ((probe, gs.probe_keys, a), (index, gs.index_keys, b)):
        for r, k in zip(*keys(prints)):
            store.setdefault(int(r), set()).add(int(k))
    assert all(probe[i] & index[i] for i in range(2000))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = [text(rng, 200) for _ in range(20)]
    data = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "changed"
        data.append((100 + k, " ".join(w)))
    data += [(300 + i, base[0]) for i in range(30)] + [(5000, None), (5001, ""), (5002, " \n"), (5003, "two words"), (5003, "two words"), (None, base[1])]
    found = gs.near_duplicates(rows(spark, data)).collect()
    assert len(found) == len(data)
    prints = sorted({(r.doc_id if r.doc_id is not None else -1, r.print & (1 << 64) - 1) for r in found})
    assert prints == sorted({(d if d is not None else -1, plain_print(t)) for d, t in data})
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d >= 0:
            least[find(p)] = min(d, least.get(find(p), d))
    assert all(r.component_id == least[find(r.print & (1 << 64) - 1)] for r in found)
    kept = gs.keep_one(rows(spark, [(d, t, "x", "y") for d, t in data], "doc_id long, text string, print string, component_id string"))
    assert kept.columns == ["doc_id", "text", "print", "component_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_one_row_of_each_component_stays_whatever_the_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (text(rng, 100) for _ in range(5))
    data = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, a), (2, d), (2, e), (3, e), (None, None), (None, "")]
    kept = sorted(((r.doc_id, r.text) for r in gs.keep_one(rows(spark, data)).collect()), key=str)
    assert len(kept) == 6 and {t or "" for _, t in kept} == {a, b, c, d, e, ""}
    assert {t: i for i, t in kept if t} == {a: 2, b: None, c: 1, d: 2, e: 2}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    found = dict(gs.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_no_documents(spark):
    assert gs.near_duplicates(rows(spark, [])).count() == 0
    assert sd.matches(rows(spark, []), rows(spark, [], "item_id long, text string")).count() == 0
    assert lj.license_scan(rows(spark, [])).count() == 0
    assert qr.ledger(rows(spark, [])).count() == 0


# ---- Decontamination


def plain_matches(docs, items, size=13):
    windows = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(UPPER))
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize(("broadcast_bytes", "held_bytes"), [(sd.BROADCAST_BYTES, sd.HELD_BYTES), (0, sd.HELD_BYTES), (0, 0)])
def test_matches_against_brute_force(spark, broadcast_bytes, held_bytes):
    rng = random.Random(4)
    items = [(i, text(rng, rng.randint(14, 40))) for i in range(12)] + [(50, "short item"), (51, "one"), (52, ""), (53, None), (None, text(rng, 20)), (3, text(rng, 15))]
    docs = []
    for i in range(80):
        parts = [text(rng, rng.randint(0, 40))]
        if i % 2:
            w = (rng.choice(items[:12])[1]).split()
            a = rng.randrange(len(w) - 12)
            parts.append("  ".join(w[a : a + rng.randint(10, 20)]).upper())
        if i % 7 == 0:
            parts.append("Short ITEM!")
        docs.append((i, (" " + rng.choice(["", "\n", " - "])).join(parts)))
    docs += [(500, None), (501, ""), (502, "--- ..."), (7, docs[7][1]), (503, "one"), (504, items[0][1])]
    found = sd.matches(rows(spark, docs), rows(spark, items, "item_id long, text string"), broadcast_bytes=broadcast_bytes, held_bytes=held_bytes).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found) == sorted(plain_matches(docs, items))
    whole = next(r for r in found if r.doc_id == 504)
    assert (whole.longest_words, whole.longest_at) == (len(items[0][1].split()), 0)


def test_an_occurrence_never_spans_documents():
    texts = pa.array(["a b c d e f g", "h i j k l m n"])
    blocks = list(sd.pack(["1"], pa.array(["a b c d e f g h i j k l m"])))
    assert sd.scan(texts, lambda: iter(blocks))[1].to_pylist() == [0, 0]


def test_decontaminate_keeps_the_columns(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    docs = spark.createDataFrame([(1, item, 5), (2, "clean text", 6), (None, None, 7)], "doc_id long, text string, n_words int")
    kept = sd.decontaminate(docs, rows(spark, [(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [6, 7]


# ---- Licenses


def test_join_against_brute_force():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    templates = tuple((f"l{i}", " ".join(rng.sample(words, rng.randint(2, 9)))) for i in range(25))
    counts = {w: rng.randint(0, 50) for w in words}
    known = lj.Templates(templates, 0.7, counts)
    blocks = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(300)]
    place = {w: i for i, w in enumerate(known.words)}
    pairs = sorted((b, place[f"w{i}"]) for b, own in enumerate(blocks) for i in own if f"w{i}" in place)
    block, word = (np.array(x, np.int64) for x in zip(*pairs))
    found = {(int(b), int(t)): int(c) for b, t, c in zip(*lj.join(known, block, word))}
    plain = {}
    for b, own in enumerate(blocks):
        for t, (_, body) in enumerate(templates):
            s = set(body.split())
            n = len(s & {f"w{i}" for i in own})
            if n >= int(known.need[t]):
                plain[b, t] = n
    assert found == plain


def test_phrases_and_templates(spark):
    pad = " ".join(f"q{i}" for i in range(200))
    docs = [
        (1, "Released under the MIT License. the mit license"), (2, f"{pad} Licensed under CC BY-NC 4.0. {pad}"), (3, "mit\nlicense"), (4, "GNU General Public-License"), (5, None), (6, ""),
        (7, f"{pad}\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated documentation files"), (8, "permit licenses"), (8, "permit licenses"), (9, "mit"),
    ]
    found = {r.doc_id: r for r in lj.license_scan(rows(spark, docs)).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (2, 3, 6, ["mit"])
    assert (found[2].labels, found[2].base_labels, found[2].score) == (["cc-by-nc"], [], 1.0)
    assert found[3].base_labels == ["mit"] and found[4].base_labels == ["gpl"]
    assert (found[7].labels, found[7].base_labels) == (["mit"], [])
    assert all((found[i].n_base, found[i].first_word, found[i].labels, found[i].score) == (0, None, [], 0.0) for i in (5, 6, 8, 9))


def test_notices_and_their_variants_keep_their_own_labels(spark):
    pad = " ".join(f"q{i}" for i in range(60))
    by = "This work is licensed under a Creative Commons Attribution 4.0 International License."
    nc = by.replace("Attribution", "Attribution-NonCommercial")
    gpl = "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
    lgpl = gpl.replace("General", "Lesser General")
    want = [
        (by, ["cc-by"]), (nc, ["cc-by-nc"]), (f"{by} {nc}", ["cc-by", "cc-by-nc"]), (f"{nc} {nc}", ["cc-by-nc"]), (gpl, ["gpl"]), (gpl.replace("General Public ", "General "), ["gpl"]), (lgpl.replace("General Public ", "General "), ["lgpl"]),
        (f"{by} Noncommercial is another.", ["cc-by", "cc-by-nc"]), ("Licensed under CC BY 4.0", ["cc-by"]), ("Licensed under CC BY-SA 4.0", ["cc-by-sa"]), ("Licensed under CC BY-NC 4.0, or licensed under CC BY 4.0", ["cc-by", "cc-by-nc"]),
    ]
    docs = [(i, around + t + around) for i, (t, _) in enumerate(want) for around in ("", f" {pad} ")]
    found = lj.license_scan(rows(spark, docs), phrases=()).collect()
    assert len(found) == len(docs) and [(r.doc_id, r.labels) for r in found if r.labels != want[r.doc_id][1]] == []


def test_templates_longer_than_half_a_block(spark):
    for n in (90, 150):
        body = " ".join(f"t{i}" for i in range(n))
        docs = [(at, " ".join(f"q{i}" for i in range(at)) + f" {body} " + "q " * 200) for at in (0, 24, 40)]
        found = lj.license_scan(rows(spark, docs), templates=(("long", body),), phrases=()).collect()
        assert sorted((r.doc_id, r.labels, r.score) for r in found) == [(at, ["long"], 1.0) for at in (0, 24, 40)]


# ---- Quality rules


def plain_rules(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_measurements_and_policies(spark):
    rng = random.Random(6)
    texts = [text(rng, rng.randint(0, 60), ["a", "b", "é"]) for _ in range(60)] + ["a\nb\na\n \n", None, "", "\x0b\x0c", "x " * 40, "### $$ " * 9, "one\ttwo\rthree\n", "ABC DEF GHI! " * 8]
    found = {r.doc_id: r for r in qr.ledger(rows(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(t), t
        assert bool(r.failed & qr.POLICIES["base"]) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_ablation(spark):
    ledger = qr.ledger(rows(spark, [(i, t) for i, t in enumerate(["too short", "x " * 40, "## " + "word other thing more text here nine ten eleven twelve " * 1, None])]))
    for r in qr.ablation(ledger, "v2").collect():
        masks = [x.failed & qr.POLICIES["v2"] for x in ledger.collect()]
        bit = qr.BIT[r.rule]
        assert (r.n_failed, r.n_only, r.n_kept) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks), sum(m == 0 for m in masks))
        assert r.n_kept_without == r.n_kept + r.n_only


def test_license_sql_names_nested_notices_as_the_operator_does(spark):
    import duckdb

    from trivalent.llm import queries

    rng = random.Random(12)
    texts = [t for _, t in lj.TEMPLATES]
    nested = [(t, u) for t, a in enumerate(texts) for u, b in enumerate(texts) if set(a.split()) < set(b.split())]
    data = [t for pair in nested for t in (texts[pair[0]], texts[pair[1]], f"{texts[pair[0]]} {texts[pair[1]]}", f"{texts[pair[1]]} {text(rng, 30)} {texts[pair[0]]}")]
    for t in texts:  # a word changed, a word gone, words mixed in
        w = t.split()
        data += [" ".join([*w[:3], "other", *w[4:]]), " ".join(w[1:]), f"{text(rng, 60)} {t} {text(rng, 60)} {t}"]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = sorted((r.doc_id, ",".join(r.labels), ",".join(r.base_labels), len(r.matches), round(r.score, 9)) for r in lj.license_scan(docs).collect())
    db = duckdb.connect()
    frame = docs.toPandas()
    db.register("documents", frame)
    want = db.sql(f"SELECT doc_id, labels, base_labels, n_matches, round(score, 9) FROM ({lj.sql()})").fetchall()
    assert got == sorted(want) and len(nested) > 0
    assert queries.ORACLE_SQL["op8_license_join"] == lj.sql()


def test_of_equal_longest_matches_the_first_counts_whatever_the_blocks(spark, monkeypatch):
    one, two = " ".join(f"a{i}" for i in range(16)), " ".join(f"b{i}" for i in range(16))
    texts = pa.array([f"{one} x {two}", f"{two} x {one}"])
    for items in ([one, two], [two, one]):
        monkeypatch.setattr(sd, "PACK_BYTES", 20)  # a block for each item
        blocks = list(sd.pack(["1", "2"], pa.array(items)))
        assert len(blocks) == 2
        found = sd.scan(texts, lambda: iter(blocks))
        assert found[3].to_pylist() == [16, 16] and found[4].to_pylist() == [0, 0]
