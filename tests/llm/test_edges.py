"""Edge rows of every operator and stage, very long texts, and the pipeline against a plain version of its decisions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from trivalent.llm import chat_windows as cw
from trivalent.llm import golay_simhash as gs
from trivalent.llm import language_id as li
from trivalent.llm import license_join as lj
from trivalent.llm import mil_quality as mq
from trivalent.llm import quality_rules as qr
from trivalent.llm import queries
from trivalent.llm import sentencepiece_gumbel as sg
from trivalent.llm import separator_scan as ss
from trivalent.llm import sstable
from trivalent.llm import suffix_decontam as sd
from trivalent.llm.common import table, text_bytes

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} the old house, number {i}" for i in range(60_000))  # over 2 MB: more than any slice
#: Columns that operators and stages use names like, and that must come through.
EXTRA = ["row", "nth", "score", "print", "h1_", "id_", "text_", "n_words", "component"]


def edge_docs(spark):
    data = [(1, "The cat sat on the mat and looked at the dog."), (2, None), (3, ""), (4, LONG), (None, "A row without an id, but with some words."), (5, "same text here for both"), (5, "same text here for both"), (6, " \n\t ")]
    rows = spark.createDataFrame(data, "doc_id long, text string")
    return rows.select("doc_id", "text", *[F.lit(f"x-{c}").alias(c) for c in EXTRA])


def test_every_operator_takes_edge_rows(spark):
    docs = edge_docs(spark)
    ids = Counter([1, 2, 3, 4, None, 5, 5, 6])
    of = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    english = {"en": li.profile(*li.ngrams("the cat and the dog"), 300)}
    found = {r.doc_id: r for r in li.identify(docs, english).collect()}
    assert Counter(r.doc_id for r in li.identify(docs, english).collect()) == ids and found[4].lang_pred == "en" and found[2].lang_pred == found[6].lang_pred == "und"
    assert of(sg.sample(docs, queries.vocabulary("piece_bpe_32k.model"), ids=False).where("round_trip")) == ids
    manifest = sstable.write_shards(docs, queries.vocabulary("word_bpe_49k.json"))
    tokens = {r.doc_id: r.n_tokens for r in sstable.read_shards(manifest, ids=False).collect()}
    flat = {r.doc_id: r.n_tokens for r in ss.counts(docs, queries.vocabulary("word_bpe_49k.json"), 49407).collect()}
    assert {k: v - 1 for k, v in tokens.items()} == flat and flat[2] == flat[3] == flat[6] == 0 and flat[4] > 300_000
    ledger = qr.ledger(docs)
    assert of(ledger) == ids and {r.doc_id: r.n_words for r in ledger.collect()}[4] == len(LONG.split())
    model = mq.Model().fit(np.zeros((0, mq.FEATURES)), np.zeros(1, int), np.zeros(0))
    assert of(mq.score(docs, model)) == ids and {r.doc_id: r.n_passages for r in mq.score(docs, model).collect()}[4] == -(-len(LONG.split()) // mq.PASSAGE_WORDS)
    items = spark.createDataFrame([("i", " ".join(LONG.split()[-30:])), (None, None), ("e", "")], "item_id string, text string")
    hit = {r.doc_id: r for r in sd.matches(docs, items).collect()}
    assert hit[4]["items"] == ["i"] and hit[4].n_hit == 30 and hit[4].longest_words == 30 and hit[2].n_words == 0
    assert of(lj.license_scan(docs)) == ids
    near = {r.doc_id: r for r in gs.near_duplicates(docs).collect()}
    assert of(gs.near_duplicates(docs)) == ids and near[2].component_id == near[6].component_id == 2 and near[5].component_id == 5
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *EXTRA)
    assert {r.conv_id: r.n_over_budget for r in cw.digests(cw.format_windows(turns)).collect()} == {k: int(k == 4) for k in ids}


def test_stages_keep_all_columns(spark):
    docs = edge_docs(spark)
    english = {"en": li.profile(*li.ngrams("the cat and the dog"), 300), "xx": li.profile(*li.ngrams("zzz"), 300)}
    model = mq.Model().fit(np.zeros((2, mq.FEATURES)), np.array([0, 1, 2]), np.ones(2))
    items = spark.createDataFrame([("i", "same text here for both")], "item_id string, text string")
    for kept, ids in (
        (li.keep_identified(docs, english), Counter([1, 4, None, 5, 5])), (mq.keep_good(docs, model), Counter([1, 2, 3, 4, None, 5, 5, 6])),
        (gs.keep_one(docs), Counter([1, 2, 4, None, 5])), (sd.decontaminate(docs, items), Counter([1, 2, 3, 4, None, 6])),
    ):
        rows = kept.collect()
        assert kept.columns == docs.columns and Counter(r.doc_id for r in rows) == ids
        assert all(r[c] == f"x-{c}" for r in rows for c in EXTRA)
        assert {r.text for r in rows if r.doc_id == 4} == {LONG}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit = words(text), set()
    wanted = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(max(1, len(w) - 12)) if w}
    for n in {len(w) for w in wanted}:
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(own)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    base = table(spark, SF, "documents")
    few = base.limit(12)
    item = table(spark, SF, "benchmark").where("length(text) > 200").select("text").first().text
    more = few.withColumn("doc_id", F.col("doc_id") + 100_000).unionByName(few.limit(3).withColumn("text", F.lit(item)).withColumn("doc_id", F.col("doc_id") + 200_000))
    more = more.unionByName(few.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" and then some more words")))).unionByName(few.limit(2).withColumn("text", F.lit("12 34")))
    base.unionByName(more).write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    docs, labels, items = (table(spark, sf, n) for n in ("documents", "labels", "benchmark"))
    known = li.Identifier(queries.language_profiles(docs))
    rows = [r for r in docs.collect() if known(r.text)[0] != "und" and known(r.text)[2] < 1]
    model = queries.quality_model(cp.language(spark, docs, sf), labels)
    rows = [r for r in rows if model.predict(*mq.encode(*text_bytes(pa.array([r.text]))))[0][0] >= 0.7]
    prints = [plain_fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    rows = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    texts = [r.text for r in items.collect()]
    rows = [r for r in rows if not plain_contaminated(r.text, texts)]
    pieces = sg.Pieces(queries.vocabulary("piece_bpe_32k.model"))
    want = {r.doc_id: sg.sample_slice([r.text], sg.row_keys(pa.array([r.doc_id], pa.int64()), sg.SEED), pieces, sg.SAMPLES)[0] for r in rows}
    got = {r.doc_id: r for r in cp.run(spark, sf).collect()}
    assert 20 < len(got) == len(rows) and got.keys() == want.keys()
    for k, samples in want.items():
        assert [s.ids for s in got[k].samples] == [s[0].tolist() for s in samples] and got[k].round_trip
        assert np.allclose([[s.log_prob, s.perturbed, s.log_inclusion] for s in got[k].samples], [s[1:] for s in samples])


def test_profiles_against_plain_counts(spark):
    data = [(i, f"{'der hund' if i % 2 else 'the dog'} {chr(97 + i % 26) * (i % 5 + 1)} text{i}", "de" if i % 2 else "en") for i in range(300)] + [(7, "der der", "de"), (8, None, "en"), (None, "the", "en"), (9, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    learn = F.col("doc_id") % 3 != 0
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    for per in (40, 1000):
        found = li.train(docs, learn, per_language=per, top=60)
        for lang in ("de", "en"):
            own = [(hashes[d], t) for d, t, x in data if x == lang and d is not None and t is not None and d % 3]
            cut = sorted({h for h, _ in own})[:per][-1]
            counts = Counter()
            for h, t in own:
                if h <= cut:
                    grams, n = li.ngrams(t)
                    counts.update(dict(zip(grams.tolist(), n.tolist())))
            assert found[lang].tolist() == sorted(counts, key=lambda g: (-counts[g], g))[:60]


@pytest.mark.parametrize("text", ["", "one", "A b! C d? 12% #x | y\n\nthe the the cat, the the the cat", "Füße <b> & $5 " * 40, " lead\ttab end "])
def test_passage_features_against_plain_ones(text):
    x, first = mq.encode(*text_bytes(pa.array([text])))
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    raw = text.encode()
    lower = [raw[a:b].lower() for a, b in words]
    triples = Counter(tuple(lower[i : i + 3]) for i in range(len(lower) - 2))
    n = max(1, -(-len(words) // mq.PASSAGE_WORDS))
    assert len(x) == first[1] == n
    for p in range(n):
        own = words[p * mq.PASSAGE_WORDS : (p + 1) * mq.PASSAGE_WORDS]
        begin = 0 if p == 0 else own[0][0]
        end = words[(p + 1) * mq.PASSAGE_WORDS][0] if p + 1 < n else len(raw)
        shares = np.bincount(mq._CLASS[np.frombuffer(raw[begin:end], np.uint8)], minlength=mq.CLASSES) / max(1, end - begin)
        assert np.allclose(x[p, : mq.CLASSES], shares)
        sizes = np.array([b - a for a, b in own]) if own else np.zeros(1)
        assert np.isclose(x[p, mq.CLASSES], sizes.mean() / 10) and np.isclose(x[p, mq.CLASSES + 1], (np.minimum(sizes, 60) ** 2).mean() / 100)
        mine = lower[p * mq.PASSAGE_WORDS : (p + 1) * mq.PASSAGE_WORDS]
        assert np.isclose(x[p, mq.CLASSES + 3], (len(mine) - len(set(mine))) / max(1, len(mine)))
        at = range(p * mq.PASSAGE_WORDS, p * mq.PASSAGE_WORDS + len(mine))
        twice = sum(triples[tuple(lower[i : i + 3])] > 1 for i in at if i + 3 <= len(lower))
        assert np.isclose(x[p, mq.CLASSES + 4], twice / max(1, len(mine)))
        assert np.isclose(x[p, mq.CLASSES + 5], np.log1p(len(words)) / 8) and np.isclose(x[p, mq.CLASSES + 6], max(1, len(own)) / mq.PASSAGE_WORDS)


def test_the_pipeline_and_its_stages_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    assert cp.run(spark, sf).count() == 0
    docs = table(spark, sf, "documents")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.count() == 0 and kept.columns == docs.columns, name
    assert gs.keep_one(docs).count() == 0
    rows = qr.ledger(docs)
    assert rows.count() == 0 and qr.ablation(rows, "v2").count() == 0


def test_without_benchmark_or_labels(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(50 if name == "documents" else 0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    docs = table(spark, sf, "documents")
    assert cp.decontamination(spark, docs, sf).count() == 50
    assert cp.quality(spark, docs, sf).count() == 0  # a half each


def test_decode_replaces_a_column_of_its_name(spark):
    model = queries.vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id long, text string")
    best = sg.sample(docs, model, k=1).select("doc_id", F.col("samples")[0]["ids"].alias("ids"), F.lit(7).alias("decoded"), F.lit("x").alias("text"))
    found = sg.decode(best, model)
    assert found.columns == ["doc_id", "ids", "text", "decoded"]
    assert {r.doc_id: (r.decoded or "").strip() for r in found.collect()} == {1: "the cat sat", 2: ""}
    assert sg.decode(best.limit(0), model).count() == 0
