"""Language identification, the quality classifier and the pipeline: plain versions and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trivalent.llm import language_id as li
from trivalent.llm import mil_quality as mq
from trivalent.llm import queries
from trivalent.llm.common import table, text_bytes

SF = "/root/testdata/sf0.01"


def plain_ngrams(t):
    words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        p = f" {w} "
        out.update("2" + p[i : i + 2] for i in range(len(p) - 1))
        out.update("3" + p[i : i + 3] for i in range(len(p) - 2))
    return out


@pytest.mark.parametrize("t", ["Ab abé", "", "1 2", "a", "Straße, naïve!  x", "日本 語", " lead and trail "])
def test_ngrams_against_a_plain_count(t):
    grams, counts = li.ngrams(t)
    assert sorted(counts.tolist()) == sorted(plain_ngrams(t).values())
    assert (np.diff(grams.astype(object)) > 0).all() if len(grams) > 1 else True


def test_out_of_place_distance():
    profiles = {k: li.profile(*li.ngrams(t), 50) for k, t in (("aa", "abc abd abe"), ("bb", "xyz xyw xyv"))}
    known = li.Identifier(profiles, 50)
    assert known("abc abd abe") == ("aa", 1.0, 0.0)
    lang, score, distance = known("xyz")
    assert lang == "bb" and 0.5 < score < 1
    own = li.profile(*li.ngrams("xyz"), 50).tolist()
    plain = [min(abs(profiles["bb"].tolist().index(g) - i), 50) if g in profiles["bb"].tolist() else 50 for i, g in enumerate(own)]
    assert abs(distance - sum(plain) / (50 * len(own))) < 1e-12
    assert known(None) == known("12 !") == (li.UNKNOWN, 0.0, None)
    assert li.Identifier({})("abc")[0] == li.UNKNOWN


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    found = queries.op1_rank_order_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98 and found.count() == docs.count()


def test_language_edge_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", "x"), (3, None, "en", "x"), (4, "", None, "x"), (None, "the", "en", "x"), (2, "!!", "de", "x")], "doc_id long, text string, lang string, score string")
    profiles = li.train(docs, F.lit(True))
    assert sorted(profiles) == ["de", "en"]
    kept = li.keep_identified(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 3
    assert li.identify(docs.limit(0), profiles).count() == 0 and li.train(docs.limit(0), F.lit(True)) == {}


def test_gradients():
    rng = np.random.default_rng(1)
    x, first, y = rng.normal(size=(12, mq.FEATURES)), np.array([0, 3, 4, 9, 12]), np.array([0.0, 1, 1, 0])
    model = mq.Model(hidden=5, gate=3)
    model.w["a"] = rng.normal(size=3)

    def loss():
        p = model._forward(x, first)["p"]
        return -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    start = {k: v.copy() for k, v in model.w.items()}
    model.mean, model.scale = np.zeros(mq.FEATURES), np.ones(mq.FEATURES)
    seen = {}
    fitted = mq.Model(hidden=5, gate=3)
    fitted.w = {k: v.copy() for k, v in start.items()}
    before = {k: v.copy() for k, v in fitted.w.items()}
    x_mean, x_scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - x_mean) / x_scale, -8, 8)
    for k in model.w:
        g = np.zeros_like(model.w[k])
        for i in np.ndindex(g.shape):
            for s in (1, -1):
                model.w[k] = start[k].copy()
                model.w[k][i] += s * 1e-5
                g[i] += s * loss() / 2e-5
            model.w[k] = start[k].copy()
        seen[k] = g
    fitted.fit(x * x_scale + x_mean, first, y, steps=1, rate=1e-3, decay=0.0)
    for k, g in seen.items():  # Adam's first step is the gradient's sign
        big = np.abs(g) > 1e-5
        assert (np.sign(before[k] - fitted.w[k])[big] == np.sign(g)[big]).all(), k


def test_passages_cover_whole_texts():
    texts = pa.array(["", None, "one", "w " * 101, "a\n\nb", "  lead " + "x" * 50])
    raw, at = text_bytes(texts)
    x, first = mq.encode(raw, at)
    assert np.diff(first).tolist() == [1, 1, 1, 3, 1, 1] and x.shape == (8, mq.FEATURES) and np.isfinite(x).all()
    alone, _ = mq.encode(*text_bytes(pa.array(["w " * 101])))
    assert np.allclose(alone, x[3:6])


def test_quality_held_out(spark):
    found = queries.op6_attention_quality(spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "some words here", "c"), (3, "some words here", "c")], "doc_id long, text string, score string")
    none = mq.train(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in mq.score(docs, none).collect()} == {0.5}
    ones = mq.train(docs, spark.createDataFrame([(1, 1), (3, 1), (None, 1), (2, None)], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in mq.score(docs, ones).collect()} == {1.0}
    assert mq.keep_good(docs, ones).columns == docs.columns and mq.keep_good(docs, ones).count() == 4
    assert mq.score(docs.limit(0), ones).count() == 0


def test_texts_of_no_learned_language_go(spark):
    profiles = {k: li.profile(*li.ngrams(t), 50) for k, t in (("aa", "abc abd abe"), ("bb", "xyz xyw xyv"))}
    docs = spark.createDataFrame([(1, "abc abd"), (2, "日本 語"), (3, "xyz"), (4, "12 3"), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in li.keep_identified(docs, profiles).collect()) == [1, 3]


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = cp.stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and (i == len(cp.STAGES) - 1 or docs.columns == columns)
    assert after == before and docs.where("NOT round_trip").count() == 0
    whole = cp.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in whole.select("doc_id").collect()} == after
