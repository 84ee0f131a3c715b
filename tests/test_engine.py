"""The engine's own operators: invariants, truth tables, round trips and small plain versions."""

import base64
import itertools
import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.functions import stats
from trivalent.functions.text import lcg, seed_for, words
from trivalent.operators import assembly, behavior, metrics, preview, resampling, scoring, segment, statistics, turns, verdict
from trivalent.sources import files
from trivalent.streaming import events as streams

TEXTS = ["one two  three\nfour five six seven", "  lead \t and trail \n", "a", "", "  \n ", "x y z", "﻿BOM word\r\nend \U0001f600 tail ", " ".join(map(str, range(40)))]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "case_id long, text string")


# ---- Segments


@pytest.mark.parametrize("window", [1, 2, 4, 7, 12])
def test_preserved_windows_agree_with_plain_ones_and_whole_text_returns(spark, window):
    for stride in {1, max(1, window // 2), window}:
        plain = {(r.case_id, r.idx): (r.segment, r.start_word, r.end_word) for r in segment.sliding(docs(spark), window, stride).collect()}
        kept = {(r.case_id, r.idx): (r.segment, r.start_word, r.end_word) for r in segment.sliding_preserve(docs(spark), window, stride).collect()}
        assert plain.keys() == kept.keys()
        space = "".join(chr(c) for c in (*range(9, 14), 32, 0xA0, 0x2028, 0xFEFF))
        for k, (text, a, b) in plain.items():
            got = kept[k][0]
            for c in space:
                got = got.replace(c, " ")
            assert (" ".join(got.split()), a, b) == (text, *kept[k][1:])
        if stride == window:
            for i, t in enumerate(TEXTS):
                joined = "".join(kept[k][0] for k in sorted(kept) if k[0] == i)
                assert joined == (t if any(k[0] == i for k in kept) else "")


def test_tails_differ(spark):
    df = spark.createDataFrame([(1, 0, "a b c d e f")], "case_id long, turn long, text string")
    assert segment.sliding(df, 4, 2).count() == 3
    assert [r.segment for r in segment.source_spans(df, 4, 2).orderBy("idx").collect()] == ["a b c d", "c d e f"]
    s = segment.sliding(df, 4, 1)
    assert [r.idx for r in segment.coverage_new_words(s, ["case_id"]).orderBy("idx").collect()] == [0, 1, 2]
    assert [r.idx for r in segment.coverage_to_end(s, ["case_id"]).orderBy("idx").collect()] == [0, 1, 2]
    assert segment.full_text(docs(spark)).count() == 6
    with pytest.raises(ValueError):
        segment.sliding(df, 2, 3)


def test_random_chunks_cover_each_word_once_by_the_seed(spark):
    seed = seed_for("xor_case_ordinal_v1", 7, 5, "case_id")
    got = segment.random_chunks(docs(spark), 2, 5, seed).orderBy("case_id", "idx").collect()

    def plain(case, n):
        state, at, out = (7 ^ (5 * 65537) ^ (case + 1)) & 0xFFFFFFFF, 0, []
        while at < n:
            upper, lower = min(5, n - at), min(2, n - at)
            length = lower
            if lower < upper:
                state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
                length = lower + int(state / 2**32 * (upper - lower + 1))
            out.append((at, at + length))
            at += length
        return out

    sizes = {r.case_id: r.n for r in docs(spark).select("case_id", F.size(words("text")).alias("n")).collect()}
    for case, n in sizes.items():
        assert [(r.start_word, r.end_word) for r in got if r.case_id == case] == plain(case, n)
    assert docs(spark).limit(1).select(lcg(F.lit(5).cast("long"))).first()[0] == (5 * 1664525 + 1013904223) & 0xFFFFFFFF


def test_selection_and_redaction(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "user", "u2"), (2, 0, "assistant", "a"), (3, 0, None, "n")], "conv_id long, turn long, role string, text string")
    cases = turns.cases_of_turns(t)
    pick = lambda kind: {r.case_id: r.t for r in cases.select("case_id", F.array_join(turns.select_turns("turns", kind)["text"], "\n").alias("t")).collect()}
    assert pick("all")[1] == "s\nu1\nu2" and pick("all_external") == {1: "u1\nu2", 2: None, 3: "n"} and pick("last_external")[1] == "u2"
    a, b = "x" * 45, "y" + "x" * 45
    for batch in (1, 1000):
        out = turns.redact(docs(spark, [f"pre {b} mid {a} post", "x" * 30, ""]), spark.createDataFrame([(a,), (b,), ("short",), (f" {a} ",)], "text string"), batch=batch)
        assert [r.redacted for r in out.orderBy("case_id").collect()] == ["pre   mid   post", "x" * 30, ""]


# ---- Verdicts


def obs(spark, rows):
    return spark.createDataFrame([(c, i, o, s) for c, segs in rows.items() for i, (o, s) in enumerate(segs)], "case_id long, idx long, outcome string, score double")


S, A, E = "scored", "abstained", "error"
ROWS = {1: [(S, 0.9), (S, 0.1)], 2: [(S, 0.9), (A, None)], 3: [(S, 0.1), (A, None)], 4: [(S, 0.1), (E, None)], 5: [(A, None)], 6: [(S, 0.5)], 7: [(S, 0.9), (S, 0.8)]}


def test_four_policies(spark):
    rules = spark.createDataFrame([("max", "max", ">", 0.5), ("min", "min", ">", 0.5), ("mean", "mean", ">", 0.5)], "rule_id string, aggregation string, comparator string, threshold double")
    cases = verdict.with_rules(verdict.summarise(obs(spark, ROWS), ["case_id"]), rules)
    strict = {(r.case_id, r.rule_id): r.flagged for r in verdict.strict(cases).collect()}
    assert [strict[i, "max"] for i in range(1, 8)] == [True, None, None, None, None, False, True]
    short = {(r.case_id, r.rule_id): (r.flagged, r.verdict) for r in verdict.short_circuit(cases).collect()}
    assert [short[i, "max"] for i in range(1, 8)] == [(True, "flagged"), (True, "flagged"), (None, "abstained"), (None, "incomplete"), (None, "abstained"), (False, "passed"), (True, "flagged")]
    assert [short[i, "min"][0] for i in range(1, 8)] == [False, None, False, False, None, False, True]
    two = {(r.case_id, r.aggregator): (r.flagged, r.inconclusive) for r in verdict.two_reading(obs(spark, ROWS), ["case_id"], 0.5).collect()}
    assert two[2, "any"] == (True, False) and two[3, "any"] == (False, True) and two[3, "all"] == (False, False) and two[5, "all"] == (False, True) and two[7, "min"] == (True, False)
    ignore = {r.case_id: r.flagged for r in verdict.ignore_invalid(obs(spark, ROWS), ["case_id"]).collect()}
    assert [ignore[i] for i in range(1, 8)] == [True, True, False, False, None, False, True]


def test_cascades_by_truth_table(spark):
    three = [True, False, None]
    df = spark.createDataFrame(list(itertools.product(three, three)), "f boolean, w boolean")
    got = df.select("f", "w", *[verdict.cascade(F.col("f"), F.col("w"), k).alias(k) for k in ("kleene", "strict", "screen")]).collect()
    for r in got:
        assert r.kleene == (True if r.f or r.w else None if None in (r.f, r.w) else False)
        assert r.strict == (None if r.f is None else True if r.f else r.w)
        assert r.screen == bool(r.f or r.w) and (not r.f or r.screen)


def test_outcomes_and_decisions(spark):
    df = spark.createDataFrame([(True, None, None), (False, True, False), (False, True, True), (False, None, None), (False, False, True)], "s boolean, a boolean, e boolean")
    assert [r[0] for r in df.select(verdict.outcome(F.col("s"), F.col("a"), F.col("e"))).collect()] == ["scored", "abstained", "error", "unscored", "error"]
    cases = [(False, False, False, "external", "input", "allow"), (False, False, True, "external", "input", "block"), (False, True, False, "external", "input", "block"), (True, False, False, "agent", "input", "observe"),
             (True, False, False, "external", "tool_output", "quarantine"), (True, True, False, "external", "input", "block")]
    df = spark.createDataFrame(cases, "flagged boolean, inconclusive boolean, content boolean, origin string, boundary string, want string")
    c = F.col
    assert all(r.got == r.want for r in df.select("want", verdict.screen_decision(c("flagged"), c("inconclusive"), c("content"), c("origin"), c("boundary")).alias("got")).collect())


# ---- Statistics


def test_intervals_and_tests(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (3, 2), (10, 1), (40, 60)], "b long, c long")
    low, high = stats.wilson(F.col("b"), F.col("b") + F.col("c"))
    for r in df.select("b", "c", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p"), low.alias("low"), high.alias("high")).collect():
        n, k = r.b + r.c, min(r.b, r.c)
        assert math.isclose(r.p, 1 if not n else min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel_tol=1e-9)
        assert (r.low, r.high) == (None, None) if not n else r.low <= r.b / n <= r.high
    assert df.where("b = 0 AND c = 5").select(low).first()[0] == 0.0


def test_auroc_is_the_share_of_ordered_pairs(spark):
    rows = [(g, s / 4, (s * 7 + i) % 3 == 0) for g in (1, 2) for i, s in enumerate([0, 1, 1, 2, 3, 3, 4, 4, 4])] + [(3, 0.5, True)]
    got = {r.g: r.auroc for r in stats.auroc(spark.createDataFrame(rows, "g int, s double, p boolean"), "s", "p", ["g"]).collect()}
    for g in (1, 2):
        pos, neg = [s for h, s, p in rows if h == g and p], [s for h, s, p in rows if h == g and not p]
        assert math.isclose(got[g], sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got[3] is None


def test_resampling(spark):
    df = spark.createDataFrame([("g", f"f{i}", v) for i, v in enumerate([2, -1, 0, 3])], "g string, f string, v long")
    r = resampling.family_bootstrap(df, ["g"], "f", "v").first()
    totals = sorted(sum(t) for t in itertools.product([2, -1, 0, 3], repeat=4))
    assert math.isclose(r["mean"], 4.0) and math.isclose(r.p_not_above_zero, sum(t <= 0 for t in totals) / 256)
    assert r.lower == totals[math.ceil(0.025 * 256) - 1]
    b = statistics.cluster_bootstrap(df.withColumn("w", F.lit(1)), ["g"], "f", "v", "w", reps=1000).first()
    assert b.clusters == 4 and b.estimate == 1.0 and b.lower <= 1.0 <= b.upper
    rows = [(s, float(x), int((x * 13 + (s == "b") * 3 + i) % 5 < 2)) for i, (s, x) in enumerate(itertools.product("ab", range(30)))]
    fit = {r.term: r.estimate for r in statistics.stratified_logit(spark.createDataFrame(rows, "s string, x double, y int"), "s", ["x"], "y").collect()}
    p = [1 / (1 + math.exp(-(fit[f"s={s}"] + fit["x"] * x))) for s, x, _ in rows]
    assert abs(sum(y - q for (_, _, y), q in zip(rows, p))) < 0.05


def test_many_strata_are_fitted_without_a_matrix_of_them(spark):
    rng = random.Random(6)
    rows = [(i % 3000, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(24000)]
    rows = [(s, x, z, int(rng.random() < 1 / (1 + math.exp(-(0.8 * x - 0.5 * z + (s % 7 - 3) / 3))))) for s, x, z in rows]
    found = {r.term: r for r in statistics.stratified_logit(spark.createDataFrame(rows, "s int, x double, z double, y int"), "s", ["x", "z"], "y", ridge=0.5).collect()}
    assert len(found) == 3002
    alpha, b = np.zeros(3000), np.zeros(2)
    s, x, y = np.array([r[0] for r in rows]), np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    for _ in range(40):  # plain Newton, the diagonal block eliminated by hand
        p = 1 / (1 + np.exp(-(alpha[s] + x @ b)))
        w = p * (1 - p)
        ga, haa = np.bincount(s, y - p, 3000) - 0.5 * alpha, np.bincount(s, w, 3000) + 0.5
        hab = np.stack([np.bincount(s, w * x[:, i], 3000) for i in (0, 1)], 1)
        schur = x.T @ (x * w[:, None]) + 0.5 * np.eye(2) - (hab / haa[:, None]).T @ hab
        move = np.linalg.solve(schur, x.T @ (y - p) - 0.5 * b - hab.T @ (ga / haa))
        alpha, b = alpha + (ga - hab @ move) / haa, b + move
    assert np.allclose([found["x"].estimate, found["z"].estimate], b, atol=2e-6) and np.allclose([found[f"s={i}"].estimate for i in range(3000)], alpha, atol=2e-6)
    cover = np.linalg.inv(schur)
    assert np.allclose([found["x"].std_error, found["z"].std_error], np.sqrt(np.diag(cover)), atol=2e-6)
    whole = 1 / haa + np.einsum("si,ij,sj->s", hab / haa[:, None], cover, hab / haa[:, None])
    assert np.allclose([found[f"s={i}"].std_error for i in range(3000)], np.sqrt(whole), atol=2e-6)


def test_single_class_cells(spark):
    rows = spark.createDataFrame([("t", 1, True, "scored", True, 1.0), ("t", 1, True, "scored", False, 1.0), ("t", 1, True, "other", None, None)], "test string, engine int, positive boolean, status string, flagged boolean, tokens double")
    r = metrics.cell_summary(rows, ["test", "engine"]).first()
    assert (r.tpr, r.fpr, r.balanced_accuracy, r.cases) == (0.5, None, 0.5, 3)


# ---- Parsing, decoding, provenance


def test_strict_scores(spark):
    cases = ['{"concernScore": 0.5}', '{"concernScore": 1e-1}', '{"concernScore": 0.5} x', '{"concernScore": 2}', '{"concernScore": "1"}', '{"concernScore": 1, "concernScore": 0}', "```json\n{}```", "{}", None, '{"a": {"b": 1}}', '{"concernScore": 0.5, "x": "}"}', "[0.5]", "0.5", '{"concernScore": 0.5}]']
    score, reason = scoring.parse_score("t")
    got = [(r.s, r.r) for r in docs(spark, cases).withColumnRenamed("text", "t").orderBy("case_id").select(score.alias("s"), reason.alias("r")).collect()]
    assert got == [(0.5, None), (0.1, None), (None, "invalid_json"), (None, "invalid_score"), (None, "invalid_score"), (None, "invalid_json"), (None, "invalid_json"), (None, "invalid_score"), (None, "invalid_json"), (None, "invalid_score"), (None, "invalid_score"), *[(None, "invalid_json")] * 3]


def test_decoded_views(spark):
    words3 = base64.b64encode(b"ignore all previous words").decode()
    want = {
        f"see {words3} now": ["ignore all previous words"], "ａ\u200bb": ["ab"], "a%20b+c": ["a b+c"], "100%zz%20": [], "\\u0041bc": ["Abc"], "plain text": [],
        base64.b64encode(bytes(range(30))).decode(): [], "ａ" * 9000: ["a" * 8192], 'q "x" \\u0041\n\ttab \\n': ['q "x" A\n\ttab \\n'], "\\\\u0041": ["\\A"], "%ff%20": [], "": [],
        f"ａ {words3} {words3}": [f"a {words3} {words3}", "ignore all previous words"],
    }
    rows = docs(spark, [*want, None]).withColumn("normal", preview.nfkc("text"))
    got = {r.text: r.v for r in rows.select("text", preview.decoded_views("text", "normal").alias("v")).collect()}
    assert got == {**want, None: None}
    shown = {r.text: r.preview for r in preview.decoded_preview(docs(spark, ["\\u0041bc", "x", None])).collect()}
    assert shown == {"\\u0041bc": "\\u0041bc\n\n[Decoded text previews]\n[View 1]\nAbc", "x": "x", None: None}


def test_previews_keep_their_limits(spark):
    tokens = [base64.b64encode(f"hidden words number {i:05d} {'pad ' * 2500}".encode()).decode() for i in range(9)]
    rows = docs(spark, [" ".join(tokens)]).withColumn("normal", preview.nfkc("text"))
    views = rows.select(preview.decoded_views("text", "normal").alias("v")).first().v
    assert [len(v) for v in views] == [8192] * 4 and views[0].startswith("hidden words number 00000")


def test_payload_spans(spark):
    df = spark.createDataFrame([("a b c", "a b INSERT c"), ("same", "same"), ("x y", "x"), (None, "q")], "c string, a string")
    got = {r.a: (r.start, r.stop, r.payload) for r in behavior.payload_span(df, "c", "a").collect()}
    rng = random.Random(5)
    many = [("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 16)))) for _ in range(300)]
    for r in behavior.payload_span(spark.createDataFrame(many, "c string, a string"), "c", "a").collect():
        head = len(os.path.commonprefix([r.c, r.a]))
        tail = len(os.path.commonprefix([r.c[head:][::-1], r.a[head:][::-1]]))
        begin, end = head, len(r.a) - tail
        if r.c == r.a or end <= begin:
            assert r.start is None and r.stop is None and r.payload is None
            continue
        whole = [m.span() for m in re.finditer(r"\S+", r.a)]
        begin = min([begin, *(x for x, y in whole if x < begin < y)])
        end = max([end, *(y for x, y in whole if x < end < y)])
        assert (r.start, r.stop, r.payload) == (begin, end, r.a[begin:end]), (r.c, r.a)
    assert got["a b INSERT c"] == (4, 11, "INSERT ") and got["same"] == (None, None, None) and got["x"][2] is None


def test_scorer_runs_once_an_input(spark):
    import pandas as pd

    s = segment.identify(segment.sliding(docs(spark, ["a b a b", "a b"]), 2, 2))
    out = scoring.run_scorer(s, lambda t: pd.DataFrame({"score": t.str.len() / 10}), "score double")
    assert out.count() == 3 and {r.score for r in out.collect()} == {0.3}
    native = segment.first_native(s, ["case_id", "idx"]).where("native").count()
    assert native == 1


# ---- Sources and streams


def test_case_files(spark, tmp_path):
    import hashlib

    turns_ = [{"id": "t1", "role": "user", "origin": "external", "text": "hello"}, {"id": "t2", "role": "user", "origin": None, "text": "you"}]
    good = {"id": "1", "label": "benign", "turns": turns_, "facets": {"domain": "x"}, "text_sha256": hashlib.sha256(b"hello\nyou").hexdigest()}
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps(good) + "\n" + json.dumps(good | {"id": "2", "label": "injection"}) + "\n")
    args = (["injection"], ["benign"])
    cases = files.read_cases(spark, f"file://{path}", "canonical-jsonl", *args, expected=2, sha256=files.file_sha(str(path)))
    assert sorted((r.case_id, r.positive) for r in cases.collect()) == [("1", False), ("2", True)]
    with pytest.raises(ValueError):
        files.read_cases(spark, f"file://{path}", "canonical-jsonl", *args, sha256="0" * 64)
    for bad in ({"id": " "}, {"label": "odd"}, {"turns": []}, {"text_sha256": "0" * 64}, {"turns": [turns_[0], turns_[0]], "text_sha256": None}):
        path.write_text(json.dumps(good | bad) + "\n")
        with pytest.raises(ValueError):
            files.read_cases(spark, f"file://{path}", "canonical-jsonl", *args)
    flat = tmp_path / "f.jsonl"
    flat.write_text('{"id": 5, "label": "a", "text": "t", "split": "dev"}\n')
    r = files.read_cases(spark, f"file://{flat}", "llmail-jsonl", ["a"], []).first()
    assert (r.case_id, r.turns[0].id, r.facets) == ("5", "5/source", {"split": "dev"})
    nested = tmp_path / "n.json"
    nested.write_text(json.dumps({"cases": [{"id": 1, "label": "a", "text": "t"}]}))
    assert files.read_cases(spark, f"file://{nested}", "notinject-json", ["a"], []).first().text_sha256 == hashlib.sha256(b"t").hexdigest()


def test_checkpoints_tolerate_an_unfinished_tail_only(spark, tmp_path):
    path = tmp_path / "run.jsonl"
    path.write_text('{"type": "metadata"}\n{"type": "dispatch", "requestId": "a"}\n{"type": "obs')
    assert [r.type for r in files.read_events(spark, f"file://{path}").orderBy("line").collect()] == ["metadata", "dispatch"]
    path.write_text('{"type": "metadata"}\nbroken\n{"type": "complete"}\n')
    assert [(r.line, r.type) for r in files.read_events(spark, f"file://{path}", skip_bad=True).orderBy("line").collect()] == [(1, "metadata"), (3, "complete")]
    with pytest.raises(Exception, match="malformed"):
        files.read_events(spark, f"file://{path}").collect()
    assert files.inventory(spark, f"file://{tmp_path}").count() == 1


def test_sinks(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", 3)], "z int, a string, m int")
    assert [r.value for r in files.canonical_lines(df).collect()] == ['{"a":"b","m":null,"z":1}', '{"a":"a","m":3,"z":2}']
    nested = df.select(F.struct(F.col("z").alias("y"), F.array(F.struct(F.col("a").alias("q"), F.col("m").alias("b"))).alias("c")).alias("v"), F.create_map(F.lit("k2"), "a", F.lit("k1"), "a").alias("k"))
    assert nested.transform(files.canonical_lines).first().value == '{"k":{"k1":"b","k2":"b"},"v":{"c":[{"b":null,"q":"b"}],"y":1}}'
    assert df.select(files.storable(F.expr("cast(x'6100ff62' as string)")).alias("x")).first().x == "a\ufffdb"
    old, new = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k int, v string, t int"), spark.createDataFrame([(2, "new", 2), (3, "new", 2)], "k int, v string, t int")
    assert sorted((r.k, r.v) for r in files.upsert(old, new, ["k"], "t").collect()) == [(1, "old"), (2, "new"), (3, "new")]
    assert sorted((r.k, r.v) for r in files.insert_missing(old, new, ["k"]).collect()) == [(1, "old"), (2, "old"), (3, "new")]


def test_csv_checkpoints_and_reports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body,label\n1,"two\nlines, ""quoted""",bad\n2,plain,ok\n')
    rows = files.read_csv(spark, f"file://{tmp_path}/a.csv", "body", F.col("label") == "bad", "id").orderBy("case_id").collect()
    assert [(r.case_id, r.text, r.positive) for r in rows] == [("1", 'two\nlines, "quoted"', True), ("2", "plain", False)]
    planned = spark.createDataFrame([(i, "m", None) for i in range(5)], "segment int, model string, prompt string")
    for part in ((0, 1), (3,)):
        files.append_run(planned.where(F.col("segment").isin(*part)), f"file://{tmp_path}/run", "r1")
    done = spark.read.parquet(f"file://{tmp_path}/run")
    assert sorted(r.segment for r in files.unfinished(planned, done, ["segment"], ["model", "prompt"]).collect()) == [2, 4]
    with pytest.raises(ValueError):
        files.unfinished(planned.withColumn("prompt", F.lit("p")), done, ["segment"], ["model", "prompt"])
    lines = [r.value for r in files.report_lines(spark.createDataFrame([(2, "b|c"), (1, None)], "n int, s string"), ["n"]).collect()]
    assert lines == ["| n | s |", "| --- | --- |", "| 1 |  |", "| 2 | b\\|c |"]


def test_paired_bootstrap_is_that_of_redrawn_cases(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(g, bool(i % 3 == 0), bool(rng.random() < 0.7), bool(rng.random() < 0.5)) for g in ("x", "y") for i in range(60)]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, d string, y boolean, a boolean, b boolean")
    got = statistics.paired_bootstrap(df, ["g"], "d", "y", "a", "b", reps=3000).first()
    scored = df.select("g", "d", "y", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    area = statistics.paired_bootstrap(scored, ["g"], "d", "y", "a", "b", kind="auroc", reps=3000).first()

    def accuracy(part, at):
        return np.mean([np.mean([r[at] for r in part if r[1]]), np.mean([not r[at] for r in part if not r[1]])])

    def gap(parts):
        return np.mean([accuracy(p, 2) - accuracy(p, 3) for p in parts])

    parts = [[r for r in rows if r[0] == g] for g in ("x", "y")]
    sides = [[[r for r in p if r[1] == y] for y in (True, False)] for p in parts]
    drawn = [gap([[s[i] for s in two for i in rng.integers(0, len(s), len(s))] for two in sides]) for _ in range(1500)]
    low, high = np.percentile(drawn, [2.5, 97.5])
    assert got.cases == 120 and abs(got.estimate - gap(parts)) < 1e-12 and abs(got.lower - low) < 0.03 and abs(got.upper - high) < 0.03
    assert abs(area.estimate - got.estimate) < 1e-12  # of flags the area is the balanced accuracy


def test_cluster_bootstrap_over_shares_is_that_of_redrawn_clusters(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    clusters = [(None if g == 1 else "g", f"c{i}", int(rng.integers(-3, 4)), int(rng.integers(1, 5))) for g in (0, 1) for i in range(120)]
    df = spark.createDataFrame(clusters, "g string, f string, v int, w int")
    monkeypatch.setattr(statistics, "SHARE_CLUSTERS", 10)  # twelve shares a group
    got = {r.g: r for r in statistics.cluster_bootstrap(df, ["g"], "f", "v", "w", reps=2000).collect()}
    assert len(got) == 2
    for g, row in got.items():
        v, w = (np.array([c[i] for c in clusters if c[0] == g]) for i in (2, 3))
        pick = rng.integers(0, 120, (4000, 120))
        low, high = np.percentile(v[pick].sum(1) / w[pick].sum(1), [2.5, 97.5])
        assert row.clusters == 120 and abs(row.estimate - v.sum() / w.sum()) < 1e-12
        assert abs(row.lower - low) < 0.03 and abs(row.upper - high) < 0.03


def test_two_sided_p(spark):
    rows = spark.createDataFrame([(z,) for z in (0.0, -0.3, 1.96, -4.5, 8.0, 60.0)] + [(None,)], "z double")
    for r in rows.select("z", statistics.two_sided("z").alias("p")).collect():
        assert r.p is None if r.z is None else abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-9


def test_contrast_and_cross_validation_agree_with_plain_fits(spark):
    import hashlib

    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(s, int(rng.integers(0, 12)), float(rng.random()), float(rng.integers(0, 2)), int(rng.random() < 0.5) if s != "c" else 1) for s in ("a", "b", "c") for _ in range(50)]
    df = spark.createDataFrame(rows, "s string, k int, x double, arm double, y int")

    def slopes(part, pick):
        names = sorted({r[0] for r in part})
        x = np.array([[float(r[0] == n) for n in names] + pick(r) for r in part])
        y, beta, ridge = np.array([r[4] for r in part]), np.zeros(len(names) + 2), np.array([0.1] * len(names) + [0.01] * 2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (y - p) - ridge * beta)
        return beta[len(names) :]

    both = [r for r in rows if r[0] != "c"]  # the third stratum has one label only
    assert abs(statistics.log_odds_ratio(df, "s", "arm", ["x"], "y") - slopes(both, lambda r: [r[3], r[2]])[0]) < 1e-6
    assert statistics.log_odds_ratio(df.where("s = 'c'"), "s", "arm", ["x"], "y") is None
    fold = lambda r: int(hashlib.sha256(f"{r[0]}|{r[1]}".encode()).hexdigest()[:8], 16) % 5
    fits = [slopes([r for r in rows if fold(r) != k], lambda r: [r[2], r[3]]) for k in range(5)]
    want = sorted((r[0], r[1], fold(r), round(float(fits[fold(r)] @ [r[2], r[3]]), 6)) for r in rows)
    got = statistics.cross_validated(df, "s", "k", ["x", "arm"], "y")
    assert sorted((r.s, r.k, r.fold, round(r.out_of_fold, 6)) for r in got.collect()) == want
    pairs = [(p, n) for p in got.collect() for n in got.collect() if p.s == n.s and p.y == 1 and n.y == 0]
    share = sum(1.0 if p.out_of_fold > n.out_of_fold else 0.5 if p.out_of_fold == n.out_of_fold else 0.0 for p, n in pairs) / len(pairs)
    found = statistics.within_strata_auroc(got.withColumn("pos", F.col("y") == 1), "out_of_fold", "pos", "s").first()
    assert found.pairs == len(pairs) and abs(found.auroc - share) < 1e-6


def test_streams_drop_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:06", "b")], "at string, k string").select(F.to_timestamp("at").alias("at"), "k")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = streams.first_of(streams.read_table(spark, f"file://{tmp_path}/in"), ["k"], "at")
    assert sorted(r.k for r in streams.drain(stream, resume=f"file://{tmp_path}/out").collect()) == ["a", "b"]


def test_derivations_refuse_what_is_ambiguous(spark):
    kind = "k string, seg string, b int, e int, score double"
    target = spark.createDataFrame([("x", "t1", 0, 4, None), ("x", "t2", 4, 8, None), ("y", "t3", None, None, None), ("z", "t4", 0, 4, None), ("w", "t5", 0, 4, None), (None, "t6", 0, 4, None), ("v", "t7", 0, 4, None), ("v", "t8", 0, 4, None)], kind)
    source = spark.createDataFrame([("x", "s1", 0, 4, 0.1), ("x", "s2", 4, 8, 0.2), ("y", "s3", 8, 12, 0.3), ("z", "s4", 0, 5, 0.4), ("w", "s5", 0, 4, 0.5), ("w", "s6", None, None, 0.6), (None, "s7", None, 3, 0.7), ("v", "s8", 0, 4, 0.8)], kind)
    found = assembly.derive(target, source, ["k"], "seg", "b", "e")
    want = {"t1": ("s1", "derived"), "t2": ("s2", "derived"), "t3": ("s3", "derived"), "t4": (None, "missing"), "t5": (None, "ambiguous"), "t6": ("s7", "derived"), "t7": (None, "ambiguous"), "t8": (None, "ambiguous")}
    assert {r.seg: (r.source, r.status) for r in found.collect()} == want
    run = assembly.derived_run(found.where("status = 'derived'"), source.withColumn("run", F.lit("old")), "seg", {"run": F.lit("new")}).collect()
    assert sorted((r.seg, r.source_segment, r.run, r.score) for r in run) == [("t1", "s1", "new", 0.1), ("t2", "s2", "new", 0.2), ("t3", "s3", "new", 0.3), ("t6", "s7", "new", 0.7)]
    with pytest.raises(Exception, match="is ambiguous|is missing"):
        assembly.derived_run(found, source, "seg", {}).collect()


def test_prefixes_meet_without_a_nested_loop(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/bc",), ("é/x",), ("",), (None,)], "path string")
    joined = assembly.prefix_join(paths, "path", spark.createDataFrame([("a/b",), ("a/b",), ("é",), ("",), ("a/b/c/d",), (None,)], "p string"), "p")
    assert sorted((r.path, r.p) for r in joined.collect()) == sorted([("a/b/c", "a/b"), ("a/bc", "a/b"), ("é/x", "é"), *[(x, "") for x in ("a/b/c", "a/bc", "é/x", "")]])
    many = spark.range(100000).selectExpr("concat('run/', id) AS path")
    plan = assembly.prefix_join(many, "path", many.selectExpr("left(path, 6) AS p"), "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") == 1 and "lengths_" in plan.split("NestedLoop")[1][:400]  # the one row of lengths


def test_redaction_is_longest_first_over_all_spans(spark):
    a, b, c, d = "aa" * 12, "bb", "C" * 40, "D" * 60
    texts = [f"{a} {b} {c} {d}", f"x {c} {d} y", f"{a} {b} {c}", "none"]
    spans = [f"{a} {b} {c}", f"{c} {d}", "Z" * 50]
    for batch in (1, 1000):
        found = [r.redacted for r in turns.redact(docs(spark, texts), spark.createDataFrame([(s,) for s in spans], "text string"), batch=batch).orderBy("case_id").collect()]
        plain = []
        for t in texts:
            for s in sorted(spans, key=len, reverse=True):
                t = t.replace(s, " ")
            plain.append(t)
        assert found == plain and found[0] == f"{a} {b}  "
    left = spark.createDataFrame([(" \n",), ("x",), (None,)], "t string").select(turns.has_unauthored("t").alias("v")).collect()
    assert [r.v for r in left] == [False, True, False]


def test_managed_filters_fail_closed(spark):
    ok = ("pi_and_jailbreak", "EXECUTION_SUCCESS", "NO_MATCH_FOUND")
    rows = [
        ([ok], "NO_MATCH_FOUND", "SUCCESS", (False, False, 0.0, "BENIGN", [])),
        ([("pi_and_jailbreak", "EXECUTION_SUCCESS", "MATCH_FOUND"), ("rai", "EXECUTION_SUCCESS", "NO_MATCH_FOUND")], "MATCH_FOUND", "SUCCESS", (True, True, 1.0, "MALICIOUS", ["pi_and_jailbreak"])),
        ([ok, ("rai", "EXECUTION_SUCCESS", "MATCH_FOUND")], "MATCH_FOUND", "SUCCESS", (False, True, 0.0, "CONTENT_BLOCKED", ["rai"])),
        ([ok], "MATCH_FOUND", "SUCCESS", (False, True, 0.0, "CONTENT_BLOCKED", ["unknown"])),
        ([], "NO_MATCH_FOUND", "SUCCESS", None), (None, "NO_MATCH_FOUND", "SUCCESS", None), ([ok], "NO_MATCH_FOUND", "PARTIAL", None), ([ok], "NO_MATCH_FOUND", None, None), ([ok], None, "SUCCESS", None), ([ok], "ODD", "SUCCESS", None),
        ([("rai", "EXECUTION_SUCCESS", "NO_MATCH_FOUND")], "NO_MATCH_FOUND", "SUCCESS", None), ([ok, ("rai", "EXECUTION_SKIPPED", "NO_MATCH_FOUND")], "NO_MATCH_FOUND", "SUCCESS", None),
        ([ok, ("rai", None, "NO_MATCH_FOUND")], "NO_MATCH_FOUND", "SUCCESS", None), ([ok, ("rai", "EXECUTION_SUCCESS", "MATCH_STATE_UNSPECIFIED")], "NO_MATCH_FOUND", "SUCCESS", None), ([ok, ("rai", "EXECUTION_SUCCESS", None)], "NO_MATCH_FOUND", "SUCCESS", None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, f array<struct<name:string,state:string,match:string>>, overall string, called string")
    found = df.select("i", *[c.alias(n) for n, c in scoring.managed_filter("f", "overall", "called").items()]).orderBy("i").collect()
    for r, (*_, want) in zip(found, rows, strict=True):
        assert r.inconclusive == (want is None) and (r.flagged, r.blocked, r.score, r.label, r.matched) == (want or (None,) * 5)


def test_missing_members_and_wrong_parents_are_errors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, member string")
    assert assembly.require_members(rows, "member", ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="missing: c, d"):
        assembly.require_members(rows, "member", ["a", "c", "d"]).collect()
    original = spark.createDataFrame([(1, True, True)], "case_id int, positive boolean, flagged boolean")
    for parent, positive, told in ((1, True, None), (2, True, "no parent"), (1, False, "another label")):
        changed = spark.createDataFrame([(9, parent, positive, False)], "case_id int, parent_case int, positive boolean, flagged boolean")
        pairs = assembly.parent_pairs(original, changed, [])
        if told:
            with pytest.raises(Exception, match=told):
                pairs.collect()
        else:
            assert [(r.original, r.transformed) for r in pairs.collect()] == [(True, False)]


def test_actions_without_a_tool_are_flagged(spark):
    kind = "action_id int, tool string, path string, sources array<string>"
    origins = spark.createDataFrame([("op", "operator")], "source_id string, origin string")
    found = behavior.action_provenance(spark.createDataFrame([(1, None, "/to", ["op"]), (2, "go", "/to", ["op"])], kind), origins, {"go": ["/to"]}).collect()
    assert sorted((r.action_id, r.flagged, r.reasons) for r in found) == [(1, True, ["tool_not_allowed"]), (2, False, [])]
    more = spark.createDataFrame([(1, None, "{}", None), (2, " ", None, None), (3, "go", '{"to":null}', None), (4, "go", '{"other":1}', None), (5, "go", "not json", None)], "action_id int, tool string, arguments string, sources map<string,array<string>>")
    found = {r.action_id: (r.flagged, r.reasons, [tuple(e) for e in r.evidence]) for r in behavior.assess_actions(more, origins, ["go"], {"go": ["/to"]}).collect()}
    assert found == {1: (True, ["tool_not_allowed"], []), 2: (True, ["tool_not_allowed"], []), 3: (True, ["missing_provenance"], [("/to", [])]), 4: (False, [], []), 5: (False, [], [])}


def test_extensions_in_capitals(spark):
    paths = {"docs/FIG.PNG": ("figure", "image/png"), "run.LOG": ("console_log", "text/plain"), "readme.MD": ("report", "text/markdown"), "a/.png": ("other", "application/octet-stream"), "a.b/none": ("other", "application/octet-stream"), "x.JSONL": ("other", "application/x-ndjson")}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.artifact_kind("path").alias("kind"), files.content_type("path").alias("type"))
    found = {r.path: (r.kind, r.type) for r in rows.collect()}
    assert found == paths


def test_two_queries_of_one_name_are_an_error():
    from trivalent.plans import catalog, registry

    assert catalog.QUERIES is registry.QUERIES
    with pytest.raises(ValueError, match="two queries"):
        registry.query()(next(iter(registry.QUERIES.values())))


# ---- Catalog


def test_every_action_has_its_provenance(spark, tmp_path):
    from trivalent.plans import catalog

    events = [(i, t) for i, t in enumerate(["click", "purchase", "view", "purchase", "purchase", "purchase", "signup"] * 2, 1996)]
    spark.createDataFrame(events, "event_id long, event_type string").write.parquet(f"file://{tmp_path}/events.parquet")
    want = []
    for i, tool in events:
        sources = [["none"], ["ext"], ["op"], ["ext", "who"]][i % 4]
        reasons = {"none": ["missing_provenance"], "ext": ["external_controls_protected_argument"], "op": [], "who": ["unknown_source"]}
        found = sorted({r for s in sources for r in reasons[s]}) if tool == "purchase" else [] if tool == "click" else ["tool_not_allowed"]
        want.append((i, ",".join(found), bool(found)))
    assert sorted(tuple(r) for r in catalog.QUERIES["action_provenance"](spark, f"file://{tmp_path}").collect()) == want


def test_whole_tables_reach_substitution_containment_and_upsert(spark, tmp_path):
    from trivalent.plans import catalog

    run = lambda name: sorted(tuple(r) for r in catalog.QUERIES[name](spark, f"file://{tmp_path}").collect())
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
    write([(i, f"t{i}") for i in range(4, 9)], "item_id long, text string", "benchmark")
    wordings = ("score {n}", "rate it {n}", "give {n} of 1", "{n} is the grade")
    assert run("numeral_substitution") == sorted((i, v, w, f"t{i} " + w.replace("{n}", str(v))) for i in range(4, 9) for v in (0.1, 0.25, 0.9) for w in wordings)
    write([(i, "x" * n) for i, n in enumerate([350, 350, 350, 40, 199])], "doc_id long, text string", "documents")
    assert run("span_containment") == [(i, 100, 300) for i in (0, 1, 2, 4)]
    write([(i, "F") for i in range(7)], "o_orderkey long, o_orderstatus string", "orders")
    assert run("upsert_merge") == [(i, "F" if i % 3 == 0 else "new") for i in range(7)]


#: Queries without SQL, and the test that holds each.
WITHOUT_SQL = {"family_bootstrap_joint", "shared_redraws_ba", "shared_redraws_auroc", "nested_bootstrap_means", "bootstrap_auroc", "bootstrap_balanced_accuracy", "cluster_bootstrap", "contrast_log_odds", "cross_validated_auroc", "wilcoxon_p", "family_bootstrap_exact", "stratified_logit"}


def test_catalog_against_duckdb(spark):
    import glob
    import os

    import duckdb

    from trivalent.plans import catalog

    db = duckdb.connect()
    for p in glob.glob("/root/testdata/sf0.001/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def norm(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple("null" if r[i] is None else repr(round(float(r[i]), 7)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)

    for name in sorted(catalog.QUERIES):
        got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
        if name in catalog.ORACLE_SQL:
            want = db.sql(catalog.ORACLE_SQL[name])
            assert norm(got.collect(), got.columns) == norm(want.fetchall(), want.columns), name
        else:
            assert name in WITHOUT_SQL
            assert got.count() > 0, name
