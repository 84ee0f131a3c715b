"""Screenings, orders, tranches, ledgers, late links, comparisons and seeds against plain versions."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trivalent.operators import ledgers, ordering, screening
from trivalent.sources import files, lines

SLIDING = {"kind": "sliding_word_window", "window": 2, "stride": 1}


def test_numbers_are_those_of_a_plain_sort_whatever_is_shared(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.choice(["x", "y", None]), i) for i in range(500)] + [(1, "x", 7)] * 3
    df = spark.createDataFrame(rows, "a int, b string, c int").withColumn("m", F.create_map(F.lit("k"), "c"))
    got = sorted((r.nth, r.a, r.b, r.c) for r in ordering.numbered(df, [F.desc("a"), "b", "c"]).collect())
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2])
    assert [g[1:] for g in got] == sorted(rows, key=key)
    tied = ordering.numbered(df, ["a"])
    assert sorted(r.nth for r in tied.collect()) == list(range(1, len(rows) + 1))
    assert ordering.numbered(df.where("c < 0"), ["a"]).count() == 0
    for n in (1, 17, len(rows), len(rows) + 9):
        assert sorted(r.c for r in ordering.first(df, [F.desc("a"), "b", "c"], n).collect()) == sorted(r[2] for r in sorted(rows, key=key)[:n])
    with pytest.raises(ValueError):
        ordering.first(df, ["a"], 0)


def test_files_in_order_and_the_first_of_them(spark, tmp_path):
    df = spark.createDataFrame([(i * 37 % 101, None if i % 9 == 0 else "v") for i in range(101)], "k int, v string")
    for n, name in ((None, "all"), (30, "some")):
        ordering.write_ordered(df, f"{tmp_path}/{name}", ["k"], n)
        found = lines.read_lines(spark, f"{tmp_path}/{name}", 64).where("text <> ''").select("file", "line", F.get_json_object("text", "$.k").cast("int").alias("k"), F.contains("text", F.lit('"v":')).alias("v")).collect()
        found.sort(key=lambda r: (r.file, r.line))
        assert [r.k for r in found] == list(range(n or 101)) and all(r.v for r in found)


def test_tranches_take_what_is_next_and_say_how_the_run_stands(spark, tmp_path):
    planned = spark.createDataFrame([(c, i) for c in range(7) for i in range(3)], "case_id long, idx long")
    kind = "case_id long, idx long, outcome string, run_id string"
    done, seen, says = spark.createDataFrame([], kind), [], []
    assert ordering.standing(planned, done, ["case_id", "idx"]).first().asDict() == {"expected": 21, "scored": 0, "abstained": 0, "status": "checkpointed_tranche"}
    while True:
        some = ordering.tranche(planned, done, ["case_id", "idx"], ["idx", "case_id"], 8)
        answered = some.withColumn("outcome", F.when(F.col("case_id") == 6, "abstained").otherwise("scored"))
        files.append_run(answered, f"{tmp_path}/run", f"t{len(seen)}")
        before, done = done, spark.read.schema(kind).parquet(f"{tmp_path}/run")
        new = sorted((r.idx, r.case_id) for r in done.join(before, ["case_id", "idx"], "left_anti").collect())
        if not new:
            break
        seen.append(new)
        says.append(ordering.standing(planned, done, ["case_id", "idx"]).first().status)
    assert list(itertools.chain(*seen)) == sorted((i, c) for c in range(7) for i in range(3)) and [len(s) for s in seen] == [8, 8, 5]
    assert says == ["checkpointed_tranche", "checkpointed_tranche", "finished_with_abstentions"]
    better = done.withColumn("outcome", F.lit("scored"))
    assert ordering.standing(planned, done.unionByName(better), ["case_id", "idx"]).first().status == "complete"


def _plain_ledger(entries):
    batches, cells, current, opened = [], [], None, {}
    for line, kind, key in entries:
        if kind == "batch_start":
            current, opened = [line, None], {}
            batches.append(current)
        elif current is None:
            continue
        elif kind == "batch_finish":
            current[1] = line
        elif kind == "condition_start":
            opened[key] = [current[0], line, None, False, key]
            cells.append(opened[key])
        elif kind == "condition_finish" and key in opened:
            opened.pop(key)[2] = line
        elif kind == "budget_stop":
            cells.append([current[0], line, None, True, key])
    return sorted(map(tuple, batches)), sorted(map(tuple, cells))


@pytest.mark.parametrize("seed", range(4))
def test_ledgers_over_blocks_agree_with_reading_line_by_line(spark, seed):
    rng = random.Random(seed)
    kinds = ["batch_start", "batch_finish", "condition_start", "condition_start", "condition_finish", "condition_finish", "budget_stop", "note"]
    made = {name: [(n, rng.choice(kinds), rng.choice(["a", "b", None])) for n in sorted(rng.sample(range(400), size))] for name, size in (("hot", 200), ("b", 30), (None, 20), ("none", 0))}
    rows = [(name, n, kind, key, "c") for name, entries in made.items() for n, kind, key in entries]
    df = spark.createDataFrame(rows, "ledger string, line long, type string, test string, condition string")
    for block in (7, 100_000):
        batches, cells = (x.collect() for x in ledgers.batches_and_cells(df, block))
        for name, entries in made.items():
            want = _plain_ledger(entries)
            assert sorted((r.start_line, r.finish_line) for r in batches if r.ledger == name) == want[0]
            assert sorted((r.start_line, r.line, r.finish_line, r.budget_stopped, r.test) for r in cells if r.ledger == name) == want[1]


def test_links_fill_only_what_is_open_and_never_point_at_themselves(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None), (4, None, None), (5, "a", 99), (6, "z", None)], "id long, k string, link long")
    found = rows.select("id", "k").union(spark.createDataFrame([(1, "a"), (None, "b"), (8, None)], "id long, k string"))
    got = {r.id: r.link for r in ledgers.resolve(rows, "link", found, {"k": "k"}, "id", other_than="id").collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None, 5: 99, 6: None}
    assert {r.id: r.link for r in ledgers.resolve(rows, "link", found, {"k": "k"}, "id").collect()} == {1: 1, 2: 1, 3: 3, 4: None, 5: 99, 6: 6}
    assert ledgers.resolve(rows.where("id < 0"), "link", found, {"k": "k"}, "id").count() == 0


def test_runs_are_compared_whole_or_not_at_all(spark):
    kind = "dataset string, case_id long, positive boolean, flagged boolean"
    a = [("d", 1, True, True), ("d", 2, True, False), ("d", 3, False, True), ("d", 4, False, False), ("only", 9, True, True)]
    b = [("d", 1, True, True), ("d", 2, True, True), ("d", 3, False, False), ("d", 4, False, False)]
    df = lambda rows: spark.createDataFrame(rows, kind)
    got = {r.positive: (r.both, r.a_only, r.b_only, r.neither) for r in ledgers.compare_runs(df(a), df(b), ["dataset"]).collect()}
    assert got == {True: (1, 0, 1, 0), False: (0, 1, 0, 1)}
    assert ledgers.compare_runs(df(a), df([]), ["dataset"]).count() == 0
    for bad in (b[:-1], b[:-1] + [("d", 4, True, False)], b[:-1] + [("d", 4, False, None)], b + [("d", 5, True, True)]):
        for pair in ((df(a), df(bad)), (df(bad), df(a))):
            with pytest.raises(PySparkException, match="paired cohort differs"):
                ledgers.compare_runs(*pair, ["dataset"]).collect()


def test_seeds_need_the_same_input_turns_context_and_configuration(spark):
    kind = "run_id string, case_id long, segment_id string, text_sha256 string, context_sha256 string, turn_ids array<string>, model string"
    base = ("new", 1, "1/0", "h", None, ["t"], "m")
    old = lambda line=1, **k: {**dict(zip(["run_id", "case_id", "segment_id", "text_sha256", "context_sha256", "turn_ids", "model"], ("old", 1, "1/0", "h", None, ["t"], "m"), strict=True)), "line": line, "request_id": f"q{line}", "score": line / 10} | k
    source = lambda *rows: spark.createDataFrame([tuple(r[c] for c in [*old()]) for r in rows], kind + ", line long, request_id string, score double")
    targets = spark.createDataFrame([base], kind)
    got = ledgers.seeded(targets, source(old(1), old(2)), ["model"]).collect()
    assert [(r.segment_id, r.source_run_id, r.source_segment_id, r.source_request_id, r.score) for r in got] == [("1/0", "old", "1/0", "q2", 0.2)]
    others = [{"text_sha256": "x"}, {"text_sha256": None}, {"context_sha256": "c"}, {"turn_ids": None}, {"turn_ids": ["t", "u"]}, {"model": "n"}, {"model": None}, {"run_id": "new"}, {"case_id": 2}]
    for other in others:
        with pytest.raises(ValueError, match="no answer"):
            ledgers.seeded(targets, source(old(1, **other)), ["model"])
    with pytest.raises(ValueError, match="no answer"):  # the last answer counts, not the last that fits
        ledgers.seeded(targets, source(old(1), old(2, text_sha256="x")), ["model"])
    two = targets.union(spark.createDataFrame([("new", 1, "1/1", "h", None, ["t"], "m")], kind))
    with pytest.raises(ValueError, match="several"):
        ledgers.seeded(two, source(old(1)), ["model"])
    assert [(r.source_segment_id, r.segments) for r in ledgers.seeds(two, source(old(1)), ["model"])[1].collect()] == [("1/0", 2)]


def test_techniques_and_aggregators_are_refused_unless_sound():
    good = [{"kind": "full_text"}, {"kind": "decoded_preview_v1"}, SLIDING, {"kind": "random_word_chunks", "low": 1, "high": 1, "seed": -4}, {"kind": "cascade", "first": {"kind": "full_text"}, "then": SLIDING}]
    for technique in good:
        screening.validate_technique(technique)
    bad = [{}, {"kind": "other"}, {"kind": "sliding_word_window", "window": 2, "stride": 3}, {"kind": "sliding_word_window", "window": 2.0, "stride": 1}, {"kind": "sliding_word_window", "window": 2}]
    bad += [{"kind": "random_word_chunks", "low": 0, "high": 2}, {"kind": "random_word_chunks", "low": 3, "high": 2}, {"kind": "random_word_chunks", "low": 1, "high": 2, "seed": 0.5}, {"kind": "random_word_chunks", "low": True, "high": 2}]
    bad += [{"kind": "cascade", "first": SLIDING}, {"kind": "cascade", "first": {"kind": "full_text"}, "then": {"kind": "full_text"}}, {"kind": "cascade", "first": good[-1], "then": SLIDING}, {"kind": "cascade", "first": {"kind": "x"}, "then": SLIDING}]
    for technique in bad:
        with pytest.raises(ValueError):
            screening.validate_technique(technique)
    for rule in ("any", "all", {"reduce": "max", "threshold": 0}, {"reduce": "min", "threshold": 1.0, "comparator": ">="}):
        screening.validate_aggregator(rule)
    for rule in ("some", {}, {"reduce": "median", "threshold": 0.5}, {"reduce": "max", "threshold": 1.1}, {"reduce": "max"}, {"reduce": "max", "threshold": float("nan")}, {"reduce": "max", "threshold": 0.5, "comparator": "<"}, {"reduce": "max", "threshold": True}):
        with pytest.raises(ValueError):
            screening.validate_aggregator(rule)


#: Words that a judge answers by: (flagged, score, other content); `?` is no verdict.
SAYS = {"bad": (True, 0.9, False), "blk": (False, 0.2, True), "ok": (False, 0.1, False), "mid": (False, 0.6, False), "?": (None, None, False)}


def _judge(segment, model):
    """The gravest word of a segment; the whole text hides `bad` from the first model where `veil` stands beside it."""
    words = segment.split()
    for w in ("bad", "blk", "?", "mid"):
        if w in words and not (w == "bad" and "veil" in words and model == "m"):
            return SAYS[w]
    return SAYS["ok"]


def _assess(rows):
    has = lambda w: F.array_contains(F.split("segment", " "), w)
    word = F.when(has("bad") & ~(has("veil") & (F.col("model") == "m")), "bad").when(has("blk"), "blk").when(has("?"), "?").when(has("mid"), "mid").otherwise("ok")
    said = lambda i: F.coalesce(*[F.when(F.col("word_") == w, F.lit(v[i])) for w, v in SAYS.items()])
    return rows.withColumn("word_", word).withColumns({"flagged": said(0), "score": said(1), "content_blocked": said(2)}).drop("word_")


def _mean(scores):
    return float(sum(Fraction(str(x)) for x in scores)) / len(scores)


def _plain_stage(segments, models, rule):
    found = [(m, i, *_judge(s, m)) for m in models for i, s in enumerate(segments)]
    def vote(fill):
        fs = [fill if f is None else f for _, _, f, _, _ in found]
        scores = [float(fill) if f is None else x for _, _, f, x, _ in found]
        if rule == "any":
            return any(fs)
        if rule == "all":
            return all(fs)
        value = {"max": max, "min": min, "mean": _mean}[rule["reduce"]](scores)
        return value >= rule["threshold"] if rule.get("comparator") == ">=" else value > rule["threshold"]
    known = [x for _, _, f, x, _ in found if f is not None]
    reduce = {"max": max, "min": min, "mean": _mean}[rule["reduce"] if isinstance(rule, dict) else "max"]
    first = next((i for _, i, f, _, _ in found if f), None)
    return {"flagged": vote(True) and vote(False), "open": vote(True) != vote(False), "score": reduce(known) if known else None, "blocked": any(b for *_, b in found), "chunks": len(segments), "first": first, "pending": len(found) - len(known)}


def _plain_screen(text, origin, boundary, technique, rule, models, undecided):
    if not (text or "").strip():
        return ("allow", None, False, False, None, 0, None, None)
    cut = lambda t: [text] if t["kind"] == "full_text" else [" ".join(text.split()[i : i + t["window"]]) for i in range(0, len(text.split()), t["stride"])]
    plan = [technique["first"], technique["then"]] if technique["kind"] == "cascade" else [technique]
    stages = []
    for t in plan:
        stages.append(_plain_stage(cut(t), models, rule))
        if stages[-1]["flagged"] or stages[-1]["blocked"]:
            break
    flagged, blocked = any(s["flagged"] for s in stages), any(s["blocked"] for s in stages)
    undec = not flagged and any(s["open"] for s in stages)
    scores = [s["score"] for s in stages if s["score"] is not None]
    label = "MALICIOUS" if flagged else "CONTENT_BLOCKED" if blocked else "INCONCLUSIVE" if undec else "BENIGN"
    decision = ("observe" if origin == "agent" else "quarantine" if boundary == "tool_output" else "block") if flagged else "block" if blocked else undecided if undec else "allow"
    by = None if len(plan) == 1 else "then" if len(stages) == 2 else "first"
    return (decision, label, flagged, undec and not blocked, max(scores) if scores else None, sum(s["chunks"] for s in stages), stages[-1]["first"] if flagged else None, by)


def test_screenings_agree_with_a_plain_one_text_by_text(spark):
    words = ["ok", "mid", "bad", "blk", "?", "veil"]
    texts = [None, "", " \n", *[" ".join(w) for n in (1, 2, 3) for w in itertools.product(words, repeat=n) if n < 3 or hash_of(w) % 3 == 0]]
    rows = [(i, t, ["agent", None, "external"][i % 3], [None, "tool_output"][i % 2], "old") for i, t in enumerate(texts)]
    cases = spark.createDataFrame(rows, "case_id long, text string, origin string, boundary string, label string").cache()
    cascade = {"kind": "cascade", "first": {"kind": "full_text"}, "then": SLIDING}
    for technique, rule, models in ((cascade, "any", ["m", "n"]), (cascade, "all", ["m"]), (SLIDING, {"reduce": "mean", "threshold": 0.5}, ["m", "n"]), (cascade, {"reduce": "min", "threshold": 0.1, "comparator": ">="}, ["m"]), ({"kind": "full_text"}, {"reduce": "max", "threshold": 0.6}, ["n"])):
        got = screening.screen(cases, technique, rule, [*models, models[0]], _assess, on_inconclusive="quarantine").collect()
        assert len(got) == len(rows)
        for r in got:
            _, text, origin, boundary, _ = rows[r.case_id]
            want = _plain_screen(text, origin, boundary, technique, rule, models, "quarantine")
            have = (r.decision, r.label, r.flagged, r.inconclusive, r.score, r.chunks, r.first_flag, r.decided_by)
            assert tuple(round(x, 9) if isinstance(x, float) else x for x in have) == tuple(round(x, 9) if isinstance(x, float) else x for x in want), (text, technique, rule)
    assert screening.screen(cases.where("case_id < 0"), cascade, "any", ["m"], _assess).count() == 0
    for wrong in ({"models": []}, {"on_inconclusive": "allow"}):
        with pytest.raises(ValueError):
            screening.screen(cases, cascade, "any", wrong.get("models", ["m"]), _assess, on_inconclusive=wrong.get("on_inconclusive", "block"))


def hash_of(words):
    return sum(len(w) * (i + 3) + ord(w[0]) for i, w in enumerate(words))
