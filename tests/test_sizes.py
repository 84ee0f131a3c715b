"""Results at ties and of rare combinations, and work that is dealt out, on tables made for it."""

import itertools
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from trivalent.operators import assembly, behavior, metrics
from trivalent.plans import catalog
from trivalent.streaming import audit as live


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle into 16 partitions that stay as they are."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def differing(spark, tmp_path):
    """Of a catalog query on tables (name: rows and schema), the rows that only Spark and only DuckDB give."""

    def compared(name, **tables):
        db = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, f"file://{tmp_path}")
        want = db.sql(catalog.ORACLE_SQL[name])
        got, want = Counter(map(tuple, got.select(*want.columns).collect())), Counter(want.fetchall())
        assert want
        return got - want, want - got

    return compared


def _cases(*sizes):
    """Documents of so many words and their labels."""
    docs = [(i, " ".join(["w"] * n), "en", "s", 2 * n - 1) for i, n in sizes]
    return {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(i, 1, i % 2) for i, _ in sizes], "doc_id long, quality int, toxic int")}


def test_a_segment_of_which_nothing_is_written_but_an_error_is_audited(differing):
    ids = [561500, 561500 + 23 * 29 * 41 * 43, 561501, 2 + 29 * 23, 24, 31]  # the first two are not planned, and have no dispatch, response or observation
    assert differing("checkpoint_audit", events=([(i, i % 7) for i in ids], "event_id long, user_id long")) == (Counter(), Counter())


def test_two_readings_of_a_mean_at_the_threshold(differing):
    """The scores of case 463's fourteen windows make 7.000000000000001 one by one."""
    assert differing("verdict_two_reading", **_cases((463, 14 * 64), (2532, 40 * 64), (5, 100))) == (Counter(), Counter())


def test_a_mean_of_scores_at_the_threshold(differing):
    """The eight scores of cases 469 and 1470 make 3.6000000000000005 one by one, so their mean is over 0.45."""
    assert differing("screened_scores", **_cases((469, 256), (1470, 256), (7, 256), (8, 700))) == (Counter(), Counter())


def test_links_of_one_prefix_are_many_tasks(shuffled):
    links = shuffled.createDataFrame([(i, None, "runs/1") for i in range(300)] + [(300, 7, None), (301, 99, None), (302, None, "none"), (303, None, None), (304, 8, "runs/1")], "link long, run long, path_prefix string")
    runs = shuffled.createDataFrame([(r, f"run-{r}") for r in range(20)], "run long, run_id string")
    artifacts = shuffled.createDataFrame([(f"runs/1{r}/{k}", r) for r in range(20) for k in range(2)], "path string, run long")
    found = assembly.evidence(links, runs, artifacts).select("link", "run", "run_id", F.spark_partition_id().alias("task")).collect()
    want = [(i, r, f"run-{r}") for i, r in itertools.product(range(300), range(20))] + [(300, 7, "run-7"), (301, 99, None), (302, None, None), (303, None, None)] + [(304, 8, "run-8")] * 20
    assert sorted(map(str, ((r.link, r.run, r.run_id) for r in found))) == sorted(map(str, want))
    assert len({r.task for r in found if r.link < 300}) > 4


class Store:
    """A value and a map of the state store in memory, with the number of calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


def test_a_batch_calls_the_state_store_for_pages_not_for_entries(monkeypatch):
    store, rng, plain = Store(), random.Random(2), live.Notes()
    notes = live.StoredNotes(store, store)
    for i in range(1000):
        notes.first("asked", f"k{i}", (None, f"v{i}"))
    notes.write()
    assert store.calls == 3  # what is there, a page, what is there now
    monkeypatch.setattr(live, "PAGE", 20)
    store = Store()
    for _ in range(40):
        notes = live.StoredNotes(store, store)
        for _ in range(30):
            at = rng.choice(["a", "b"]), rng.choice([None, *map(str, range(300))])
            assert notes.get(*at) == plain.get(*at)
            for n in (notes, plain):
                n.first(*at, (at[1], "x\u2028\"" + at[0]))
        notes.write()
    assert store.value[1] == len(plain.entries) and store.value[0] * 20 >= len(plain.entries) and len(store.map) == store.value[0]


def test_derivation_moves_no_segment_of_what_is_dealt_out_by_a_key(shuffled):
    rows = shuffled.createDataFrame([(c, str(i % 3), i) for c in range(6) for i in range(5)], "k long, sha string, seg long").repartition("k").withColumns({"b": F.col("seg"), "e": F.col("seg") + 1})
    found = assembly.derive(rows.where("seg < 4"), rows.where("seg > 0").withColumn("b", F.when(F.col("seg") != 3, F.col("b"))), ["k", "sha"], "seg", "b", "e")
    want = {0: (None, "ambiguous"), 1: (1, "derived"), 2: (2, "derived"), 3: (None, "ambiguous")}  # as a source 3 has no place, so it is a match of both 0 and 3
    assert sorted(map(tuple, found.collect())) == sorted((seg, *x) for seg, x in want.items() for _ in range(6))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # one for each side's rows


def test_payloads_after_a_very_long_word_take_no_square_of_its_length(spark):
    head = "x" * 400_000 + " half"
    df = spark.createDataFrame([(head + "word and more", head + "XYZ word and more"), ("ab", None)], "c string, a string")
    began = time.perf_counter()
    found = behavior.payload_span(df, "c", "a").select("start", "stop", "payload").collect()
    assert sorted(map(tuple, found), key=str) == [(400_001, 400_009, "halfXYZ "), (None, None, None)]
    assert time.perf_counter() - began < 30


def test_pairs_of_runs_are_made_last_and_by_shares(shuffled):
    rows = [(r, "e", "r", "d", "all", "all", None if r % 2 else 5, "full_text" if r % 3 else "window", r % 3 != 1) for r in range(24)]
    runs = shuffled.createDataFrame(rows, "run long, engine string, rule string, dataset string, selector string, turn_selection string, case_limit long, strategy string, segmenting boolean")
    seen = [(r, c, (r + c) % 3 == 0) for r in range(24) for c in range(r % 4, 5)]
    found = metrics.full_and_window_runs(runs, shuffled.createDataFrame(seen, "run long, case_id long, flagged boolean"))
    want = [(f[0], w[0], c, x, y) for f, w in itertools.product(rows, rows) if f[7] == "full_text" and w[8] and f[6] == w[6] and f[0] != w[0] for r, c, x in seen if r == f[0] for s, d, y in seen if (s, d) == (w[0], c)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    last = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)
    assert "share_" in last and len({r.task for r in found.select(F.spark_partition_id().alias("task")).collect()}) > 4
