"""Queries over whole screenings, orders and tranches, batch ledgers, late links, comparisons and seeded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions.text import sha
from trivalent.operators import ledgers, ordering, screening
from trivalent.plans import fixtures as fx
from trivalent.plans.decisions import strict
from trivalent.plans.registry import query
from trivalent.session import shared_dir
from trivalent.sources import files, lines
from trivalent.streaming import events as streams

_F = F.col

# ---- Whole screenings

_MODELS = ["m1", "m2"]
#: Answers by the segment's place and length: every thirteenth is none, some find other content.
_MIX = "(case_id * 7919 + idx * 104729 + nth * 613 + length(segment) * 31)"
_SCORE = f"({_MIX} % 1001 / 1000.0)"


def _assess(rows):
    have = F.expr(f"{_MIX} % 13 <> 0")
    return rows.withColumns({"score": F.when(have, F.expr(_SCORE)), "content_blocked": F.expr(f"{_MIX} % 97 = 1")}).withColumn("flagged", _F("score") > 0.9)


def _screened(spark, sf):
    part = F.when(_F("case_id") % 5 == 0, "agent").when(_F("case_id") % 5 == 1, "operator").when(_F("case_id") % 5 == 2, "external")
    return fx.cases(spark, sf).select("case_id", "text", part.alias("origin"), F.when(_F("case_id") % 3 == 0, "tool_output").alias("boundary"))


_JUDGED = f"""{fx.SEGMENTS}, jj AS (SELECT case_id, strategy, idx, nth, segment, {_MIX} AS mix FROM s, (VALUES (0), (1)) AS t(nth)),
j AS (SELECT *, CASE WHEN mix % 13 <> 0 THEN mix % 1001 / 1000.0::DOUBLE END AS score, mix % 97 = 1 AS other FROM jj)"""
_DECIDED = """SELECT c.case_id, coalesce(flagged, false) AS flagged, coalesce(open AND NOT flagged AND NOT blocked, false) AS inconclusive, round(score, 9) AS score, coalesce(chunks, 0)::BIGINT AS chunks,
 CASE WHEN flagged THEN first_flag END AS first_flag, decided_by, CASE WHEN flagged THEN 'MALICIOUS' WHEN blocked THEN 'CONTENT_BLOCKED' WHEN open THEN 'INCONCLUSIVE' WHEN flagged IS NOT NULL THEN 'BENIGN' END AS label,
 CASE WHEN flagged THEN CASE WHEN c.case_id % 5 IN (0, 1) THEN 'observe' WHEN c.case_id % 3 = 0 THEN 'quarantine' ELSE 'block' END WHEN blocked THEN 'block' WHEN open THEN 'quarantine' ELSE 'allow' END AS decision
 FROM c LEFT JOIN v ON v.case_id = c.case_id"""
_RESULT = ["case_id", "flagged", "inconclusive", "round(score, 9) AS score", "chunks", "first_flag", "decided_by", "label", "decision"]


@query(f"""WITH {_JUDGED}, g AS (SELECT case_id, strategy, bool_or(coalesce(score > 0.9, false)) AS flagged, bool_or(score IS NULL) AS hole, bool_or(other) AS blocked, max(score) AS score, count(DISTINCT idx) AS chunks,
 first(idx ORDER BY nth, idx) FILTER (score > 0.9) AS first_flag FROM j GROUP BY ALL),
a AS (SELECT * FROM g WHERE strategy = 'full'), b AS (SELECT g.* FROM g JOIN a USING (case_id) WHERE g.strategy = 'window' AND NOT a.flagged AND NOT a.blocked),
v AS (SELECT a.case_id, a.flagged OR coalesce(b.flagged, false) AS flagged, (a.hole AND NOT a.flagged) OR coalesce(b.hole AND NOT b.flagged, false) AS open, a.blocked OR coalesce(b.blocked, false) AS blocked,
 greatest(a.score, b.score) AS score, a.chunks + coalesce(b.chunks, 0) AS chunks, CASE WHEN b.case_id IS NULL THEN a.first_flag ELSE b.first_flag END AS first_flag, CASE WHEN b.case_id IS NULL THEN 'first' ELSE 'then' END AS decided_by
 FROM a LEFT JOIN b USING (case_id)) {_DECIDED}""")
def screened_cascade(spark, sf):
    """Every document through a cascade of whole text and windows, by two models, any flag counting."""
    technique = {"kind": "cascade", "first": {"kind": "full_text"}, "then": {"kind": "sliding_word_window", "window": fx.WINDOW, "stride": fx.STRIDE}}
    return screening.screen(_screened(spark, sf), technique, "any", [*_MODELS, "m1"], _assess, on_inconclusive="quarantine").selectExpr(*_RESULT)


_REDUCED = {"max": ("CASE WHEN hole THEN 1.0 ELSE hi END >= 0.95", "hi >= 0.95", "hi"), "mean": ("(total + holes) / n > 0.45", "total / n > 0.45", "CASE WHEN n > holes THEN total / (n - holes) END"), "min": ("lo > 0.02", "CASE WHEN hole THEN 0.0 ELSE lo END > 0.02", "CASE WHEN n > holes THEN lo END")}


@query(f"WITH {_JUDGED}, g AS (SELECT case_id, bool_or(coalesce(score > 0.9, false)) AS some, bool_or(score IS NULL) AS hole, count(*) FILTER (score IS NULL) AS holes, count(*) AS n, bool_or(other) AS blocked, coalesce(max(score), 0) AS hi, coalesce(min(score), 1) AS lo, coalesce(sum(score), 0) AS total, count(DISTINCT idx) AS chunks, first(idx ORDER BY nth, idx) FILTER (score > 0.9) AS first_flag FROM j WHERE strategy = 'window' GROUP BY ALL) "
       + " UNION ALL ".join(f"SELECT '{k}' AS reduce, x.* FROM (WITH v AS (SELECT case_id, ({w}) AND ({b}) AS flagged, ({w}) <> ({b}) AS open, blocked, CASE WHEN n > holes THEN {s} END AS score, chunks, first_flag, NULL::VARCHAR AS decided_by FROM g) {_DECIDED}) AS x" for k, (w, b, s) in _REDUCED.items()))
def screened_scores(spark, sf):
    """Every document in windows, decided by the highest, mean and lowest score, missing answers read both ways."""
    technique = {"kind": "sliding_word_window", "window": fx.WINDOW, "stride": fx.STRIDE}
    found = None
    for rule in ({"reduce": "max", "threshold": 0.95, "comparator": ">="}, {"reduce": "mean", "threshold": 0.45}, {"reduce": "min", "threshold": 0.02}):
        some = screening.screen(_screened(spark, sf), technique, rule, _MODELS, _assess, on_inconclusive="quarantine").selectExpr(f"'{rule['reduce']}' AS reduce", *_RESULT)
        found = some if found is None else found.unionByName(some)
    return found


# ---- Orders


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS nth FROM orders")
def numbered_orders(spark, sf):
    """All orders numbered by priority, which a fifth of them share, price and key."""
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ordering.numbered(rows, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "nth")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS nth FROM customer")
def ordered_lines(spark, sf):
    """Customers written as lines of JSON in order, read back by files and lines."""
    path = f"{shared_dir(spark, 'ordered')}/rows"
    ordering.write_ordered(fx.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), path, [F.desc("c_nationkey"), "c_custkey"])
    found = lines.read_lines(spark, path, 1 << 16).select("file", "line", F.get_json_object("text", "$.c_custkey").cast("long").alias("c_custkey"))
    return ordering.numbered(found, ["file", "line"]).select("c_custkey", "nth")


_TRANCHE = 300


@query(f"WITH {fx.SEGMENTS}, n AS (SELECT case_id, idx, (row_number() OVER (ORDER BY case_id % 7, case_id, idx) - 1) // {_TRANCHE} + 1 AS t FROM s WHERE strategy = 'window') SELECT case_id, idx, CASE WHEN t <= 3 THEN 't' || t END AS tranche FROM n")
def run_tranches(spark, sf):
    """A run that is dispatched in three tranches, each the next of what the checkpoint doesn't have yet."""
    plan, path = streams.stored(fx.segments(spark, sf).where("strategy = 'window'").select("case_id", "idx"), "plan"), shared_dir(spark, "tranches")
    planned = spark.read.schema("case_id long, idx long").parquet(plan)
    done = spark.createDataFrame([], "case_id long, idx long, run_id string")
    for t in range(1, 4):
        files.append_run(ordering.tranche(planned, done, ["case_id", "idx"], [_F("case_id") % 7, "case_id", "idx"], _TRANCHE), path, f"t{t}")
        done = spark.read.schema("case_id long, idx long, run_id string").parquet(path)
    return planned.join(done, ["case_id", "idx"], "left").withColumnRenamed("run_id", "tranche")


@query(f"""WITH {fx.OBSERVATIONS}, m AS (SELECT engine, count(*) AS expected, count(*) FILTER (outcome = 'scored') AS scored, count(*) FILTER (outcome = 'abstained') AS abstained FROM o WHERE strategy = 'window' AND (engine > 1 OR outcome <> 'error') AND (engine < 3 OR outcome = 'scored') GROUP BY engine)
SELECT *, CASE WHEN scored + abstained < expected THEN 'checkpointed_tranche' WHEN abstained > 0 THEN 'finished_with_abstentions' ELSE 'complete' END AS status FROM m""")
def run_standing(spark, sf):
    """How the three engines' runs stand, one of them without errors and one with nothing but scores."""
    obs = fx.observations(spark, sf).where("strategy = 'window'").select("engine", "case_id", "idx", "outcome").where("(engine > 1 OR outcome <> 'error') AND (engine < 3 OR outcome = 'scored')")
    found = None
    for e in fx.ENGINES:
        own = obs.where(_F("engine") == e)
        some = ordering.standing(own, own.where("outcome IN ('scored', 'abstained')"), ["case_id", "idx"]).withColumn("engine", F.lit(e).cast("long"))
        found = some if found is None else found.unionByName(some)
    return found


@query("""SELECT lang, source, count(*) AS cases, '| ' || coalesce(lang, '') || ' | ' || coalesce(replace(source, '|', '\\|'), '') || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang, source""")
def report_files(spark, sf):
    """A report written as JSON and Markdown, both read back."""
    path = f"{shared_dir(spark, 'report')}/report"
    files.write_report(fx.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("cases")), path, ["lang", "source"])
    rows = spark.read.schema("lang string, source string, cases long").json(f"{path}/json")
    line = F.concat_ws(" | ", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), "cases")
    text = spark.read.text(f"{path}/markdown").withColumnRenamed("value", "line")
    return rows.withColumn("key", F.concat(F.lit("| "), line, F.lit(" |"))).join(text, F.replace("line", F.lit("\\|"), F.lit("|")) == _F("key")).select("lang", "source", "cases", "line")


# ---- Ledgers

_TYPE = "CASE WHEN h = 0 THEN 'batch_start' WHEN h = 1 THEN 'batch_finish' WHEN h < 7 THEN 'condition_start' WHEN h < 11 THEN 'condition_finish' WHEN h = 11 THEN 'budget_stop' ELSE 'note' END"
_LEDGER_KEYS = {"ledger": "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'l' || user_id % 5 END", "line": "event_id", "h": "(event_id * 7 + user_id) % 13", "test": "event_type", "condition": "'c' || user_id % 4"}
_LEDGER = "e AS (SELECT " + ", ".join(f"{x} AS {k}" for k, x in _LEDGER_KEYS.items()) + f""" FROM events), t AS (SELECT *, {_TYPE} AS type FROM e),
p AS (SELECT *, max(CASE WHEN type = 'batch_start' THEN line END) OVER (PARTITION BY ledger ORDER BY line) AS start_line FROM t)"""


def _ledger(spark, sf):
    return fx.table(spark, sf, "events").select(*[F.expr(x).alias(k) for k, x in _LEDGER_KEYS.items()]).withColumn("type", F.expr(_TYPE))


@query(f"WITH {_LEDGER} SELECT ledger, start_line, max(CASE WHEN type = 'batch_finish' THEN line END) AS finish_line FROM p WHERE start_line IS NOT NULL GROUP BY ALL")
def ledger_batches(spark, sf):
    """The batches of ledgers, one of which has a third of all lines."""
    return ledgers.batches_and_cells(_ledger(spark, sf), block=1000)[0]


@query(f"""WITH {_LEDGER}, k AS (SELECT *, lead(type) OVER w AS following, lead(line) OVER w AS after FROM p WHERE type IN ('condition_start', 'condition_finish') AND start_line IS NOT NULL WINDOW w AS (PARTITION BY ledger, start_line, test, condition ORDER BY line))
SELECT ledger, start_line, line, CASE WHEN following = 'condition_finish' THEN after END AS finish_line, false AS budget_stopped, test, condition FROM k WHERE type = 'condition_start'
UNION ALL SELECT ledger, start_line, line, NULL, true, test, condition FROM p WHERE type = 'budget_stop' AND start_line IS NOT NULL""")
def ledger_cells(spark, sf):
    """What was worked on in each batch."""
    return ledgers.batches_and_cells(_ledger(spark, sf), block=1000)[1]


# ---- Late links, comparisons, seeds

_LATE = {
    "one": "(SELECT min(c_name) FROM customer WHERE c_custkey = o_custkey)",
    "least": "(SELECT min(l_suppkey)::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey)",
    "other": "(SELECT min(x.o_orderkey)::VARCHAR FROM orders x WHERE x.o_custkey = orders.o_custkey AND x.o_orderkey <> orders.o_orderkey)",
    "pair": "(SELECT min(l_partkey)::VARCHAR FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 10 + 1)",
    "composed": "(SELECT min(c_custkey)::VARCHAR FROM customer WHERE c_mktsegment || '/' || c_nationkey = o_orderstatus || 'UILDING/' || o_orderkey % 25)",
}


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'there' ELSE {x} END AS link FROM orders" for k, x in _LATE.items()) + ") SELECT * FROM r")
def late_links(spark, sf):
    """Links of orders that are filled from what came later: one row, the least of several, another than itself, by two columns, and by a composed name."""
    t = lambda n: fx.table(spark, sf, n)
    rows = t("orders").withColumns({"link": F.when(_F("o_orderkey") % 4 == 0, "there"), "s": _F("o_custkey") % 10 + 1, "name": F.concat("o_orderstatus", F.lit("UILDING/"), _F("o_orderkey") % 25)})
    item, customer = t("lineitem"), t("customer").withColumn("name", F.concat("c_mktsegment", F.lit("/"), "c_nationkey"))
    done = {
        "one": ledgers.resolve(rows, "link", customer, {"o_custkey": "c_custkey"}, "c_name"), "least": ledgers.resolve(rows, "link", item, {"o_orderkey": "l_orderkey"}, "l_suppkey"),
        "other": ledgers.resolve(rows, "link", t("orders"), {"o_custkey": "o_custkey"}, "o_orderkey", other_than="o_orderkey"),
        "pair": ledgers.resolve(rows, "link", item, {"o_orderkey": "l_orderkey", "s": "l_suppkey"}, "l_partkey"), "composed": ledgers.resolve(rows, "link", customer, {"name": "name"}, "c_custkey"),
    }
    found = None
    for kind, some in done.items():
        some = some.select("o_orderkey", F.lit(kind).alias("kind"), F.col("link").cast("string").alias("link"))
        found = some if found is None else found.unionByName(some)
    return found


@query(f"""WITH {fx.STRICT}, f AS (SELECT engine, lang, source, case_id, positive, coalesce(flagged, false) AS flagged FROM v WHERE strategy = 'full' AND lang IS NOT NULL AND source IS NOT NULL AND NOT (engine = 2 AND lang = 'de'))
SELECT a.lang, a.source, a.positive, count(*) FILTER (a.flagged AND b.flagged) AS "both", count(*) FILTER (a.flagged AND NOT b.flagged) AS a_only, count(*) FILTER (NOT a.flagged AND b.flagged) AS b_only,
 count(*) FILTER (NOT a.flagged AND NOT b.flagged) AS neither FROM f a JOIN f b USING (case_id) WHERE a.engine = 1 AND b.engine = 2 GROUP BY ALL""")
def compared_runs(spark, sf):
    """Two engines over the cohorts that both have."""
    rows = strict(spark, sf).where("strategy = 'full' AND lang IS NOT NULL AND source IS NOT NULL").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    cols = ["lang", "source", "case_id", "positive", "flagged"]
    return ledgers.compare_runs(rows.where("engine = 1").select(*cols), rows.where("engine = 2 AND lang <> 'de'").select(*cols), ["lang", "source"])


@query(f"""WITH {fx.SEGMENTS}, t AS (SELECT case_id, sha256(segment) AS h, CASE WHEN case_id % 3 > 0 THEN 'c' || case_id % 3 END AS context, case_id % 4 AS config FROM s WHERE strategy = 'full')
SELECT case_id, 'new' AS run_id, 'old' AS source_run_id, 'q' || case_id || '/2' AS source_request_id, case_id % 100 / 100.0::DOUBLE AS score FROM t WHERE case_id % 5 <> 2 AND case_id % 7 <> 3 AND case_id % 4 <> 1""")
def seeded_segments(spark, sf):
    """A run seeded from whole-text answers: the last of two for each case, some of another input, context or configuration."""
    rows = fx.segments(spark, sf).where("strategy = 'full'").select("case_id", F.concat("case_id", F.lit("/0")).alias("segment_id"), sha("segment").alias("text_sha256"))
    k = _F("case_id")
    rows = rows.withColumns({"context_sha256": F.when(k % 3 > 0, F.concat(F.lit("c"), k % 3)), "turn_ids": F.when(k % 2 == 0, F.array(k.cast("string"))), "model": k % 4})
    old = rows.withColumn("line", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({
        "run_id": F.lit("old"), "request_id": F.concat(F.lit("q"), k, F.lit("/"), "line"), "score": k % 100 / 100.0 + F.when(_F("line") == 1, 1.0).otherwise(0.0),
        "text_sha256": F.when((k % 5 == 2) & (_F("line") == 2), "another").otherwise(_F("text_sha256")), "context_sha256": F.when(k % 7 == 3, "another").otherwise(_F("context_sha256")), "model": F.when(k % 4 == 1, None).otherwise(_F("model")),
    })
    found = ledgers.seeded(rows.withColumn("run_id", F.lit("new")), old, ["model"])
    return found.select("case_id", "run_id", "source_run_id", "source_request_id", "score")
