"""Queries over verdicts: outcomes, the four policies, cascades and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.operators import metrics, verdict
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query


def summary(spark, sf):
    return verdict.summarise(fx.observations(spark, sf), fx.KEYS)


def strict(spark, sf):
    """Strict verdicts under max > 0.5, of all engines and strategies."""
    return verdict.strict(verdict.with_rules(summary(spark, sf), fx.rules(spark).where("rule_id = 'max_5'")))


def _flag(alias="m"):
    return f"(CASE r.aggregation WHEN 'max' THEN {alias}.max_score WHEN 'mean' THEN {alias}.mean_score ELSE {alias}.min_score END)"


@query(f"WITH {fx.OBSERVATIONS} SELECT engine, strategy, outcome, count(*) AS segments, round(avg(score), 6) AS mean_score FROM o GROUP BY ALL")
def segment_outcomes(spark, sf):
    return fx.observations(spark, sf).groupBy("engine", "strategy", "outcome").agg(F.count("*").alias("segments"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""WITH {fx.SUMMARY}, {fx.RULES_SQL} SELECT engine, strategy, case_id, rule_id, expected, scored,
CASE WHEN scored = expected THEN CASE comparator WHEN '>' THEN {_flag()} > threshold ELSE {_flag()} >= threshold END END AS flagged FROM m, r""")
def verdict_strict(spark, sf):
    rows = verdict.strict(verdict.with_rules(summary(spark, sf), fx.rules(spark)))
    return rows.select("engine", "strategy", "case_id", "rule_id", "expected", "scored", "flagged")


SHORT_SQL = f"""WITH {fx.SUMMARY}, {fx.RULES_SQL}, f AS (SELECT m.*, r.*, CASE comparator WHEN '>' THEN max_score > threshold ELSE max_score >= threshold END AS any_flag,
 NOT CASE comparator WHEN '>' THEN min_score > threshold ELSE min_score >= threshold END AS any_pass, CASE comparator WHEN '>' THEN mean_score > threshold ELSE mean_score >= threshold END AS mean_flag FROM m, r),
d AS (SELECT *, CASE aggregation WHEN 'max' THEN CASE WHEN any_flag THEN true WHEN scored < expected THEN NULL ELSE false END
  WHEN 'min' THEN CASE WHEN any_pass THEN false WHEN scored < expected THEN NULL ELSE true END ELSE CASE WHEN scored = expected THEN mean_flag END END AS flagged FROM f),
e AS (SELECT *, CASE WHEN flagged THEN 'flagged' WHEN NOT flagged THEN 'passed' WHEN unresolved = 0 THEN 'abstained' ELSE 'incomplete' END AS verdict FROM d)"""


@query(SHORT_SQL + " SELECT engine, strategy, case_id, rule_id, flagged, verdict FROM e")
def verdict_short_circuit(spark, sf):
    rows = verdict.short_circuit(verdict.with_rules(summary(spark, sf), fx.rules(spark)))
    return rows.select("engine", "strategy", "case_id", "rule_id", "flagged", "verdict")


@query(f"""WITH {fx.OBSERVATIONS}, g AS (SELECT engine, strategy, case_id, count(*) AS n, count(score) AS known, count(*) FILTER (score > 0.5) AS flags, coalesce(max(score), 0) AS mx, coalesce(sum(score), 0) AS sm,
 coalesce(min(score), 1) AS mn FROM o GROUP BY ALL),
x AS (SELECT engine, strategy, case_id, unnest([
 {{'a': 'any', 'w': flags + n - known > 0, 'b': flags > 0}}, {{'a': 'all', 'w': flags + n - known = n, 'b': flags = n}},
 {{'a': 'max', 'w': CASE WHEN known < n THEN greatest(mx, 1.0) ELSE mx END > 0.5, 'b': mx > 0.5}},
 {{'a': 'mean', 'w': (sm + n - known) / n > 0.5, 'b': sm / n > 0.5}}, {{'a': 'min', 'w': mn > 0.5, 'b': CASE WHEN known < n THEN 0.0 ELSE mn END > 0.5}}]) AS r FROM g)
SELECT engine, strategy, case_id, r.a AS aggregator, r.w AND r.b AS flagged, r.w <> r.b AS inconclusive FROM x""")
def verdict_two_reading(spark, sf):
    return verdict.two_reading(fx.observations(spark, sf), ["engine", "strategy", "case_id"], 0.5)


@query(f"WITH {fx.OBSERVATIONS} SELECT engine, strategy, case_id, max(score) AS max_score, max(score) > 0.5 AS flagged FROM o GROUP BY ALL")
def verdict_ignore_invalid(spark, sf):
    return verdict.ignore_invalid(fx.observations(spark, sf), ["engine", "strategy", "case_id"])


@query(f"""WITH {fx.OBSERVATIONS}, g AS (SELECT engine, case_id, list(score ORDER BY score DESC) AS s, count(*) AS n, count(*) FILTER (score > 0.5) AS votes FROM o WHERE strategy = 'window' AND score IS NOT NULL GROUP BY ALL)
SELECT engine, case_id, n::INTEGER AS n_scored, s[1] > 0.5 AS max_5, s[1] > 0.7 AS max_7, s[1] > 0.9 AS max_9, CASE WHEN n > 1 THEN (s[1] + s[2]) / 2 ELSE s[1] END > 0.5 AS top2,
votes >= least(2, n) AS two_votes, votes >= 0.25 * n AS quarter, votes >= 0.5 * n AS half FROM g""")
def window_vote_rules(spark, sf):
    return verdict.vote_rules(fx.observations(spark, sf).where("strategy = 'window'"), ["engine", "case_id"])


STAGES_SQL = f"""WITH {fx.STRICT}, p AS (SELECT f.engine, f.case_id, f.positive, f.lang, f.flagged AS full_flag, w.flagged AS window_flag, f.max_score AS full_score, w.max_score AS window_score
 FROM v f JOIN v w USING (engine, case_id) WHERE f.strategy = 'full' AND w.strategy = 'window')"""


def stages(spark, sf):
    pairs = metrics.pair(strict(spark, sf), "strategy", "full", "window", ["engine", "case_id", "positive", "lang"], ["flagged", "max_score"])
    return pairs.withColumnsRenamed({"a_flagged": "full_flag", "b_flagged": "window_flag", "a_max_score": "full_score", "b_max_score": "window_score"})


@query(STAGES_SQL + """ SELECT engine, case_id, coalesce(full_flag, false) OR coalesce(window_flag, false) AS screen, full_flag OR window_flag AS kleene,
CASE WHEN full_flag THEN full_score ELSE greatest(full_score, window_score) END AS score FROM p""")
def cascade(spark, sf):
    f, w = F.col("full_flag"), F.col("window_flag")
    score = F.when(f, F.col("full_score")).otherwise(F.greatest("full_score", "window_score"))
    return stages(spark, sf).select("engine", "case_id", verdict.cascade(f, w, "screen").alias("screen"), verdict.cascade(f, w, "kleene").alias("kleene"), score.alias("score"))


@query(STAGES_SQL + " SELECT engine, case_id, CASE WHEN full_flag IS NULL THEN NULL WHEN full_flag THEN true ELSE window_flag END AS flagged FROM p")
def cascade_strict(spark, sf):
    return stages(spark, sf).select("engine", "case_id", verdict.cascade(F.col("full_flag"), F.col("window_flag"), "strict").alias("flagged"))


@query(f"""WITH {fx.OBSERVATIONS}, f AS (SELECT engine, case_id, score > 0.5 AS full_flag FROM o WHERE strategy = 'full'),
w AS (SELECT engine, case_id, idx, full_flag, coalesce(score > 0.5, false) AS fl FROM o JOIN f USING (engine, case_id) WHERE strategy = 'window'),
x AS (SELECT *, NOT coalesce(full_flag, false) AND NOT coalesce(bool_or(fl) OVER (PARTITION BY engine, case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS runs FROM w)
SELECT engine, count(*) AS windows, count(*) FILTER (runs) AS run_windows, count(DISTINCT case_id) FILTER (runs) AS run_cases FROM x GROUP BY engine""")
def cascade_work_replay(spark, sf):
    obs = fx.observations(spark, sf)
    full = obs.where("strategy = 'full'").select("engine", "case_id", (F.col("score") > 0.5).alias("full_flag"))
    windows = obs.where("strategy = 'window'").join(full, ["engine", "case_id"]).withColumn("window_flag", F.col("score") > 0.5)
    rows = verdict.cascade_work(windows, ["engine", "case_id"])
    return rows.groupBy("engine").agg(F.count("*").alias("windows"), F.count_if("runs").alias("run_windows"), F.count_distinct(F.when(F.col("runs"), F.col("case_id"))).alias("run_cases"))


@query(f"""WITH {fx.STRICT}, a AS (SELECT case_id, positive, max_score AS s1 FROM v WHERE engine = 1 AND strategy = 'full'), b AS (SELECT case_id, flagged AS f2 FROM v WHERE engine = 2 AND strategy = 'full'),
t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), x AS (SELECT threshold, positive, f2, coalesce(s1 > threshold, true) AS escalated FROM a JOIN b USING (case_id), t)
SELECT threshold, count(*) AS cases, count(*) FILTER (escalated) AS escalated, count(*) FILTER (positive AND escalated AND f2) AS caught, count(*) FILTER (positive) AS positives,
round(count(*) FILTER (escalated) / count(*)::DOUBLE, 6) AS escalation_share, round(count(*) FILTER (positive AND escalated AND f2) / nullif(count(*) FILTER (positive), 0)::DOUBLE, 6) AS recall FROM x GROUP BY threshold""")
def prescreen_grid(spark, sf):
    v = strict(spark, sf).where("strategy = 'full'")
    pairs = metrics.pair(v, "engine", 1, 2, ["case_id", "positive"], ["max_score", "flagged"])
    grid = pairs.select("*", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])).alias("threshold"))
    grid = grid.withColumn("up", F.coalesce(F.col("a_max_score") > F.col("threshold"), F.lit(True)))
    hit = F.col("positive") & F.col("up") & F.col("b_flagged")
    rows = grid.groupBy("threshold").agg(F.count("*").alias("cases"), F.count_if("up").alias("escalated"), F.count_if(hit).alias("caught"), F.count_if("positive").alias("positives"))
    return rows.withColumn("escalation_share", metrics.ratio(F.col("escalated"), F.col("cases"), 6)).withColumn("recall", metrics.ratio(F.col("caught"), F.col("positives"), 6))


@query(f"""WITH {fx.STRICT} SELECT strategy, case_id, count(*) AS members, count(*) FILTER (flagged) AS votes, count(*) FILTER (flagged IS NULL) AS undecided,
CASE WHEN count(*) FILTER (flagged IS NULL) = 0 THEN count(*) FILTER (flagged) >= 2 END AS flagged FROM v GROUP BY ALL""")
def ensemble_votes(spark, sf):
    return verdict.votes(strict(spark, sf), ["strategy", "case_id"], 2)


@query(f"""WITH {fx.STRICT}, e AS (SELECT strategy, case_id, positive, count(*) FILTER (flagged) AS votes FROM v GROUP BY ALL) SELECT strategy, positive, votes, count(*) AS cases FROM e GROUP BY ALL""")
def vote_histogram(spark, sf):
    rows = verdict.votes(strict(spark, sf), ["strategy", "case_id", "positive"], 1)
    return rows.groupBy("strategy", "positive", "votes").agg(F.count("*").alias("cases"))


_B = "coalesce(b{0}, false)"


@query(f"""WITH {fx.STRICT}, e AS (SELECT case_id, positive, bool_or(flagged) FILTER (engine = 1) AS b1, bool_or(flagged) FILTER (engine = 2) AS b2, bool_or(flagged) FILTER (engine = 3) AS b3 FROM v WHERE strategy = 'window' GROUP BY ALL)
SELECT coalesce(b1, false)::INT || '' || coalesce(b2, false)::INT || coalesce(b3, false)::INT AS pattern, count(*) AS cases, count(*) FILTER (positive) AS positives,
count(*) FILTER (b1 OR b2 OR b3) AS any_of, count(*) FILTER (coalesce(b1, false)::INT + coalesce(b2, false)::INT + coalesce(b3, false)::INT >= 2) AS two_of, count(*) FILTER (b1 AND b2 AND b3) AS all_of FROM e GROUP BY pattern""")
def flag_patterns(spark, sf):
    by = strict(spark, sf).where("strategy = 'window'").groupBy("case_id", "positive").agg(*[F.bool_or(F.when(F.col("engine") == e, F.col("flagged"))).alias(f"b{e}") for e in fx.ENGINES])
    bits = [F.coalesce(F.col(f"b{e}"), F.lit(False)).cast("int") for e in fx.ENGINES]
    total = bits[0] + bits[1] + bits[2]
    rows = by.groupBy(F.concat(*[b.cast("string") for b in bits]).alias("pattern"))
    return rows.agg(F.count("*").alias("cases"), F.count_if("positive").alias("positives"), F.count_if(total >= 1).alias("any_of"), F.count_if(total >= 2).alias("two_of"), F.count_if(total == 3).alias("all_of"))


@query(f"""WITH {fx.OBSERVATIONS}, g AS (SELECT case_id, engine, count(*) AS n, count(score) AS known, bool_or(score > 0.5) AS any_flag, bool_or(case_id % 19 = 3 AND idx = 0) AS content, max(score) AS mx,
 min(CASE WHEN score > 0.5 THEN idx END) AS first_flag FROM o WHERE strategy = 'window' GROUP BY ALL),
d AS (SELECT *, coalesce(any_flag, false) AS flagged, NOT coalesce(any_flag, false) AND known < n AS inconclusive, CASE case_id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'agent' ELSE 'operator' END AS origin,
 CASE case_id % 2 WHEN 0 THEN 'tool_output' ELSE 'input' END AS boundary FROM g)
SELECT case_id, engine, CASE WHEN flagged THEN 'MALICIOUS' WHEN content THEN 'CONTENT_BLOCKED' WHEN inconclusive THEN 'INCONCLUSIVE' ELSE 'BENIGN' END AS label, mx AS score, CASE WHEN flagged THEN first_flag END AS first_flag,
CASE WHEN NOT flagged AND NOT content AND NOT inconclusive THEN 'allow' WHEN NOT flagged THEN 'block' WHEN origin IN ('operator', 'agent') THEN 'observe' WHEN boundary = 'tool_output' THEN 'quarantine' ELSE 'block' END AS decision FROM d""")
def screen_decisions(spark, sf):
    obs = fx.observations(spark, sf).where("strategy = 'window'")
    hit = F.col("score") > 0.5
    rows = obs.groupBy("case_id", "engine").agg(
        F.count("*").alias("n"), F.count("score").alias("known"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("flagged"), F.bool_or((F.col("case_id") % 19 == 3) & (F.col("idx") == 0)).alias("content"),
        F.max("score").alias("score"), F.min(F.when(hit, F.col("idx"))).alias("at"),
    )
    origin = F.element_at(F.array(F.lit("external"), F.lit("agent"), F.lit("operator")), (F.col("case_id") % 3 + 1).cast("int"))
    boundary = F.when(F.col("case_id") % 2 == 0, "tool_output").otherwise("input")
    flagged, content, unsure = F.col("flagged"), F.col("content"), ~F.col("flagged") & (F.col("known") < F.col("n"))
    return rows.select(
        "case_id", "engine", verdict.screen_label(flagged, content, unsure).alias("label"), "score", F.when(flagged, F.col("at")).alias("first_flag"),
        verdict.screen_decision(flagged, unsure, content, origin, boundary).alias("decision"),
    )
