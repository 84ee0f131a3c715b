"""Queries over metrics: rates, replays, pairings, cells, spreads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trivalent.functions.stats import ratio
from trivalent.operators import metrics, verdict
from trivalent.plans import fixtures as fx
from trivalent.plans.decisions import SHORT_SQL, strict, summary
from trivalent.plans.registry import query


def _r(n, d, digits=6):
    return f"round(({n}) / nullif({d}, 0)::DOUBLE, {digits})"


_P, _N = "positive AND verdict", "NOT positive AND verdict"


@query(SHORT_SQL + f""" SELECT engine, strategy, rule_id, count(*) AS cases, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives, count(*) FILTER ({_P} = 'flagged') AS detected,
count(*) FILTER ({_P} = 'passed') AS missed, count(*) FILTER ({_N} = 'flagged') AS clean_flags, count(*) FILTER ({_N} = 'passed') AS clean_passes, count(*) FILTER (verdict = 'abstained') AS abstained,
count(*) FILTER (verdict = 'incomplete') AS incomplete, {_r(f"count(*) FILTER ({_P} = 'flagged')", f"count(*) FILTER ({_P} IN ('flagged', 'passed'))", 4)} AS detection_rate,
{_r(f"count(*) FILTER ({_P} = 'flagged')", "count(*) FILTER (positive)", 4)} AS detection_rate_floor, {_r(f"count(*) FILTER ({_N} = 'flagged')", f"count(*) FILTER ({_N} IN ('flagged', 'passed'))", 4)} AS clean_flag_rate,
{_r("count(*) FILTER (verdict = 'abstained')", "count(*)", 4)} AS abstention_rate FROM e GROUP BY engine, strategy, rule_id""")
def condition_rates_by_rule(spark, sf):
    rows = verdict.short_circuit(verdict.with_rules(summary(spark, sf), fx.rules(spark)))
    return metrics.condition_rates(rows, ["engine", "strategy", "rule_id"])


@query(f"""WITH {fx.SUMMARY}, r AS (SELECT a AS aggregation, t AS threshold FROM (SELECT unnest(['max', 'mean', 'min']) AS a), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.9])::DOUBLE AS t)),
d AS (SELECT engine, strategy, aggregation, threshold, positive, CASE WHEN scored = expected THEN CASE aggregation WHEN 'max' THEN max_score WHEN 'mean' THEN mean_score ELSE min_score END > threshold END AS flagged FROM m, r)
SELECT engine, strategy, aggregation, threshold, count(*) AS cases, count(*) FILTER (positive AND flagged) AS tp, count(*) FILTER (positive AND NOT flagged) AS fn, count(*) FILTER (NOT positive AND flagged) AS fp,
count(*) FILTER (NOT positive AND NOT flagged) AS tn, count(*) FILTER (flagged IS NULL) AS incomplete, {_r("count(*) FILTER (positive AND flagged)", "count(*) FILTER (positive AND flagged IS NOT NULL)")} AS detection_rate,
{_r("count(*) FILTER (NOT positive AND flagged)", "count(*) FILTER (NOT positive AND flagged IS NOT NULL)")} AS false_positive_rate FROM d GROUP BY ALL""")
def threshold_replay_grid(spark, sf):
    grid = spark.createDataFrame([(f"{a}{t}", a, ">", t) for a in ("max", "mean", "min") for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.9)], "rule_id string, aggregation string, comparator string, threshold double")
    return metrics.confusion(verdict.strict(verdict.with_rules(summary(spark, sf), grid)), ["engine", "strategy", "aggregation", "threshold"])


PAIRS_SQL = f"""WITH {fx.STRICT}, p AS (SELECT f.engine, f.case_id, f.positive, f.lang, f.source, f.flagged AS a, w.flagged AS b, f.max_score AS a_score, w.max_score AS b_score FROM v f JOIN v w USING (engine, case_id)
 WHERE f.strategy = 'full' AND w.strategy = 'window')"""


def _pairs(spark, sf):
    return metrics.pair(strict(spark, sf), "strategy", "full", "window", ["engine", "case_id", "positive", "lang", "source"], ["flagged", "max_score"])


@query(PAIRS_SQL + " SELECT engine, case_id, positive, a AS full_flagged, b AS window_flagged, a_score AS full_score, b_score AS window_score FROM p")
def full_vs_window_pairs(spark, sf):
    return _pairs(spark, sf).select(
        "engine", "case_id", "positive", F.col("a_flagged").alias("full_flagged"), F.col("b_flagged").alias("window_flagged"), F.col("a_max_score").alias("full_score"), F.col("b_max_score").alias("window_score")
    )


_c = lambda x: f"count(*) FILTER ({x})"
_D = "a IS NOT NULL AND b IS NOT NULL"


@query(PAIRS_SQL + f""" SELECT engine, lang, count(*) AS cases, {_c('a IS NULL OR b IS NULL')} AS undecided_either, {_c(f'positive AND {_D}')} AS paired_positives, {_c('positive AND a AND b')} AS pos_both,
{_c('positive AND a AND NOT b')} AS pos_full_only, {_c('positive AND NOT a AND b')} AS pos_window_only, {_c('positive AND NOT a AND NOT b')} AS pos_neither, {_c(f'NOT positive AND {_D}')} AS paired_negatives,
{_c('NOT positive AND a AND b')} AS neg_both, {_c('NOT positive AND a AND NOT b')} AS neg_full_only, {_c('NOT positive AND NOT a AND b')} AS neg_window_only,
{_r(f"{_c('positive AND NOT a AND b')} - {_c('positive AND a AND NOT b')}", _c(f'positive AND {_D}'), 4)} AS detection_delta,
{_r(f"{_c('NOT positive AND NOT a AND b')} - {_c('NOT positive AND a AND NOT b')}", _c(f'NOT positive AND {_D}'), 4)} AS clean_flag_delta FROM p GROUP BY engine, lang""")
def full_vs_window_deltas(spark, sf):
    return metrics.paired_deltas(_pairs(spark, sf), ["engine", "lang"])


@query(f"""WITH {fx.STRICT}, e AS (SELECT engine, case_id, positive, flagged, 'lang' AS facet, lang AS value FROM v WHERE strategy = 'window' UNION ALL SELECT engine, case_id, positive, flagged, 'source', source FROM v WHERE strategy = 'window')
SELECT engine, facet, value, count(*) AS total, {_c('flagged')} AS flagged, {_c('positive')} AS positives, count(DISTINCT case_id) AS seeds FROM e GROUP BY engine, facet, value""")
def facet_breakdown(spark, sf):
    rows = strict(spark, sf).where("strategy = 'window'")
    each = rows.select("engine", "case_id", "positive", "flagged", F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("facet", "value"))
    return each.groupBy("engine", "facet", "value").agg(F.count("*").alias("total"), F.count_if("flagged").alias("flagged"), F.count_if("positive").alias("positives"), F.count_distinct("case_id").alias("seeds"))


ROWS_SQL = f"""{fx.SUMMARY}, w AS (SELECT engine, case_id, positive, lang AS test, CASE WHEN scored = expected THEN 'scored' WHEN unresolved > 0 THEN 'other' WHEN case_id % 2 = 0 THEN 'length_abstention' ELSE 'output_abstention' END AS status,
 CASE WHEN scored = expected THEN max_score > 0.5 END AS flagged, max_score AS score, (expected * 100 + case_id % 50)::DOUBLE AS tokens FROM m WHERE strategy = 'full')"""


def case_rows(spark, sf):
    """Full-text cases as rows of a paired analysis: test, model, status, flagged, tokens."""
    rows = summary(spark, sf).where("strategy = 'full'")
    whole = F.col("scored") == F.col("expected")
    status = F.when(whole, "scored").when(F.col("unresolved") > 0, "other").when(F.col("case_id") % 2 == 0, "length_abstention").otherwise("output_abstention")
    return rows.select(
        "engine", "case_id", "positive", F.col("lang").alias("test"), status.alias("status"), F.when(whole, F.col("max_score") > 0.5).alias("flagged"), F.col("max_score").alias("score"),
        (F.col("expected") * 100 + F.col("case_id") % 50).cast("double").alias("tokens"),
    )


CELLS_SQL = f"""WITH {ROWS_SQL}, c0 AS (SELECT test, engine, count(*) AS cases, {_c("status = 'scored'")} AS scored, {_c("status = 'scored' AND positive")} AS positives_scored, {_c("status = 'scored' AND positive AND flagged")} AS true_positives,
 {_c("status = 'scored' AND NOT positive")} AS negatives_scored, {_c("status = 'scored' AND NOT positive AND flagged")} AS false_positives, {_c("status LIKE '%abstention'")} AS abstentions, {_c("status = 'other'")} AS other,
 round(avg(tokens), 6) AS mean_tokens, round(median(tokens), 6) AS median_tokens FROM w GROUP BY test, engine),
c1 AS (SELECT *, true_positives / nullif(positives_scored, 0)::DOUBLE AS t, false_positives / nullif(negatives_scored, 0)::DOUBLE AS f FROM c0),
cell AS (SELECT * EXCLUDE (t, f), round(t, 6) AS tpr, round(f, 6) AS fpr, round(coalesce((t + (1 - f)) / 2, t, 1 - f), 6) AS balanced_accuracy FROM c1)"""


@query(CELLS_SQL + " SELECT * FROM cell")
def cell_summary(spark, sf):
    return metrics.cell_summary(case_rows(spark, sf), ["test", "engine"])


_S = "x.status = 'scored' AND y.status = 'scored'"
_A, _B = "x.status LIKE '%abstention'", "y.status LIKE '%abstention'"


@query(f"""WITH {ROWS_SQL} SELECT coalesce(x.test, 'ALL') AS test, count(*) AS cases, {_c(_S)} AS both_scored, {_c(f"{_S} AND x.flagged = x.positive AND y.flagged = y.positive")} AS both_correct,
{_c(f"{_S} AND x.flagged <> x.positive AND y.flagged <> y.positive")} AS both_wrong, {_c(f"{_S} AND x.flagged = x.positive AND y.flagged <> y.positive")} AS only_a_correct,
{_c(f"{_S} AND x.flagged <> x.positive AND y.flagged = y.positive")} AS only_b_correct, {_c(f"{_S} AND x.positive AND x.flagged AND NOT y.flagged")} AS positives_lost,
{_c(f"{_S} AND x.positive AND NOT x.flagged AND y.flagged")} AS positives_gained, {_c(f"{_S} AND NOT x.positive AND NOT x.flagged AND y.flagged")} AS false_alarms_added,
{_c(f"{_S} AND NOT x.positive AND x.flagged AND NOT y.flagged")} AS false_alarms_removed, {_c(f"x.status = 'scored' AND {_B}")} AS scored_to_abstained,
{_c(f"{_A} AND y.status = 'scored'")} AS abstained_to_scored, {_c(f"{_A} AND {_B}")} AS both_abstained
FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 2 GROUP BY ROLLUP (x.test)""")
def paired_flips(spark, sf):
    return metrics.paired_flips(metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test", "positive"], ["status", "flagged"]), "test")


@query(CELLS_SQL + " SELECT engine, round(avg(balanced_accuracy), 4) AS macro_balanced_accuracy, count(*) AS groups FROM cell GROUP BY engine")
def macro_average(spark, sf):
    return metrics.macro_average(metrics.cell_summary(case_rows(spark, sf), ["test", "engine"]), "balanced_accuracy", ["test"], ["engine"])


@query(CELLS_SQL + """ SELECT test, engine, balanced_accuracy, rank() OVER (PARTITION BY test ORDER BY balanced_accuracy DESC NULLS LAST)::INTEGER AS rank,
row_number() OVER w::INTEGER AS place, round(balanced_accuracy - lead(balanced_accuracy) OVER w, 6) AS margin FROM cell WINDOW w AS (PARTITION BY test ORDER BY balanced_accuracy DESC NULLS LAST, engine)""")
def model_rank(spark, sf):
    cells = metrics.cell_summary(case_rows(spark, sf), ["test", "engine"])
    return metrics.ranked(cells.select("test", "engine", "balanced_accuracy"), "balanced_accuracy", ["test"], "engine")


@query(CELLS_SQL + """, k AS (SELECT *, row_number() OVER w AS place, balanced_accuracy - lead(balanced_accuracy) OVER w AS margin FROM cell WINDOW w AS (PARTITION BY test ORDER BY balanced_accuracy DESC NULLS LAST, engine))
SELECT test, engine AS leader, balanced_accuracy, round(margin, 6) AS margin FROM k WHERE place = 1""")
def group_leader(spark, sf):
    cells = metrics.cell_summary(case_rows(spark, sf), ["test", "engine"]).select("test", "engine", "balanced_accuracy")
    return metrics.ranked(cells, "balanced_accuracy", ["test"], "engine").where("place = 1").select("test", F.col("engine").alias("leader"), "balanced_accuracy", "margin")


@query(CELLS_SQL + """, g AS (SELECT x.test, avg((abs(x.balanced_accuracy - y.balanced_accuracy) > 0.02)::INT) AS s FROM cell x JOIN cell y ON x.test = y.test AND x.engine < y.engine GROUP BY 1)
SELECT test, round(max(balanced_accuracy) - min(balanced_accuracy), 6) AS spread, round(stddev_samp(balanced_accuracy), 6) AS sd, round(any_value(s), 6) AS share_apart FROM cell JOIN g USING (test) GROUP BY test""")
def model_spread(spark, sf):
    cells = metrics.cell_summary(case_rows(spark, sf), ["test", "engine"]).select("test", "engine", "balanced_accuracy")
    other = cells.select("test", F.col("engine").alias("e2"), F.col("balanced_accuracy").alias("b2"))
    apart = cells.join(other, "test").where("engine < e2").groupBy("test").agg(F.round(F.avg(F.when(F.abs(F.col("balanced_accuracy") - F.col("b2")) > 0.02, 1.0).otherwise(0.0)), 6).alias("share_apart"))
    spread = cells.groupBy("test").agg(F.round(F.max("balanced_accuracy") - F.min("balanced_accuracy"), 6).alias("spread"), F.round(F.stddev_samp("balanced_accuracy"), 6).alias("sd"))
    return spread.join(apart, "test")


@query(f"""WITH {fx.OBSERVATIONS} SELECT engine, positive, count(score) AS scored, {_c('score >= 0 AND score < 0.2')} AS bin_0, {_c('score >= 0.2 AND score < 0.4')} AS bin_1, {_c('score >= 0.4 AND score < 0.6')} AS bin_2,
{_c('score >= 0.6 AND score < 0.8')} AS bin_3, {_c('score >= 0.8 AND score <= 1')} AS bin_4, {_r(_c('score = 0.5'), 'count(score)')} AS share_half, {_c('score = 0')} AS at_zero FROM o GROUP BY engine, positive""")
def score_histogram(spark, sf):
    rows = fx.observations(spark, sf).groupBy("engine", "positive").agg(F.count("score").alias("scored"), *metrics.bands("score", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), F.count_if(F.col("score") == 0.5).alias("h"), F.count_if(F.col("score") == 0).alias("at_zero"))
    return rows.withColumn("share_half", ratio(F.col("h"), F.col("scored"), 6)).drop("h")


@query(f"""WITH {ROWS_SQL} SELECT x.test, count(*) AS near_misses, {_c('y.score < 0.25')} AS low, {_c('y.score >= 0.25')} AS close FROM w x JOIN w y USING (case_id)
WHERE x.engine = 1 AND y.engine = 2 AND x.flagged AND NOT y.flagged GROUP BY x.test""")
def near_miss_pairs(spark, sf):
    pairs = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test"], ["flagged", "score"]).where("a_flagged AND NOT b_flagged")
    return pairs.groupBy("test").agg(F.count("*").alias("near_misses"), F.count_if(F.col("b_score") < 0.25).alias("low"), F.count_if(F.col("b_score") >= 0.25).alias("close"))


@query(f"""WITH {ROWS_SQL}, n AS (SELECT x.test, y.score AS s FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 2 AND x.flagged AND NOT y.flagged)
SELECT test, count(*) AS near_misses, {_c('s >= 0 AND s < 0.1')} AS bin_0, {_c('s >= 0.1 AND s < 0.2')} AS bin_1, {_c('s >= 0.2 AND s < 0.3')} AS bin_2, {_c('s >= 0.3 AND s < 0.4')} AS bin_3, {_c('s >= 0.4 AND s <= 0.5')} AS bin_4 FROM n GROUP BY test""")
def near_miss_histogram(spark, sf):
    pairs = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test"], ["flagged", "score"]).where("a_flagged AND NOT b_flagged")
    return pairs.groupBy("test").agg(F.count("*").alias("near_misses"), *metrics.bands("b_score", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]))


@query(PAIRS_SQL + f""", g AS (SELECT engine, source, sum(b::INT - a::INT) AS net FROM p WHERE {_D} GROUP BY engine, source)
SELECT engine, {_c('net > 0')} AS wins, {_c('net < 0')} AS losses, {_c('net = 0')} AS ties, sum(net)::BIGINT AS net FROM g GROUP BY engine""")
def family_net_delta(spark, sf):
    both = _pairs(spark, sf).where("a_flagged IS NOT NULL AND b_flagged IS NOT NULL")
    fam = both.groupBy("engine", "source").agg(F.sum(F.col("b_flagged").cast("int") - F.col("a_flagged").cast("int")).alias("net"))
    return fam.groupBy("engine").agg(F.count_if(F.col("net") > 0).alias("wins"), F.count_if(F.col("net") < 0).alias("losses"), F.count_if(F.col("net") == 0).alias("ties"), F.sum("net").cast("long").alias("net"))


@query("""SELECT event_type, count(*) AS requests, count(value) AS known, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.95), 6) AS p95_cont,
CASE WHEN count(*) = count(value) THEN round(sum(value), 4) END AS total FROM events GROUP BY event_type""")
def latency_quantiles(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy("event_type")
    return rows.agg(
        F.count("*").alias("requests"), F.count("value").alias("known"), F.round(F.avg("value"), 6).alias("mean_value"), metrics.nearest_rank("value", 0.5, "p50"), metrics.nearest_rank("value", 0.95, "p95"),
        F.round(F.percentile("value", 0.95), 6).alias("p95_cont"), F.when(F.count("*") == F.count("value"), F.round(F.sum("value"), 4)).alias("total"),
    )


@query("""WITH q AS (SELECT user_id AS run, event_type AS request, count(*) AS attempts, max(value) AS cost, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL)
SELECT run, count(DISTINCT request) AS requests, sum(attempts)::BIGINT AS dispatch_attempts, count(cost) AS priced, round(sum(cost), 4) AS cost, round(sum(coalesce(cost, 0.1)), 4) AS with_allowance FROM q GROUP BY run""")
def run_spend(spark, sf):
    requests = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("request")).agg(F.count("*").alias("attempts"), F.max("value").alias("cost"))
    return requests.groupBy("run").agg(
        F.count_distinct("request").alias("requests"), F.sum("attempts").alias("dispatch_attempts"), F.count("cost").alias("priced"), F.round(F.sum("cost"), 4).alias("cost"),
        F.round(F.sum(F.coalesce("cost", F.lit(0.1))), 4).alias("with_allowance"),
    )


@query("""SELECT event_id, round(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS reserved, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 500 AS within FROM events""")
def reservation_ledger(spark, sf):
    running = F.sum(F.abs("value")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return fx.table(spark, sf, "events").select("event_id", F.round(running, 4).alias("reserved"), (running <= 500).alias("within"))
