"""Queries over statistics: intervals, tests, curves, thresholds, samples and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions import stats
from trivalent.functions.text import sha, words
from trivalent.operators import metrics, resampling, statistics
from trivalent.plans import fixtures as fx
from trivalent.plans.evaluation import CELLS_SQL, PAIRS_SQL, ROWS_SQL, _pairs, case_rows
from trivalent.plans.registry import query

_Z = stats.Z95


def _wilson(k, n):
    p, den = f"(({k})::DOUBLE / ({n}))", f"(1 + {_Z}::DOUBLE * {_Z} / ({n}))"
    centre, half = f"({p} + {_Z}::DOUBLE * {_Z} / (2 * ({n}))) / {den}", f"{_Z}::DOUBLE * sqrt({p} * (1 - {p}) / ({n}) + {_Z}::DOUBLE * {_Z} / (4 * ({n})::DOUBLE * ({n}))) / {den}"
    return f"(CASE WHEN ({n}) = 0 THEN NULL WHEN ({k}) = 0 THEN 0.0::DOUBLE ELSE {centre} - {half} END)", f"(CASE WHEN ({n}) = 0 THEN NULL WHEN ({k}) = ({n}) THEN 1.0::DOUBLE ELSE {centre} + {half} END)"


@query(CELLS_SQL + f" SELECT test, engine, true_positives, positives_scored, round({_wilson('true_positives', 'positives_scored')[0]}, 6) AS lower95, round({_wilson('true_positives', 'positives_scored')[1]}, 6) AS upper95 FROM cell")
def wilson(spark, sf):
    cells = metrics.cell_summary(case_rows(spark, sf), ["test", "engine"])
    low, high = stats.wilson(F.col("true_positives"), F.col("positives_scored"))
    return cells.select("test", "engine", "true_positives", "positives_scored", F.round(low, 6).alias("lower95"), F.round(high, 6).alias("upper95"))


_CELLS4 = PAIRS_SQL + """, q AS (SELECT engine, source, count(*) FILTER (a AND b) AS a, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c, count(*) FILTER (NOT a AND NOT b) AS d FROM p GROUP BY engine, source)"""


def _cells4(spark, sf):
    f, w = F.col("a_flagged"), F.col("b_flagged")
    return _pairs(spark, sf).groupBy("engine", "source").agg(F.count_if(f & w).alias("a"), F.count_if(f & ~w).alias("b"), F.count_if(~f & w).alias("c"), F.count_if(~f & ~w).alias("d"))


_MCNEMAR = _CELLS4 + """, k AS (SELECT engine, source, b, c, b + c AS n, least(b, c) AS k FROM q),
t AS (SELECT engine, source, b, c, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))))) END AS p FROM k)"""


@query(_MCNEMAR + " SELECT engine, source, b, c, round(p, 6) AS p FROM t")
def mcnemar_exact(spark, sf):
    return _cells4(spark, sf).select("engine", "source", "b", "c", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p"))


@query(_MCNEMAR + """, u AS (SELECT engine, source, round(p, 6) AS p FROM t), h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY engine) - row_number() OVER (PARTITION BY engine ORDER BY p, source) + 1) * p) AS s,
row_number() OVER (PARTITION BY engine ORDER BY p, source) AS i FROM u) SELECT engine, source, p, round(max(s) OVER (PARTITION BY engine ORDER BY i), 6) AS p_holm FROM h""")
def holm(spark, sf):
    rows = _cells4(spark, sf).select("engine", "source", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p"))
    return stats.holm(rows, "p", ["engine"], tie="source").withColumn("p_holm", F.round("p_holm", 6))


_W1, _W2 = _wilson("a + b", "a + b + c + d"), _wilson("a + c", "a + b + c + d")


@query(_CELLS4 + f""", i AS (SELECT *, (a + b)::DOUBLE / (a + b + c + d) AS p1, (a + c)::DOUBLE / (a + b + c + d) AS p2, {_W1[0]} AS l1, {_W1[1]} AS u1, {_W2[0]} AS l2, {_W2[1]} AS u2,
coalesce((a * d - b * c) / nullif(sqrt(((a + b) * (c + d) * (a + c) * (b + d))::DOUBLE), 0), 0) AS phi FROM q)
SELECT engine, source, round(p1 - p2, 6) AS diff, round(p1 - p2 - sqrt(greatest(0, (p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2)), 6) AS lower95,
round(p1 - p2 + sqrt(greatest(0, (p2 - l2) ** 2 - 2 * phi * (p2 - l2) * (u1 - p1) + (u1 - p1) ** 2)), 6) AS upper95 FROM i""")
def newcombe(spark, sf):
    diff, low, high = stats.newcombe(*[F.col(x) for x in "abcd"])
    return _cells4(spark, sf).select("engine", "source", F.round(diff, 6).alias("diff"), F.round(low, 6).alias("lower95"), F.round(high, 6).alias("upper95"))


_RANK = """, g AS (SELECT test, engine, positive, score, rank() OVER (PARTITION BY {0} ORDER BY score) + (count(*) OVER (PARTITION BY {0}, score) - 1) / 2.0 AS r FROM w WHERE score IS NOT NULL),
a AS (SELECT {0}, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n, sum(r) FILTER (positive) AS s FROM g GROUP BY {0})"""


@query(f"WITH {ROWS_SQL}" + _RANK.format("engine") + " SELECT engine, p AS positives, n AS negatives, round((s - p * (p + 1) / 2.0) / nullif(p * n, 0)::DOUBLE, 6) AS auroc FROM a")
def auroc(spark, sf):
    rows = stats.auroc(case_rows(spark, sf), "score", "positive", ["engine"])
    return rows.select("engine", "positives", "negatives", F.round("auroc", 6).alias("auroc"))


@query(f"WITH {ROWS_SQL}" + _RANK.format("test, engine") + " SELECT engine, round(sum(s - p * (p + 1) / 2.0) FILTER (p > 0 AND n > 0) / nullif(sum(p * n), 0)::DOUBLE, 6) AS auroc FROM a GROUP BY engine")
def stratified_auroc(spark, sf):
    rows = stats.auroc(case_rows(spark, sf), "score", "positive", ["test", "engine"])
    pairs = F.col("positives") * F.col("negatives")
    return rows.groupBy("engine").agg(F.round(stats.ratio(F.sum(F.when(pairs > 0, F.col("wins"))), F.sum(pairs)), 6).alias("auroc"))


_TH = [round(i / 20, 2) for i in range(1, 20)]


@query(f"""WITH {ROWS_SQL}, t AS (SELECT unnest({_TH})::DOUBLE AS threshold), b AS (SELECT engine, threshold, round((count(*) FILTER (positive AND score > threshold) / nullif(count(*) FILTER (positive), 0)::DOUBLE
 + count(*) FILTER (NOT positive AND score <= threshold) / nullif(count(*) FILTER (NOT positive), 0)::DOUBLE) / 2, 9) AS ba FROM w, t WHERE score IS NOT NULL GROUP BY ALL)
SELECT engine, threshold, round(ba, 6) AS balanced_accuracy FROM b QUALIFY row_number() OVER (PARTITION BY engine ORDER BY ba DESC, abs(threshold - 0.5), threshold DESC) = 1""")
def oracle_threshold(spark, sf):
    return statistics.oracle_threshold(case_rows(spark, sf), "score", "positive", ["engine"], _TH)


@query("""SELECT doc_id, lang, pick::INTEGER AS pick FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-1' || chr(0) || doc_id), doc_id) AS pick FROM documents) WHERE pick <= 20""")
def stratified_sample(spark, sf):
    return statistics.stratified_sample(fx.table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 20, "seed-1").select("doc_id", "lang", "pick")


@query("""WITH n AS (SELECT doc_id, lang, length(text) AS len, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS n FROM documents),
e AS (SELECT lang, max(CASE WHEN nth = n // 3 THEN len END) AS e1, max(CASE WHEN nth = 2 * n // 3 THEN len END) AS e2 FROM n GROUP BY lang)
SELECT doc_id, (len >= e1)::INT + (len >= e2)::INT AS stratum FROM n JOIN e USING (lang)""")
def length_strata(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("len"))
    return statistics.length_strata(docs, "len", 3, "doc_id", ["lang"]).select("doc_id", "stratum")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-2' || chr(0) || doc_id), doc_id) - 1 AS round FROM documents)
SELECT doc_id, lang, round::INTEGER AS round FROM r ORDER BY round, lang LIMIT 50""")
def round_robin_subset(spark, sf):
    return statistics.round_robin(fx.table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, "seed-2")


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS body, sha256('seed-3' || chr(0) || doc_id) AS h FROM documents),
a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY body ORDER BY h, doc_id) = 1) SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY left(body, 120) ORDER BY h, doc_id) = 1""")
def near_dedup_prefix(spark, sf):
    """Texts of one body have one head, so the first row of each head is also the first of its body."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    docs = docs.select("doc_id", F.substring(F.array_join(words("t"), " "), 1, 120).alias("head"), statistics.hash_rank("seed-3", "doc_id").alias("h"))
    return docs.groupBy("head").agg(F.min_by("doc_id", F.struct("h", "doc_id")).alias("doc_id")).select("doc_id")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def unique_text(spark, sf):
    return fx.table(spark, sf, "documents").groupBy(sha("text")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query(f"""WITH {ROWS_SQL}, d AS (SELECT x.test, x.tokens - y.tokens + (x.case_id % 7) - 3 AS d FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 2), z AS (SELECT * FROM d WHERE d <> 0),
rk AS (SELECT test, d, rank() OVER (PARTITION BY test ORDER BY abs(d)) + (count(*) OVER (PARTITION BY test, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY test, abs(d)) AS t FROM z),
sm AS (SELECT test, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, sum(t * t - 1) AS ties FROM rk GROUP BY test)
SELECT test, n, w_plus, round((w_plus - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 0), 6) AS z FROM sm""")
def wilcoxon(spark, sf):
    pairs = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test"], ["tokens"])
    return statistics.wilcoxon(pairs.withColumn("d", F.col("a_tokens") - F.col("b_tokens") + F.col("case_id") % 7 - 3), ["test"], "d").drop("p")


@query()
def wilcoxon_p(spark, sf):
    pairs = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test"], ["tokens"])
    return statistics.wilcoxon(pairs.withColumn("d", F.col("a_tokens") - F.col("b_tokens") + F.col("case_id") % 7 - 3), ["test"], "d")


@query(f"""WITH {ROWS_SQL}, e AS (SELECT engine, coalesce(score, CASE WHEN positive THEN 0 ELSE 1 END) > 0.5 AS flagged, positive FROM w)
SELECT engine, count(*) AS cases, count(*) FILTER (flagged = positive) AS correct FROM e GROUP BY engine""")
def abstention_as_error(spark, sf):
    rows = case_rows(spark, sf).withColumn("s", F.coalesce("score", F.when(F.col("positive"), 0.0).otherwise(1.0)))
    return rows.groupBy("engine").agg(F.count("*").alias("cases"), F.count_if((F.col("s") > 0.5) == F.col("positive")).alias("correct"))


@query(f"""WITH {ROWS_SQL}, x AS (SELECT engine, test, avg((score > 0.5)::INT) FILTER (case_id % 2 = 0) - avg((score > 0.5)::INT) FILTER (case_id % 2 = 1) AS d FROM w WHERE score IS NOT NULL GROUP BY engine, test)
SELECT engine, round(avg(d), 6) AS risk_difference, count(d) AS tests FROM x GROUP BY engine""")
def mean_risk_difference(spark, sf):
    hit = (F.col("score") > 0.5).cast("int")
    by = case_rows(spark, sf).where("score IS NOT NULL").groupBy("engine", "test")
    d = by.agg((F.avg(F.when(F.col("case_id") % 2 == 0, hit)) - F.avg(F.when(F.col("case_id") % 2 == 1, hit))).alias("d"))
    return d.groupBy("engine").agg(F.round(F.avg("d"), 6).alias("risk_difference"), F.count("d").alias("tests"))


@query()
def cluster_bootstrap(spark, sf):
    rows = _pairs(spark, sf).where("a_flagged IS NOT NULL AND b_flagged IS NOT NULL")
    rows = rows.select("engine", "source", (F.col("b_flagged").cast("int") - F.col("a_flagged").cast("int")).alias("v"), F.lit(1).alias("w"))
    return statistics.cluster_bootstrap(rows, ["engine"], "source", "v", "w")


@query()
def family_bootstrap_exact(spark, sf):
    rows = _pairs(spark, sf).where("a_flagged IS NOT NULL AND b_flagged IS NOT NULL")
    return resampling.family_bootstrap(rows.select("engine", "source", (F.col("b_flagged").cast("int") - F.col("a_flagged").cast("int")).alias("v")), ["engine"], "source", "v")


@query()
def stratified_logit(spark, sf):
    rows = case_rows(spark, sf).where("engine = 1 AND score IS NOT NULL")
    return statistics.stratified_logit(rows.select("test", "score", (F.col("tokens") / 1000).alias("tokens"), F.col("positive").cast("int").alias("y")), "test", ["score", "tokens"], "y")


def _fitted(spark, sf):
    rows = case_rows(spark, sf).where("engine = 1 AND score IS NOT NULL")
    return rows.select("test", "case_id", (F.col("case_id") % 40).alias("cluster"), "score", F.log2(F.col("tokens") + 1).alias("size"), (F.col("case_id") % 2).cast("double").alias("arm"), "positive", F.col("positive").cast("int").alias("y"))


@query()
def contrast_log_odds(spark, sf):
    """The log odds ratio of the odd cases against the even ones."""
    found = statistics.log_odds_ratio(_fitted(spark, sf), "test", "arm", ["size"], "y")
    return spark.createDataFrame([(None if found is None else round(found, 6),)], "log_odds_ratio double")


@query()
def cross_validated_auroc(spark, sf):
    rows = statistics.cross_validated(_fitted(spark, sf), "test", "cluster", ["score", "size"], "y")
    return statistics.within_strata_auroc(rows, "out_of_fold", "positive", "test")


@query(rf"""WITH {fx.CASES}, {fx.WORDS}, n AS (SELECT case_id, lang, positive, len(w) AS n FROM cw), q AS (SELECT lang, positive, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, count(*) AS cases FROM n GROUP BY ALL)
SELECT case_id, CASE WHEN cases >= 20 THEN (n > q1)::INT + (n > q2)::INT + (n > q3)::INT END AS bin FROM n JOIN q USING (lang, positive)""")
def length_bins(spark, sf):
    rows = fx.cases(spark, sf).select("case_id", "lang", "positive", F.size(words("text")).alias("n"))
    return statistics.length_bins(rows, "n", ["lang", "positive"]).select("case_id", "bin")


def _deltas(spark, sf):
    rows = _pairs(spark, sf).where("a_flagged IS NOT NULL AND b_flagged IS NOT NULL")
    return rows.select("engine", "source", (F.col("b_flagged").cast("int") - F.col("a_flagged").cast("int")).alias("v"), F.col("positive").cast("int").alias("m"))


@query()
def family_bootstrap_joint(spark, sf):
    """Families' net deltas over their positive cases, the denominator as it is and drawn with the families."""
    return resampling.family_bootstrap(_deltas(spark, sf), ["engine"], "source", "v", "m")


def _rounded(found, columns):
    return found.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in found.dtypes if c in columns])


_REDRAWN = ["lang", "model", "cases", "place", "estimate", "lower", "upper", "top_share", "margin", "margin_lower", "margin_upper", "range", "range_lower", "range_upper", "sd", "sd_lower", "sd_upper"]


@query()
def shared_redraws_ba(spark, sf):
    """All three engines by the same redraws, over the sources of each language."""
    rows = case_rows(spark, sf).join(fx.cases(spark, sf).select("case_id", "source"), "case_id").withColumn("flag", F.col("flagged").cast("int"))
    return _rounded(resampling.shared_redraws(rows.withColumnRenamed("test", "lang"), ["lang"], "source", "case_id", "positive", "engine", "flag", [1, 2, 3]).withColumnRenamed("engine", "model"), _REDRAWN)


@query()
def shared_redraws_auroc(spark, sf):
    rows = case_rows(spark, sf).join(fx.cases(spark, sf).select("case_id", "source"), "case_id").withColumn("score", F.round("score", 2))
    return _rounded(resampling.shared_redraws(rows.withColumnRenamed("test", "lang"), ["lang"], "source", "case_id", "positive", "engine", "score", [1, 2, 3], "auroc", reps=500), _REDRAWN)


@query()
def nested_bootstrap_means(spark, sf):
    """The share of flagged cases, sources redrawn within their language."""
    rows = case_rows(spark, sf).where("flagged IS NOT NULL").select("engine", "test", F.concat(F.lit("c"), F.col("case_id") % 40).alias("cluster"), F.col("flagged").cast("int").alias("v"), F.lit(1).alias("w"))
    return _rounded(resampling.nested_bootstrap(rows, ["engine"], "test", "cluster", "v", "w"), ["engine", "estimate", "lower", "upper"])


@query("""WITH k AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY sha256('seed-4' || chr(0) || 't' || chr(0) || source), source LIMIT 7) SELECT doc_id, source FROM documents SEMI JOIN k USING (source)""")
def whole_group_subset(spark, sf):
    """All documents of seven sources, those of the least hash."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return resampling.whole_groups(docs, "source", 7, lambda key: sha(F.concat_ws("\0", F.lit("seed-4"), F.lit("t"), key)))
