"""The stand-ins that the queries run on: labelled documents as cases, and deterministic scores by key arithmetic.

The same tables as DuckDB common table expressions are in `CASES`, `SEGMENTS` and `OBSERVATIONS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import segment

WINDOW, STRIDE = 128, 64
ENGINES = (1, 2, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), (F.col("toxic") == 1).alias("positive"))
    return docs.join(labels, "case_id")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = cases(spark, sf_dir)
    cols = ["case_id", "positive", "lang", "source", "strategy", F.col("idx").cast("long").alias("idx"), "segment"]
    full = segment.full_text(base).withColumn("strategy", F.lit("full")).select(*cols)
    return full.unionByName(segment.sliding(base, WINDOW, STRIDE).withColumn("strategy", F.lit("window")).select(*cols))


def _key(a: int, b: int, c: int) -> Column:
    return F.col("case_id") * a + F.col("idx") * b + F.col("engine") * c


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment by every engine, with an outcome and a score."""
    rows = segments(spark, sf_dir).drop("segment").withColumn("engine", F.explode(F.array(*[F.lit(e).cast("long") for e in ENGINES])))
    outcome = F.when(_key(31, 17, 13) % 211 == 1, "error").when(_key(31, 17, 13) % 37 == 0, "abstained").otherwise("scored")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("score", F.when(F.col("outcome") == "scored", _key(7919, 104729, 15485863) % 1001 / 1000.0))


CASES = "c AS (SELECT d.doc_id AS case_id, d.text, d.lang, d.source, l.toxic = 1 AS positive FROM documents d JOIN labels l USING (doc_id))"
WORDS = r"cw AS (SELECT *, CASE WHEN trim(text) = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') END AS w FROM c)"
SEGMENTS = f"""{CASES}, {WORDS},
s AS (SELECT case_id, positive, lang, source, 'full' AS strategy, 0::BIGINT AS idx, text AS segment FROM c WHERE trim(text) <> ''
  UNION ALL SELECT case_id, positive, lang, source, 'window', i // {STRIDE}, array_to_string(w[i + 1:i + {WINDOW}], ' ') FROM (SELECT *, unnest(range(0, len(w), {STRIDE})) AS i FROM cw))"""
OBSERVATIONS = f"""{SEGMENTS},
oe AS (SELECT case_id, positive, lang, source, strategy, idx, engine, (case_id * 31 + idx * 17 + engine * 13) AS k, ((case_id * 7919 + idx * 104729 + engine * 15485863) % 1001) / 1000.0::DOUBLE AS raw
  FROM s, (SELECT unnest([1, 2, 3])::BIGINT AS engine)),
oo AS (SELECT *, CASE WHEN k % 211 = 1 THEN 'error' WHEN k % 37 = 0 THEN 'abstained' ELSE 'scored' END AS outcome FROM oe),
o AS (SELECT *, CASE WHEN outcome = 'scored' THEN raw END AS score FROM oo)"""
SUMMARY = f"""{OBSERVATIONS},
m AS (SELECT engine, strategy, case_id, positive, lang, source, count(*) AS expected, count(*) FILTER (outcome = 'scored') AS scored, count(*) FILTER (outcome = 'abstained') AS abstained,
  count(*) FILTER (outcome IN ('error', 'unscored')) AS unresolved, max(score) AS max_score, avg(score) AS mean_score, min(score) AS min_score FROM o GROUP BY ALL)"""
#: The strict verdict of each case under max > 0.5.
STRICT = f"{SUMMARY}, v AS (SELECT *, CASE WHEN scored = expected THEN max_score > 0.5 END AS flagged FROM m)"
KEYS = ["engine", "strategy", "case_id", "positive", "lang", "source"]
RULES = [("max_5", "max", ">", 0.5), ("max_9", "max", ">=", 0.9), ("mean_4", "mean", ">", 0.4), ("min_1", "min", ">", 0.1)]
RULES_SQL = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in RULES) + ") AS t(rule_id, aggregation, comparator, threshold))"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, aggregation string, comparator string, threshold double")
