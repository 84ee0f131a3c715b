"""Sources and sinks over whole tables: what is written is read back, and must say what the table says."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions.text import sha
from trivalent.operators import cohorts, scoring
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query
from trivalent.session import shared_dir
from trivalent.sources import files, lines
from trivalent.streaming import events as streams

_F = F.col


@query("""SELECT '{"c_custkey":' || c_custkey || ',"name":{"a":"' || c_mktsegment || '","b":[' || c_nationkey || ',' || c_custkey % 7 || ']},"z":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_name || '"' END || '}' AS value FROM customer""")
def canonical_customers(spark, sf):
    """Rows as compact JSON with keys in order at every depth, written and read back."""
    rows = fx.table(spark, sf, "customer").select(
        F.when(_F("c_custkey") % 3 != 0, _F("c_name")).alias("z"), F.struct(F.array(_F("c_nationkey").cast("long"), _F("c_custkey") % 7).alias("b"), _F("c_mktsegment").alias("a")).alias("name"), "c_custkey"
    )
    path = streams.stored_lines(files.canonical_lines(rows), "canonical")
    return lines.read_lines(spark, path, size=1 << 16).select(_F("text").alias("value"))


@query("SELECT doc_id::VARCHAR AS case_id, sha256(text) AS text_sha256, doc_id % 3 = 0 AS positive FROM documents WHERE text IS NOT NULL AND text <> ''")
def csv_cases(spark, sf):
    """Whole texts, line ends and quotes among them, written as CSV and read as cases."""
    rows = fx.table(spark, sf, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "text", (_F("doc_id") % 3).alias("k"))
    path = shared_dir(spark, "csv")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = files.read_csv(spark, path, "text", _F("k") == "0", "doc_id")
    return found.select("case_id", sha("text").alias("text_sha256"), "positive")


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN doc_id % 100 END AS score, CASE WHEN doc_id % 5 < 4 THEN lang END AS lang FROM documents")
def unfenced_answers(spark, sf):
    """JSON answers bare, in fences of two kinds, with blanks around, and texts that are none."""
    body = F.concat(F.lit('{"score":'), _F("doc_id") % 100, F.lit(',\n"lang":"'), "lang", F.lit('"}'))
    forms = [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("```\n"), body, F.lit("\n```  ")), F.concat(F.lit("  "), body, F.lit("\n")), F.concat(F.lit("It is "), body)]
    rows = fx.table(spark, sf, "documents").select("doc_id", files.unfence(F.element_at(F.array(*forms), (_F("doc_id") % 5 + 1).cast("int"))).alias("v"))
    return rows.select("doc_id", F.try_variant_get("v", "$.score", "long").alias("score"), F.try_variant_get("v", "$.lang", "string").alias("lang"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL")
def storable_texts(spark, sf):
    """Texts with NUL characters between their words, made fit to store."""
    docs = fx.table(spark, sf, "documents").where("text IS NOT NULL")
    dirty = F.concat(F.lit("\0"), F.replace(_F("text"), F.lit(" "), F.lit(" \0")), F.lit("\0"))
    return docs.select("doc_id", sha(files.storable(dirty)).alias("text_sha256"))


@query("""WITH f AS (SELECT 'run-' || user_id % 9 AS run, event_id FROM events WHERE event_id % 4 <> 1) SELECT run, count(*) AS lines, sum(event_id)::BIGINT AS total, dense_rank() OVER (ORDER BY run) AS nth FROM f GROUP BY run""")
def run_files(spark, sf):
    """Lines written below a folder for each run, found by a walk of all files in order of their paths."""
    rows = fx.table(spark, sf, "events").where("event_id % 4 <> 1").select(F.concat(F.lit("run-"), _F("user_id") % 9).alias("run"), F.to_json(F.struct(F.lit("event").alias("type"), "event_id")).alias("value"))
    path = shared_dir(spark, "runs")
    rows.write.partitionBy("run").text(path)
    found = files.read_events(spark, path, size=1 << 16).select(F.regexp_extract("file", "/run=([^/]+)/", 1).alias("run"), F.try_variant_get("event", "$.event_id", "long").alias("id"))
    names = list(dict.fromkeys(f.split("/run=")[1].split("/")[0] for f in lines.listed(path) if "/run=" in f))
    order = spark.createDataFrame([(r, i) for i, r in enumerate(names, 1)], "run string, nth long")  # a row for each run's folder
    return found.groupBy("run").agg(F.count("*").alias("lines"), F.sum("id").alias("total")).join(order, "run")


@query("SELECT doc_id AS case_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_cases(spark, sf):
    """The cases of a list of ids."""
    ids = fx.table(spark, sf, "labels").where("toxic = 1").select(_F("doc_id").alias("case_id")).join(fx.table(spark, sf, "documents").select(_F("doc_id").alias("case_id")), "case_id", "left_semi").distinct()
    return cohorts.selected(fx.table(spark, sf, "documents").select(_F("doc_id").alias("case_id"), "lang"), ids)


@query(f"WITH {fx.SEGMENTS} SELECT case_id, idx FROM s WHERE strategy = 'window' AND (case_id * 3 + idx) % 4 <> 0")
def resumed_segments(spark, sf):
    """What a run, written to a checkpoint and found there again, has left to do."""
    planned = fx.segments(spark, sf).where("strategy = 'window'").select("case_id", "idx", F.lit("engine-1").alias("engine"), F.lit(None).cast("string").alias("note"))
    path = shared_dir(spark, "checkpoint")
    files.append_run(planned.where("(case_id * 3 + idx) % 4 = 0"), path, "run-1")
    done = spark.read.schema("case_id long, idx long, engine string, note string, run_id string").parquet(path)
    return files.unfinished(planned, done, ["case_id", "idx"], ["engine", "note"]).select("case_id", "idx")


@query(f"WITH {fx.OBSERVATIONS} SELECT engine, case_id, max(score) - min(score) > 0.5 AND count(score) > 1 AS flagged FROM o WHERE strategy = 'window' AND score IS NOT NULL GROUP BY ALL")
def function_verdicts(spark, sf):
    """Cases decided by a function of all their scores: whether they are far apart."""
    rows = fx.observations(spark, sf).where("strategy = 'window' AND score IS NOT NULL").select("engine", "case_id", "score")
    return scoring.function_aggregate(rows, ["engine", "case_id"], lambda pdf: len(pdf) > 1 and pdf["score"].max() - pdf["score"].min() > 0.5)
