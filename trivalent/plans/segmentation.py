"""Queries over cases, turns, segments and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions.text import seed_for, sha
from trivalent.operators import metrics, segment, turns, verdict
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query

TURNS_SQL = """t AS (SELECT conv_id AS case_id, turn, role, text, CASE role WHEN 'system' THEN 'operator' WHEN 'assistant' THEN 'agent' ELSE 'external' END AS origin FROM conversations)"""


@query(f"""WITH {fx.STRICT} SELECT lang, count(*) AS cases, count(*) FILTER (positive AND flagged) AS tp, count(*) FILTER (positive AND NOT flagged) AS fn,
count(*) FILTER (NOT positive AND flagged) AS fp, count(*) FILTER (NOT positive AND NOT flagged) AS tn, count(*) FILTER (flagged IS NULL) AS incomplete,
round(count(*) FILTER (positive AND flagged) / nullif(count(*) FILTER (positive AND flagged IS NOT NULL), 0)::DOUBLE, 6) AS detection_rate,
round(count(*) FILTER (NOT positive AND flagged) / nullif(count(*) FILTER (NOT positive AND flagged IS NOT NULL), 0)::DOUBLE, 6) AS false_positive_rate
FROM v WHERE strategy = 'window' AND engine = 1 GROUP BY lang""")
def q_full_window_rates(spark, sf):
    obs = fx.observations(spark, sf).where("strategy = 'window' AND engine = 1")
    decided = verdict.strict(verdict.with_rules(verdict.summarise(obs, fx.KEYS), fx.rules(spark).where("rule_id = 'max_5'")))
    return metrics.confusion(decided, ["lang"])


@query(f"WITH {fx.CASES} SELECT case_id, positive, lang, source, sha256(text) AS text_sha256, case_id || '/source' AS turn_id, 'external' AS origin FROM c")
def cases_from_documents(spark, sf):
    return fx.cases(spark, sf).select(
        "case_id", "positive", "lang", "source", sha("text").alias("text_sha256"), F.concat_ws("/", "case_id", F.lit("source")).alias("turn_id"), F.lit("external").alias("origin")
    )


@query(f"""WITH {TURNS_SQL} SELECT case_id, count(*) AS n_turns, count(*) FILTER (origin = 'external') AS n_external, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256,
string_agg(case_id || '/' || turn, ',' ORDER BY turn) AS turn_ids FROM t GROUP BY case_id""")
def cases_from_conversations(spark, sf):
    cases = turns.cases_of_turns(fx.table(spark, sf, "conversations"))
    external = F.size(F.filter("turns", lambda t: t["origin"] == "external"))
    return cases.select(
        "case_id", F.size("turns").cast("long").alias("n_turns"), external.cast("long").alias("n_external"), "text_sha256", F.array_join("turns.id", ",").alias("turn_ids")
    )


@query(f"""WITH {TURNS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn DESC) AS back FROM t WHERE origin = 'external')
SELECT case_id, 'all' AS selection, count(*) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM t GROUP BY case_id
UNION ALL SELECT case_id, 'all_external', count(*), string_agg(text, chr(10) ORDER BY turn) FROM x GROUP BY case_id
UNION ALL SELECT case_id, 'last_external', 1, text FROM x WHERE back = 1""")
def turn_selection(spark, sf):
    cases = turns.cases_of_turns(fx.table(spark, sf, "conversations"))
    kinds = ("all", "all_external", "last_external")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("selection"), turns.select_turns("turns", k).alias("t")) for k in kinds]))
    rows = cases.select("case_id", each.alias("s")).where("s.t IS NOT NULL")
    return rows.select("case_id", "s.selection", F.size("s.t").cast("long").alias("n_turns"), F.array_join("s.t.text", "\n").alias("text"))


@query(f"""WITH {TURNS_SQL} SELECT origin, CASE origin WHEN 'external' THEN 'abort' ELSE 'observe' END AS action, count(*) AS turns FROM t GROUP BY ALL""")
def origin_actions(spark, sf):
    rows = fx.table(spark, sf, "conversations").withColumn("origin", turns.origin_of("role"))
    return rows.groupBy("origin", turns.action_for("origin").alias("action")).agg(F.count("*").alias("turns"))


@query(f"WITH {fx.SEGMENTS} SELECT case_id, idx, sha256(segment) AS sha FROM s WHERE strategy = 'full'")
def seg_full(spark, sf):
    return segment.full_text(fx.cases(spark, sf)).select("case_id", F.col("idx").cast("long").alias("idx"), sha("segment").alias("sha"))


@query(f"WITH {fx.SEGMENTS} SELECT case_id, idx, segment FROM s WHERE strategy = 'window'")
def seg_sliding(spark, sf):
    return segment.sliding(fx.cases(spark, sf), fx.WINDOW, fx.STRIDE).select("case_id", F.col("idx").cast("long").alias("idx"), "segment")


_PRESERVE = rf"""WITH {fx.CASES}, p AS (SELECT case_id, regexp_extract_all(text, '\s*\S+') AS w, regexp_extract(text, '\s*$') AS tail FROM c WHERE trim(text) <> ''),
x AS (SELECT *, unnest(range(0, len(w), 64)) AS i FROM p),
y AS (SELECT case_id, i // 64 AS idx, i AS start_word, least(i + 128, len(w)) AS end_word, array_to_string(w[i + 1:i + 128], '') || CASE WHEN i + 128 >= len(w) THEN tail ELSE '' END AS segment FROM x)"""


@query(_PRESERVE + " SELECT * FROM y")
def seg_preserve(spark, sf):
    rows = segment.sliding_preserve(fx.cases(spark, sf), fx.WINDOW, fx.STRIDE)
    return rows.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "start_word", "end_word")], "segment")


@query(rf"""WITH {TURNS_SQL}, w AS (SELECT *, string_split_regex(trim(text), '\s+') AS w FROM t WHERE origin = 'external' AND trim(text) <> ''),
x AS (SELECT *, unnest(range(0, len(w), 16)) AS i FROM w), k AS (SELECT * FROM x WHERE i = 0 OR i - 16 + 32 < len(w))
SELECT case_id, turn, row_number() OVER (PARTITION BY case_id ORDER BY turn, i) - 1 AS idx, i AS start_word, least(i + 32, len(w)) AS end_word, array_to_string(w[i + 1:i + 32], ' ') AS segment FROM k""")
def seg_source_spans(spark, sf):
    rows = fx.table(spark, sf, "conversations").withColumn("case_id", F.col("conv_id")).where(turns.origin_of("role") == "external")
    spans = segment.source_spans(rows, 32, 16)
    return spans.select("case_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("idx", "start_word", "end_word")], "segment")


def _bounds(spark, sf):
    return segment.sliding(fx.cases(spark, sf), fx.WINDOW, fx.STRIDE)


_BOUNDS = f"WITH {fx.CASES}, {fx.WORDS}, b AS (SELECT case_id, i // 64 AS idx, i AS start_word, least(i + 128, len(w)) AS end_word, len(w) AS n FROM (SELECT *, unnest(range(0, len(w), 64)) AS i FROM cw))"


@query(_BOUNDS + " SELECT case_id, idx, start_word, end_word FROM b QUALIFY coalesce(end_word > max(end_word) OVER (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)")
def seg_coverage_a(spark, sf):
    return segment.coverage_new_words(_bounds(spark, sf), ["case_id"]).select("case_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "start_word", "end_word")])


@query(_BOUNDS + " SELECT case_id, idx, start_word, end_word FROM b QUALIFY idx <= min(CASE WHEN end_word >= n THEN idx END) OVER (PARTITION BY case_id)")
def seg_coverage_b(spark, sf):
    return segment.coverage_to_end(_bounds(spark, sf), ["case_id"]).select("case_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "start_word", "end_word")])


@query(f"""WITH RECURSIVE {fx.CASES}, {fx.WORDS}, k AS (SELECT case_id, w, len(w) AS n, xor((42 # (200 * 65537))::BIGINT & 4294967295, case_id + 1) & 4294967295 AS seed FROM cw),
g AS (SELECT case_id, w, n, seed AS state, 0::BIGINT AS start_word, 0::BIGINT AS end_word, -1::BIGINT AS idx FROM k WHERE n > 0
 UNION ALL SELECT case_id, w, n, CASE WHEN least(50, n - end_word) >= least(200, n - end_word) THEN state ELSE (state * 1664525 + 1013904223) & 4294967295 END, end_word,
  end_word + CASE WHEN least(50, n - end_word) >= least(200, n - end_word) THEN least(50, n - end_word)
   ELSE least(50, n - end_word) + floor(((state * 1664525 + 1013904223) & 4294967295) / 4294967296.0::DOUBLE * (least(200, n - end_word) - least(50, n - end_word) + 1))::BIGINT END, idx + 1 FROM g WHERE end_word < n)
SELECT case_id, idx, start_word, end_word, array_to_string(w[start_word + 1:end_word], ' ') AS segment FROM g WHERE idx >= 0""".replace("(42 # (200 * 65537))::BIGINT & 4294967295", str((42 ^ (200 * 65537)) & 0xFFFFFFFF)))
def seg_random_lcg(spark, sf):
    seed = seed_for("xor_case_ordinal_v1", 42, 200, "case_id")
    rows = segment.random_chunks(fx.cases(spark, sf), 50, 200, seed)
    return rows.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("idx", "start_word", "end_word")], "segment")


@query("""WITH RECURSIVE g AS (SELECT c_custkey, 0::BIGINT AS i, c_custkey & 4294967295 AS state FROM customer UNION ALL SELECT c_custkey, i + 1, (state * 1664525 + 1013904223) & 4294967295 FROM g WHERE i < 15)
SELECT c_custkey, i, state, state / 4294967296.0::DOUBLE AS u FROM g""")
def lcg_stream(spark, sf):
    """The first states of each customer's own stream."""
    from trivalent.functions.text import lcg

    seed = F.col("c_custkey").bitwiseAND(F.lit(4294967295).cast("long"))
    states = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.sequence(F.lit(0), i), seed, lambda s, j: F.when(j == 0, s).otherwise(lcg(s))))
    rows = fx.table(spark, sf, "customer").select("c_custkey", F.posexplode(states).alias("i", "state"))
    return rows.select("c_custkey", F.col("i").cast("long").alias("i"), "state", (F.col("state") / F.lit(4294967296.0)).alias("u"))


_REDACT = """WITH sp AS (SELECT list(s ORDER BY length(s) DESC, s) AS spans FROM (SELECT DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM benchmark) WHERE length(s) >= 40),
r AS (SELECT doc_id AS case_id, text, list_reduce(list_concat([text], spans), lambda a, b: replace(a, b, ' ')) AS redacted FROM documents, sp)"""


@query(_REDACT + " SELECT case_id, sha256(redacted) AS sha, CASE WHEN trim(redacted) = '' THEN 'allow' END AS decision FROM r WHERE text <> redacted")
def redact_authored(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), "text")
    rows = turns.redact(docs, fx.table(spark, sf, "benchmark")).where(F.col("text") != F.col("redacted"))
    return rows.select("case_id", sha("redacted").alias("sha"), turns.redacted_decision("text", "redacted").alias("decision"))


@query(_REDACT + " SELECT count(*) AS cases, sum(length(text) - length(redacted))::BIGINT AS redacted_chars, count(*) FILTER (text <> redacted) AS touched FROM r")
def redacted_chars(spark, sf):
    docs = fx.table(spark, sf, "documents").select("text")
    rows = turns.redact(docs, fx.table(spark, sf, "benchmark"))
    return rows.agg(F.count("*").alias("cases"), F.sum(F.length("text") - F.length("redacted")).cast("long").alias("redacted_chars"), F.count_if(F.col("text") != F.col("redacted")).alias("touched"))


@query(f"WITH {fx.SEGMENTS} SELECT case_id || '/' || idx AS segment_id, strategy, sha256(segment) AS text_sha256, len(string_split_regex(trim(segment), '\\s+')) AS n_words, strlen(segment) AS n_bytes FROM s")
def segment_hash(spark, sf):
    rows = segment.identify(fx.segments(spark, sf))
    return rows.select("segment_id", "strategy", "text_sha256", F.col("n_words").cast("long").alias("n_words"), F.col("n_bytes").cast("long").alias("n_bytes"))


@query(f"""WITH {fx.SEGMENTS} SELECT case_id, idx, row_number() OVER w = 1 AS native, first_value(case_id || '/' || idx) OVER w AS source_id FROM s WHERE strategy = 'window'
WINDOW w AS (PARTITION BY sha256(segment) ORDER BY case_id, idx)""")
def dedup_exact_input(spark, sf):
    rows = segment.identify(fx.segments(spark, sf).where("strategy = 'window'"))
    return segment.first_native(rows, ["case_id", "idx"]).select("case_id", "idx", "native", "source_id")
