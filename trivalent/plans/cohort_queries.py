"""Queries over cohorts, probes, policies, controls and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions.text import sha, words
from trivalent.operators import behavior, cohorts, metrics, segment
from trivalent.plans import fixtures as fx
from trivalent.plans.evaluation import ROWS_SQL, case_rows
from trivalent.plans.registry import query

_RUNS = [(1, 0, "all", None), (2, 0, "positive", 10), (3, 1, "negative", 25), (4, 1, "all", 40)]


@query(f"""WITH {fx.CASES}, r AS (SELECT * FROM (VALUES (1, 0, 'all', NULL), (2, 0, 'positive', 10), (3, 1, 'negative', 25), (4, 1, 'all', 40)) AS t(run, revision, selector, case_limit))
SELECT run, case_id FROM r JOIN c ON c.case_id % 2 = r.revision WHERE selector = 'all' OR (selector = 'positive') = positive QUALIFY case_limit IS NULL OR row_number() OVER (PARTITION BY run ORDER BY case_id) <= case_limit""")
def run_cases_limited(spark, sf):
    runs = spark.createDataFrame(_RUNS, "run int, revision long, selector string, case_limit int")
    cases = fx.cases(spark, sf).select((F.col("case_id") % 2).alias("revision"), "case_id", F.col("case_id").alias("ordinal"), "positive")
    return cohorts.run_cases(runs, cases).select("run", "case_id")


@query(f"""WITH {ROWS_SQL}, g AS (SELECT engine, test, CASE WHEN score IS NULL THEN 'none' ELSE round(score, 1)::VARCHAR END AS v, count(*) AS n FROM w GROUP BY ALL)
SELECT engine, test, sum(n)::BIGINT AS cases, string_agg(v || '=' || n, ',' ORDER BY v) AS histogram FROM g GROUP BY engine, test""")
def probe_groups(spark, sf):
    rows = case_rows(spark, sf).withColumn("v", F.round("score", 1))
    found = cohorts.probe_groups(rows, ["engine", "test"], "v")
    text = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("engine", "test", "cases", text.alias("histogram"))


_PROBE = f"WITH {ROWS_SQL}, pr AS (SELECT engine, CASE case_id % 3 WHEN 0 THEN 'control' ELSE 'attack' END AS kind, case_id // 2 AS family, CASE case_id % 2 WHEN 0 THEN 0.2 ELSE 0.9 END::DOUBLE AS target, round(score, 1) AS score, flagged FROM w)"


def _probes(spark, sf):
    c = F.col("case_id")
    kind = F.when(c % 3 == 0, "control").otherwise("attack")
    return case_rows(spark, sf).select("engine", kind.alias("kind"), F.floor(c / 2).alias("family"), F.when(c % 2 == 0, 0.2).otherwise(0.9).alias("target"), F.round("score", 1).alias("score"), "flagged")


@query(_PROBE + """, f AS (SELECT engine, kind, family, max(score) FILTER (target < 0.5) AS l, max(score) FILTER (target > 0.5) AS h FROM pr GROUP BY ALL)
SELECT engine, kind, count(*) AS families, count(l + h) AS both_valid, count(*) FILTER (l <= 0.5 AND h > 0.5) AS low_to_high_flips, count(*) FILTER (l IN (0.1::DOUBLE, 0.2::DOUBLE) AND h IN (0.8::DOUBLE, 0.9::DOUBLE)) AS matched_both_targets,
round(avg(h - l), 6) AS mean_high_minus_low FROM f GROUP BY engine, kind""")
def probe_pairs(spark, sf):
    return cohorts.probe_pairs(_probes(spark, sf), ["engine", "kind"], ["family"], "target", 0.2, 0.9)


@query(_PROBE + """ SELECT engine, kind, target, count(*) AS cases, count(score) AS scored, count(*) FILTER (flagged) AS flags, round(avg(score), 6) AS mean_score, count(*) FILTER (score IN (0.2::DOUBLE, 0.9::DOUBLE)) AS target_matches FROM pr GROUP BY ALL""")
def probe_targets(spark, sf):
    return _probes(spark, sf).groupBy("engine", "kind", "target").agg(
        F.count("*").alias("cases"), F.count("score").alias("scored"), F.count_if("flagged").alias("flags"), F.round(F.avg("score"), 6).alias("mean_score"),
        cohorts.target_matches("score", [F.lit(0.2), F.lit(0.9)]).alias("target_matches"),
    )


@query(f"""WITH {ROWS_SQL} SELECT x.test, count(*) FILTER (y.score > x.score) AS increased, count(*) FILTER (y.score < x.score) AS decreased, count(*) FILTER (y.score = x.score) AS unchanged,
count(*) FILTER (x.score <= 0.5 AND y.score > 0.5) AS crossed_up, count(*) FILTER (x.score > 0.5 AND y.score <= 0.5) AS crossed_down FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 3 GROUP BY x.test""")
def probe_shifts(spark, sf):
    return cohorts.shifts(metrics.pair(case_rows(spark, sf), "engine", 1, 3, ["case_id", "test"], ["score"]), ["test"])


@query(f"""WITH {ROWS_SQL} SELECT CASE WHEN NOT x.flagged AND y.flagged THEN 'both_correct' WHEN x.flagged AND y.flagged THEN 'always_flag' WHEN NOT x.flagged AND NOT y.flagged THEN 'never_flag'
WHEN x.flagged AND NOT y.flagged THEN 'reversed' END AS outcome, count(*) AS pairs FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 2 GROUP BY 1""")
def policy_pairs(spark, sf):
    pairs = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id"], ["flagged"])
    return pairs.groupBy(cohorts.policy_outcome(F.col("a_flagged"), F.col("b_flagged")).alias("outcome")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {ROWS_SQL} SELECT x.test, count(*) FILTER (x.positive AND x.flagged AND y.flagged) AS and_detected, count(*) FILTER (x.positive AND (x.flagged OR y.flagged)) AS or_detected,
count(*) FILTER (NOT x.positive AND x.flagged AND y.flagged) AS and_false, count(*) FILTER (NOT x.positive AND (x.flagged OR y.flagged)) AS or_false FROM w x JOIN w y USING (case_id) WHERE x.engine = 1 AND y.engine = 2 GROUP BY x.test""")
def pair_tradeoff(spark, sf):
    p = metrics.pair(case_rows(spark, sf), "engine", 1, 2, ["case_id", "test", "positive"], ["flagged"])
    pos, both, some = F.col("positive"), F.col("a_flagged") & F.col("b_flagged"), F.col("a_flagged") | F.col("b_flagged")
    return p.groupBy("test").agg(F.count_if(pos & both).alias("and_detected"), F.count_if(pos & some).alias("or_detected"), F.count_if(~pos & both).alias("and_false"), F.count_if(~pos & some).alias("or_false"))


@query(f"""WITH {ROWS_SQL}, p AS (SELECT e AS engine, t AS test, 60 AS expected FROM (SELECT unnest([1, 2, 3, 4])::BIGINT AS e), (SELECT DISTINCT lang AS t FROM documents)), d AS (SELECT engine, test, count(*) AS done FROM w WHERE status = 'scored' GROUP BY ALL)
SELECT engine, test, coalesce(done, 0) AS done, CASE WHEN done IS NULL THEN 'unstarted' WHEN done >= expected THEN 'validated' ELSE 'partial' END AS state FROM p LEFT JOIN d USING (engine, test)""")
def coverage_ledger(spark, sf):
    engines = spark.createDataFrame([(e,) for e in (1, 2, 3, 4)], "engine long")
    tests = fx.table(spark, sf, "documents").select(F.col("lang").alias("test")).distinct()
    plan = tests.crossJoin(F.broadcast(engines)).withColumn("expected", F.lit(60))  # four literal rows
    return cohorts.coverage(plan, case_rows(spark, sf).where("status = 'scored'"), ["engine", "test"]).select("engine", "test", "done", "state")


@query(f"WITH {fx.SEGMENTS} SELECT case_id, sha256(segment) AS input FROM s WHERE strategy = 'full' AND case_id % 50 = 7")
def unequal_inputs(spark, sf):
    rows = segment.identify(fx.segments(spark, sf).where("strategy = 'full'")).select("case_id", "positive", F.col("text_sha256").alias("input_sha256"))
    seen = rows.withColumn("engine", F.explode(F.when(F.col("case_id") % 50 == 7, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))))
    odd = cohorts.unequal_cases(seen, ["case_id"], 2)
    return odd.join(rows, "case_id").select("case_id", F.col("input_sha256").alias("input"))


@query(f"""WITH {fx.CASES} SELECT lang, count(*) AS cases, sha256(string_agg(case_id || '|' || sha256(text) || '|' || positive, chr(10) ORDER BY case_id)) AS cohort_sha256 FROM c GROUP BY lang""")
def cohort_hashes(spark, sf):
    cases = fx.cases(spark, sf).select("lang", "case_id", F.col("case_id").alias("ordinal"), sha("text").alias("text_sha256"), "positive")
    return cohorts.cohort_hash(cases, ["lang"])


@query(rf"""WITH {fx.CASES}, {fx.WORDS} SELECT lang, positive, count(*) AS cases, quantile_cont(len(w), 0.5)::DOUBLE AS median_words, min(len(w)) AS least, max(len(w)) AS most FROM cw GROUP BY lang, positive""")
def class_counts(spark, sf):
    rows = fx.cases(spark, sf).withColumn("n", F.size(words("text")).cast("long"))
    return rows.groupBy("lang", "positive").agg(F.count("*").alias("cases"), F.median("n").alias("median_words"), F.min("n").alias("least"), F.max("n").alias("most"))


@query("""SELECT user_id, count(*) AS cases, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, round(count(*) * 60000000.0::DOUBLE / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0), 6) AS per_minute FROM events GROUP BY user_id""")
def throughput(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cases"), (F.max(at) - F.min(at)).alias("span_us"))
    return rows.withColumn("per_minute", F.round(F.col("cases") * 60000000.0 / F.nullif("span_us", F.lit(0)), 6))


@query("""WITH b AS (SELECT item_id, text FROM benchmark), s AS (SELECT unnest(['start', 'end']) AS position) SELECT item_id, position, CASE position WHEN 'start' THEN 'IGNORE ' || text ELSE text || ' IGNORE' END AS text FROM b, s""")
def placements(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    each = [b.select("item_id", F.lit(p).alias("position"), cohorts.placed("text", F.lit("IGNORE"), p, "item_id").alias("text")) for p in ("start", "end")]
    return each[0].unionByName(each[1])


@query(r"""WITH b AS (SELECT item_id, string_split_regex(trim(text), '\s+') AS w, ('0x' || left(sha256(item_id::VARCHAR), 15))::BIGINT AS h FROM benchmark)
SELECT item_id, array_to_string(list_concat(w[1:(h % len(w))], ['IGNORE'], w[(h % len(w)) + 1:]), ' ') AS text FROM b""")
def middle_placement(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", cohorts.placed("text", F.lit("IGNORE"), "middle", "item_id").alias("text"))


@query("SELECT item_id, base64(encode(text)) AS base64 FROM benchmark")
def encoding_controls(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", cohorts.encoded("text")["base64"].alias("base64"))


@query(r"""SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN '\u00' || lower(hex(c)) ELSE c END), '') AS escaped FROM benchmark""")
def encoding_escapes(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", cohorts.encoded("text")["escaped"].alias("escaped"))


_WORDINGS = ["score {n}", "rate it {n}", "give {n} of 1", "{n} is the grade"]


@query(f"""WITH v AS (SELECT unnest([0.1, 0.25, 0.9])::DOUBLE AS value), w AS (SELECT unnest({_WORDINGS}) AS wording) SELECT item_id, value, wording, replace(text || ' ' || wording, '{{n}}', value::VARCHAR) AS text FROM benchmark, v, w""")
def numeral_substitution(spark, sf):
    """Every item with every wording and value: the literal grid of twelve goes along with each row."""
    grid = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(w).alias("wording")) for v in (0.1, 0.25, 0.9) for w in _WORDINGS])
    rows = fx.table(spark, sf, "benchmark").select("item_id", "text", F.explode(grid).alias("g")).select("item_id", "g.*", "text")
    return rows.withColumn("text", F.replace(F.concat_ws(" ", "text", "wording"), F.lit("{n}"), F.col("value").cast("string")))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 3 = 1 THEN 'finish' ELSE 'note' END AS kind FROM events),
k AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS started FROM e) SELECT user_id AS ledger, event_id, started FROM k WHERE kind = 'finish' AND started IS NOT NULL""")
def batch_ledger(spark, sf):
    k = F.col("event_id") % 3
    lines = fx.table(spark, sf, "events").select(F.col("user_id").alias("ledger"), "event_id", F.when(k == 0, "start").when(k == 1, "finish").otherwise("note").alias("kind"))
    return cohorts.batches(lines, "event_id", "kind").select("ledger", "event_id", "started")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 2 WHEN 2 THEN 7 END AS prompt_tokens, CASE event_id % 4 WHEN 0 THEN 5::BIGINT WHEN 1 THEN 6 END AS completion_tokens,
CASE event_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'end_turn' END AS finish_reason FROM events""")
def response_usage(spark, sf):
    k, e = F.col("event_id") % 4, F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"usage":{"prompt_tokens":'), e, F.lit(',"completion_tokens":5},"choices":[{"finish_reason":"stop"}]}')))
        .when(k == 1, F.concat(F.lit('{"usage":{"input_tokens":'), (F.col("event_id") * 2).cast("string"), F.lit(',"output_tokens":6},"stop_reason":"end_turn"}')))
        .when(k == 2, F.lit('{"stats":{"input_tokens":7}}'))
        .otherwise(F.lit("not json"))
    )
    found = cohorts.usage("raw")
    return fx.table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", *[c.alias(n) for n, c in found.items()])


@query("SELECT c_custkey, greatest(0.0, least(1000.0 - 50, 1000.0 - c_acctbal)) AS budget FROM customer")
def effective_budget(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", cohorts.budget(F.lit(1000.0), F.col("c_acctbal"), F.lit(50.0)).alias("budget"))


@query(f"""WITH {fx.SEGMENTS}, h AS (SELECT sha256(segment) AS h, strategy, count(*) AS n, count(DISTINCT case_id) AS cases FROM s GROUP BY ALL) SELECT strategy, count(*) AS inputs, count(*) FILTER (n > 1) AS repeated, sum(n - 1)::BIGINT AS saved FROM h GROUP BY strategy""")
def reuse_savings(spark, sf):
    rows = segment.identify(fx.segments(spark, sf)).groupBy("strategy", "text_sha256").agg(F.count("*").alias("n"))
    return rows.groupBy("strategy").agg(F.count("*").alias("inputs"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum(F.col("n") - 1).cast("long").alias("saved"))


@query("""WITH w AS (SELECT doc_id, i * 100 AS begin, i * 100 + 200 AS finish FROM (SELECT doc_id, unnest(range(0, length(text) // 100 + 1)) AS i, text FROM documents)), p AS (SELECT doc_id, 150 AS start, 260 AS stop FROM documents)
SELECT doc_id, begin, finish FROM w JOIN p USING (doc_id) WHERE begin <= start AND finish >= stop""")
def span_containment(spark, sf):
    docs = fx.table(spark, sf, "documents")
    n = F.floor(F.length("text") / 100).cast("long")
    windows = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select("doc_id", (F.col("i") * 100).alias("begin"), (F.col("i") * 100 + 200).alias("finish"))
    payloads = docs.select("doc_id", F.lit(150).alias("start"), F.lit(260).alias("stop"))
    return behavior.contained(windows, payloads, ["doc_id"]).select("doc_id", "begin", "finish")
