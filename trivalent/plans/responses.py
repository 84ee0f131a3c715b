"""Queries over response bodies and checkpoint events; the bodies are made from the keys of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.operators import responses
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query

_BODIES = [
    '{"id":"r#","model":"m","provider":"p","choices":[{"finish_reason":"stop","message":{"content":"{\\"s\\": #}"}}],"usage":{"prompt_tokens":#,"completion_tokens":3,"total_tokens":8.5,"cost":0.25}}',
    '{"choices":[{"finish_reason":"length","message":{"content":"{\\"s\\": ","reasoning":"why"}}],"usage":{"prompt_tokens":"4"}}',
    '{"lmStudio":{"clientTiming":{"httpWallMs":12.5}},"nativeResponse":{"model":"n#","choices":[{"finish_reason":"stop","message":{"content":"```json\\n[#]\\n```"}}],"stats":{"tokens_per_second":9.5,"stop_reason":"eos"}}}',
    '{"id":"j#","answers":{"a":1},"provider":"q","usage":{"input_tokens":#,"output_tokens":2,"cost":0.5}}',
    '{"filterMatchState":"MATCH_FOUND","label":"bad","nativeResponse":null}',
    '{"filterMatchState":7}',
    '{"choices":[{"message":{"content":null}}]}',
    "[1, 2",
]
_SHAPE = ["openai_chat", "openai_chat", "lmstudio_envelope", "jev_answers", "model_armor_assessment_native", "model_armor_assessment", "openai_chat", "other"]
_BY = lambda values: "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"
_E = "event_id::VARCHAR"


def _raw():
    k, e = F.col("event_id") % 8, F.col("event_id").cast("string")
    return F.coalesce(*[F.when(k == i, F.replace(F.lit(b), F.lit("#"), e)) for i, b in enumerate(_BODIES)])


@query(f"""SELECT event_id, {_BY([repr(s) for s in _SHAPE])} AS shape, {_BY([f"'r' || {_E}", None, None, f"'j' || {_E}"])} AS native_id, {_BY(["'p'", None, "'LM Studio'", "'q'", "'Google Cloud Model Armor'", "'Google Cloud Model Armor'"])} AS provider,
{_BY(["'m'", None, f"'n' || {_E}"])} AS resolved_model, {_BY(["'stop'", "'length'", "'stop'"])} AS finish_reason, {_BY(["event_id", None, None, "event_id"])}::BIGINT AS prompt_tokens, {_BY(["3", None, None, "2"])}::BIGINT AS completion_tokens,
{_BY(["9", None, None, "event_id + 2"])}::BIGINT AS total_tokens, {_BY(["0.25", None, None, "0.5"])}::DOUBLE AS cost_usd, {_BY([None, None, "9.5"])}::DOUBLE AS tokens_per_second, {_BY([None, None, "12.5"])}::DOUBLE AS client_http_wall_ms,
{_BY([None, None, None, None, "'MATCH_FOUND'"])} AS filter_match_state, {_BY([f"7 + length({_E})", "6", f"14 + length({_E})"])}::INTEGER AS output_chars, {_BY([None, "3"])}::INTEGER AS reasoning_chars,
{_BY([None, "'invalid JSON'", None, None, None, None, "'no output text'", "'unrecognized response shape'"])} AS parse_error, event_id % 8 IN (1, 6, 7) AS anomalous FROM events""")
def response_summaries(spark, sf):
    found = responses.summary(fx.table(spark, sf, "events").select("event_id", _raw().alias("raw"))).withColumn("anomalous", responses.anomalous(F.lit(False)))
    return found.select(
        "event_id", "shape", "native_id", "provider", "resolved_model", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "cost_usd", "tokens_per_second", "client_http_wall_ms", "filter_match_state", "output_chars",
        "reasoning_chars", "parse_error", "anomalous",
    )


def _events(spark, sf):
    """A dispatch, a response and sometimes a rate limit and an error of each event, in the run of its user."""
    k, e = F.col("event_id"), F.col("event_id").cast("string")
    rows = fx.table(spark, sf, "events")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = lambda kind: text('{"type":"', kind, '","at":"t', F.lpad(e, 12, "0"), '","requestId":"q', e, '","caseId":"c', e, '"')
    place = text(',"segmentId":"c', e, "/", (k % 3).cast("string"), '"')
    finish = F.when(k % 5 == 0, "length").otherwise("stop")
    issue = F.element_at(F.array(*[F.lit(x) for x in ("http_error", "strange", "output_abstention")]), (k % 3 + 1).cast("int"))
    bodies = [
        (k >= 0, 0, text(head("dispatch"), place, ',"attempt":', (k % 4).cast("string"), "}")),
        (k % 2 == 0, 1, text(head("rateLimit"), ',"attempt":2,"delayMs":', (k % 100).cast("string"), ".5}")),
        (k % 7 != 1, 2, text(head("response"), place, ',"raw":{"choices":[{"finish_reason":"', finish, '","message":{"content":"1"}}]}}')),
        (k % 6 < 2, 3, text(head("error"), place, ',"issue":{"kind":"', issue, '"}}')),
        (k % 9 == 4, 4, text(head("complete"), ',"observations":', e, "}")),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct((k * 10 + i).alias("line"), body.alias("body"))) for when, i, body in bodies]))
    return rows.select(F.col("user_id").alias("run"), F.explode(found).alias("x")).select("run", "x.*")


@query("""WITH e AS (SELECT *, event_id % 5 = 0 AND event_id % 7 <> 1 AS cut FROM events), x AS (SELECT user_id AS run, event_id, CASE WHEN cut THEN 'length_abstention' ELSE CASE event_id % 3 WHEN 0 THEN 'http_error' WHEN 1 THEN 'provider_or_transport_error' ELSE 'output_abstention' END END AS kind FROM e WHERE event_id % 6 < 2)
SELECT run, kind AS outcome_kind, count(*) AS errors, min(event_id * 10 + 3) AS first_line FROM x GROUP BY ALL""")
def checkpoint_errors(spark, sf):
    return responses.fold(_events(spark, sf))["errors"].groupBy("run", "outcome_kind").agg(F.count("*").alias("errors"), F.min("line").alias("first_line"))


@query("""SELECT user_id AS run, 'q' || event_id AS request_id, 'c' || event_id AS case_id, event_id % 3 AS segment_index, greatest(1, event_id % 4) AS attempts, 't' || lpad(event_id::VARCHAR, 12, '0') AS first_dispatch_at FROM events""")
def checkpoint_requests(spark, sf):
    return responses.fold(_events(spark, sf))["requests"].drop("last_dispatch_at")


@query("""SELECT user_id AS run, count(*) AS responses, count(*) FILTER (event_id % 5 = 0 OR event_id % 6 < 2) AS anomalous FROM events WHERE event_id % 7 <> 1 GROUP BY 1""")
def checkpoint_responses(spark, sf):
    return responses.fold(_events(spark, sf))["responses"].groupBy("run").agg(F.count("*").alias("responses"), F.count_if("anomalous").alias("anomalous"))


@query("""SELECT user_id AS run, sum(1 + (event_id % 2 = 0)::INT + (event_id % 7 <> 1)::INT + (event_id % 6 < 2)::INT + (event_id % 9 = 4)::INT)::BIGINT AS events, bool_or(event_id % 9 = 4) AS has_complete,
max(event_id) FILTER (event_id % 9 = 4) AS complete_observations, 't' || lpad(min(event_id)::VARCHAR, 12, '0') AS first_at, 't' || lpad(max(event_id)::VARCHAR, 12, '0') AS last_at FROM events GROUP BY 1""")
def checkpoint_runs(spark, sf):
    return responses.fold(_events(spark, sf))["runs"]


@query("""SELECT user_id AS run, count(*) AS limits, sum(event_id % 100 + 1)::BIGINT AS delay_ms, min(2)::BIGINT AS attempt FROM events WHERE event_id % 2 = 0 GROUP BY 1""")
def checkpoint_rate_limits(spark, sf):
    return responses.fold(_events(spark, sf))["rate_limits"].groupBy("run").agg(F.count("*").alias("limits"), F.sum("delay_ms").alias("delay_ms"), F.min("attempt").alias("attempt"))


@query("""WITH r AS (SELECT user_id AS run, event_id // 3 AS request, CASE WHEN event_id % 4 <> 1 AND value >= 0 THEN value END AS cost, (event_id % 5)::DOUBLE AS allowance FROM events),
q AS (SELECT run, request, max(cost) AS cost, max(allowance) AS allowance FROM r GROUP BY ALL)
SELECT run, count(cost) AS priced_requests, count(*) - count(cost) AS unpriced_requests, round(coalesce(sum(cost), 0), 6) AS reported_cost, round(coalesce(sum(allowance) FILTER (cost IS NULL), 0), 6) AS unresolved_allowance FROM q GROUP BY run""")
def request_costs(spark, sf):
    k = F.col("event_id")
    rows = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.floor(k / 3).alias("request"), F.when(k % 4 != 1, F.col("value")).alias("cost"), (k % 5).cast("double").alias("allowance"))
    return responses.request_costs(rows, "run", "request", "cost", "allowance")
