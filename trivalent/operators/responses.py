"""Raw response bodies and checkpoint events as typed columns.

Bodies are JSON text, parsed once to a variant; a field is taken only if it has the type asked for. The fold turns the
events of a run's checkpoint into tables by one filter each; only errors meet another table, by an equi-join on their request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.functions.text import col, trimmed
from trivalent.operators.scoring import strict_json

#: The shapes of bodies in the order they are tried, with the keys that must all be there.
SHAPES = (
    ("lmstudio_envelope", ("lmStudio", "nativeResponse")),
    ("openai_chat", ("choices",)),
    ("jev_answers", ("answers",)),
    ("model_armor_assessment_native", ("filterMatchState", "nativeResponse")),
    ("model_armor_assessment", ("filterMatchState",)),
)
#: The fence that an answer may stand in.
FENCE = r"^```(?:json)?\s*([\s\S]*?)\s*```\z"
#: Kinds of errors that are kept as they are; all others count as the first.
ERROR_KINDS = (
    "provider_or_transport_error", "output_abstention", "length_abstention", "http_error", "research_dispatch_cap", "provenance_or_validation_failure",
    "sibling_failure_cancellation", "legacy_error",
)
#: Where chat bodies have their fields, with the type of each.
CHAT = {
    "native_id": ("$.id", "text"), "resolved_model": ("$.model", "text"), "finish_reason": ("$.choices[0].finish_reason", "text"), "native_finish_reason": ("$.choices[0].native_finish_reason", "text"),
    "prompt_tokens": ("$.usage.prompt_tokens", "whole"), "completion_tokens": ("$.usage.completion_tokens", "whole"), "reasoning_tokens": ("$.usage.completion_tokens_details.reasoning_tokens", "whole"),
    "cached_tokens": ("$.usage.prompt_tokens_details.cached_tokens", "whole"), "total_tokens": ("$.usage.total_tokens", "whole"), "cost_usd": ("$.usage.cost", "number"),
    "upstream_cost_usd": ("$.usage.cost_details.upstream_inference_cost", "number"), "ttft_s": ("$.stats.time_to_first_token", "number"), "tokens_per_second": ("$.stats.tokens_per_second", "number"),
    "generation_time_s": ("$.stats.generation_time", "number"), "stop_reason": ("$.stats.stop_reason", "text"), "model_format": ("$.model_info.format", "text"), "model_quant": ("$.model_info.quant", "text"),
}
#: The same for bodies of answers.
ANSWERS = {
    "native_id": ("$.id", "text"), "provider": ("$.provider", "text"), "resolved_model": ("$.model", "text"), "prompt_tokens": ("$.usage.input_tokens", "whole"),
    "completion_tokens": ("$.usage.output_tokens", "whole"), "cost_usd": ("$.usage.cost", "number"),
}


def field(body: Column, path: str, kind: str) -> Column:
    """The text, number or whole number (rounded) at a path of a variant, null if something else is there."""
    found = F.try_variant_get(body, path, "variant")
    type_ = F.schema_of_variant(found)
    if kind == "text":
        return F.when(type_ == "STRING", F.try_variant_get(body, path, "string"))
    number = F.when(type_.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(body, path, "double"))
    return number if kind == "number" else F.floor(number + 0.5)


def shape(body: Column | str) -> Column:
    """The first shape of SHAPES whose keys a variant has, null values included; `other` for anything else."""
    has = lambda key: F.try_variant_get(col(body), f"$.{key}", "variant").isNotNull()
    tests = [(name, [has(k) for k in keys]) for name, keys in SHAPES]
    return F.coalesce(*[F.when(F.array_min(F.array(*keys)), name) for name, keys in tests], F.lit("other"))


def summary(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Each response with the summary of its body: shape, model, finish, tokens, costs, speed, output, and what was wrong with it."""
    c = F.col
    rows = responses.withColumn("body", F.try_parse_json(raw)).withColumn("shape", shape("body"))
    chat = c("shape").isin("openai_chat", "lmstudio_envelope")
    rows = rows.withColumn("chat", F.when(c("shape") == "lmstudio_envelope", F.try_variant_get("body", "$.nativeResponse", "variant")).when(chat, c("body")))
    answers = c("shape") == "jev_answers"
    armor = c("shape").startswith("model_armor_assessment")
    names = dict.fromkeys([*CHAT, *ANSWERS])
    each = {n: F.coalesce(*[x for x in (field(c("chat"), *CHAT[n]) if n in CHAT else None, F.when(answers, field(c("body"), *ANSWERS[n])) if n in ANSWERS else None) if x is not None]) for n in names}
    each["provider"] = F.when(c("shape") == "lmstudio_envelope", "LM Studio").when(armor, "Google Cloud Model Armor").otherwise(F.coalesce(each["provider"], field(c("chat"), "$.provider", "text")))
    each["total_tokens"] = F.coalesce(each["total_tokens"], F.when(answers, each["prompt_tokens"] + each["completion_tokens"]))
    content = F.try_variant_get("chat", "$.choices[0].message.content", "variant")
    output = F.when(~F.is_variant_null(content), F.coalesce(field(c("chat"), "$.choices[0].message.content", "text"), F.to_json(content)))
    each["output_text"] = output
    each["reasoning_text"] = F.coalesce(*[field(c("chat"), f"$.choices[0].message.{k}", "text") for k in ("reasoning", "reasoning_content")])
    each["envelope_version"] = F.when(c("shape") == "lmstudio_envelope", F.coalesce(field(c("body"), "$.lmStudio.version", "text"), F.lit("lmstudio-provenance/v1")))
    each["client_http_wall_ms"] = F.when(c("shape") == "lmstudio_envelope", field(c("body"), "$.lmStudio.clientTiming.httpWallMs", "number"))
    each["filter_match_state"] = F.when(armor, field(c("body"), "$.filterMatchState", "text"))
    each["normalized_label"] = F.when(armor, field(c("body"), "$.label", "text"))
    rows = rows.withColumns(each).withColumn("output_chars", F.length("output_text")).withColumn("reasoning_chars", F.length("reasoning_text"))
    broken = F.when(c("output_text").isNull(), "no output text").when(trimmed("output_text") == "", "empty output").when(strict_json(F.regexp_replace(trimmed("output_text"), FENCE, "$1")).isNull(), "invalid JSON")
    return rows.withColumn("parse_error", F.when(c("shape") == "other", "unrecognized response shape").when(chat, broken)).drop("body", "chat")


def anomalous(has_error: Column) -> Column:
    """Whether the body of a summarised response is kept: after an error, of no known shape, or a chat that didn't stop by itself with valid output."""
    chat = F.col("shape").isin("openai_chat", "lmstudio_envelope")
    return has_error | (F.col("shape") == "other") | (chat & (~F.col("finish_reason").eqNullSafe(F.lit("stop")) | F.col("parse_error").isNotNull()))


def segment_index(segment_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(segment_id), r"/(\d+)\z", 1), F.lit("")).cast("long")


def fold(events: DataFrame) -> dict[str, DataFrame]:
    """The tables of checkpoints: requests, rate_limits, responses, observations, errors and runs, from events (run, line, body as JSON text).

    Events have type, at, requestId, caseId, segmentId, attempt, delayMs, raw, value and issue, as far as they need them. An
    error of a request whose answer was cut off by length is a length abstention, whatever kind it names.
    """
    c = F.col
    v = F.try_parse_json("body")
    texts = {"type": "type", "at": "at", "request_id": "requestId", "case_id": "caseId", "segment_id": "segmentId"}
    rows = events.select("run", "line", v.alias("v")).select("run", "line", "v", *[field(c("v"), f"$.{k}", "text").alias(n) for n, k in texts.items()])
    attempt = F.coalesce(F.nullif(field(c("v"), "$.attempt", "whole"), F.lit(0)), F.lit(1))
    inner = lambda path: F.to_json(F.try_variant_get("v", path, "variant"))
    dispatch = rows.where("type = 'dispatch'").select("run", "line", "at", "request_id", "case_id", segment_index("segment_id").alias("segment_index"), attempt.alias("attempt"))
    first = F.min_by(F.struct("case_id", "segment_index"), F.when(c("segment_index").isNotNull(), c("line")))
    requests = dispatch.groupBy("run", "request_id").agg(
        first.alias("first_"), F.greatest(F.lit(1), F.max("attempt")).alias("attempts"), F.min("at").alias("first_dispatch_at"), F.max("at").alias("last_dispatch_at"), F.count("segment_index").alias("placed_")
    )
    requests = requests.where("placed_ > 0").select("run", "request_id", "first_.*", "attempts", "first_dispatch_at", "last_dispatch_at")
    limits = rows.where("type = 'rateLimit'").select(
        "run", "line", "at", "request_id", attempt.alias("attempt"), F.greatest(F.lit(0), F.coalesce(field(c("v"), "$.delayMs", "whole"), F.lit(0))).alias("delay_ms"), F.left(field(c("v"), "$.raw", "text"), F.lit(4096)).alias("body")
    )
    errors = rows.where("type = 'error'").select(
        "run", "line", "at", "request_id", "case_id", segment_index("segment_id").alias("segment_index"), F.coalesce(field(c("v"), "$.issue.kind", "text"), F.lit(ERROR_KINDS[0])).alias("issue_kind")
    )
    answers = rows.where("type = 'response'").select("run", "line", "at", "request_id", "case_id", segment_index("segment_id").alias("segment_index"), inner("$.raw").alias("raw"))
    failed = errors.where("request_id IS NOT NULL").select("run", "request_id").distinct().withColumn("failed_", F.lit(True))
    responses = summary(answers).join(failed, ["run", "request_id"], "left")
    responses = responses.withColumn("anomalous", anomalous(F.coalesce("failed_", F.lit(False)))).drop("failed_")
    cut = summary(answers).where("finish_reason = 'length'").select("run", "request_id").distinct().withColumn("cut_", F.lit(True))
    kind = F.when(c("cut_"), "length_abstention").when(c("issue_kind").isin(*ERROR_KINDS), c("issue_kind")).otherwise(ERROR_KINDS[0])
    observed = rows.where("type IN ('observation', 'derived_observation')").select("run", "line", "at", inner("$.value").alias("value"), (c("type") == "derived_observation").alias("derived"))
    done = F.when(c("type") == "complete", field(c("v"), "$.observations", "whole"))
    runs = rows.where("type <> 'metadata'").groupBy("run").agg(
        F.count("*").alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.bool_or(c("type") == "complete").alias("has_complete"), F.max_by(done, F.when(done.isNotNull(), c("line"))).alias("complete_observations")
    )
    errors = errors.join(cut, ["run", "request_id"], "left").withColumn("outcome_kind", kind).drop("cut_")
    return {"requests": requests, "rate_limits": limits, "responses": responses, "observations": observed, "errors": errors, "runs": runs}


def request_costs(reports: DataFrame, run: str, request: str, cost: str, allowance: str) -> DataFrame:
    """One cost a request, the highest that any of its events reports; a request without one counts its allowance. By run."""
    each = reports.groupBy(run, request).agg(F.max(F.when(F.col(cost) >= 0, F.col(cost))).alias("cost_"), F.max(allowance).alias("allowance_"))
    priced = F.col("cost_").isNotNull()
    return each.groupBy(run).agg(
        F.count_if(priced).alias("priced_requests"), F.count_if(~priced).alias("unpriced_requests"), F.round(F.coalesce(F.sum("cost_"), F.lit(0.0)), 6).alias("reported_cost"),
        F.round(F.coalesce(F.sum(F.when(~priced, F.col("allowance_"))), F.lit(0.0)), 6).alias("unresolved_allowance"),
    )


#: Exact dollars: no sum or comparison of costs is rounded.
DOLLARS = "decimal(18,12)"


def run_spend(runs: DataFrame, requests: DataFrame, responses: DataFrame, observations: DataFrame, limits: DataFrame, ledger: DataFrame, allowance: str) -> DataFrame:
    """Work and spend of every run: requests and attempts, native responses with their exact cost and tokens, native and reused observations, rate limits, and the allowance that a ledger charged.

    runs: run. requests: request, run, attempts. responses: request, cost, prompt_tokens, completion_tokens, reasoning_tokens, finish_reason.
    observations: run, origin. limits: request. ledger: run, ledger, usd. Each side is summed up by run before it joins, so nothing is counted twice.
    """
    c = F.col
    of = requests.select("request", "run")
    asked = requests.groupBy("run").agg(F.count_distinct("request").alias("requests"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("dispatch_attempts"))
    said = responses.join(of, "request").groupBy("run").agg(
        F.count_distinct("request").alias("native_responses"), F.sum(c("cost").cast(DOLLARS)).alias("cost"), F.count("cost").alias("priced_responses"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.count_if(c("finish_reason") == "length").alias("length_limited"),
    )
    seen = observations.groupBy("run").agg(F.count_if(c("origin") == "native").alias("native_observations"), F.count_if(~c("origin").isin("native", "legacy_migrated")).alias("reused_observations"))
    limited = limits.join(of, "request").groupBy("run").agg(F.count("*").alias("rate_limits"))
    charged = ledger.where(c("ledger") == allowance).groupBy("run").agg(F.sum(c("usd").cast(DOLLARS)).alias("allowance"))
    rows = runs.select("run")
    for part in (asked, said, seen, limited, charged):
        rows = rows.join(part, "run", "left")
    zero = ("requests", "dispatch_attempts", "native_responses", "priced_responses", "length_limited", "native_observations", "reused_observations", "rate_limits")
    return rows.withColumns({n: F.coalesce(c(n), F.lit(0).cast("long")) for n in zero})
