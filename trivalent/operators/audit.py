"""The audit of checkpoints as an ordered protocol: every event is judged by what its run has said before it.

`audit` judges whole tables by windows over a run's requests, segments, sources and inputs, never over a run as such, so
a run of any length is spread over tasks. `streaming.audit` keeps the same knowledge as state and judges events as they
come. Both name the same faults; what a fault says of an event doesn't depend on other faults of it.

Events: run, at (the event's place in its run), type, request, segment, case_id, sha, config, score, source (the segment
that a reused observation is of), issue (an error's kind) and n (the observations that a completion claims).
Planned segments: run, segment, case_id, sha and ordinal. Runs: run, config and protocol, one of PROTOCOLS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a run may do: ask for everything itself, ask once for each input and reuse the answer, or only reuse.
PROTOCOLS = ("live", "exact_input", "derived")
#: Kinds of events, and the error that no checkpoint may hold: fixed values.
CALLS, OBSERVATIONS, FAILURES = ("dispatch", "response"), ("observation", "derived_observation"), ("error", "rateLimit")
PROVENANCE_FAILURE = "provenance_or_validation_failure"
EVENTS = "run string, at long, type string, request string, segment string, case_id string, sha string, config string, score double, source string, issue string, n long"
#: What an event's run and segment plan for it.
PLAN = {"planned_case": "string", "planned_sha": "string", "native": "boolean", "run_config": "string", "protocol": "string", "expected": "long"}


def with_plan(events: DataFrame, planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Events with the columns of PLAN; a stream of events joins planned tables that don't change. native: the first planned segment of its input."""
    first = F.row_number().over(Window.partitionBy("run", "sha").orderBy("ordinal")) == 1
    own = planned.withColumn("native", first).select("run", "segment", F.col("case_id").alias("planned_case"), F.col("sha").alias("planned_sha"), "native")
    totals = planned.groupBy("run").agg(F.count("*").alias("expected"))
    whole = runs.select("run", F.col("config").alias("run_config"), "protocol").join(totals, "run", "left")
    return events.join(own, ["run", "segment"], "left").join(whole, "run", "left")


def faults(e: dict[str, Column], known: dict[str, Column]) -> Column:
    """Faults of an event, given what was known before it: dispatch and response (segment, case_id) of its request, whether the request was scored, the segment observed, the source (sha, case_id), the input asked for."""
    c = lambda name: e[name]
    is_ = lambda *kinds: c("type").isin(*kinds)
    same = lambda known: F.coalesce((known["segment"] == c("segment")) & (known["case_id"] == c("case_id")), F.lit(False))
    planned = c("planned_case").isNotNull()
    reuses = c("protocol") == "exact_input"
    live, reused = is_("observation"), is_("derived_observation")
    none = lambda test: F.coalesce(test, F.lit(False))
    rules = {
        "unsupported_event": ~F.coalesce(is_("metadata", "complete", *CALLS, *OBSERVATIONS, *FAILURES), F.lit(False)),
        "call_not_allowed": is_(*CALLS, *FAILURES) & (c("protocol") == "derived"),
        "reuse_not_allowed": reused & (c("protocol") == "live"),
        "live_not_allowed": live & (c("protocol") == "derived"),
        "unplanned_dispatch": is_("dispatch") & (~planned | ~none(c("case_id") == c("planned_case"))),
        "request_reused": is_("dispatch") & known["dispatch"].isNotNull() & ~same(known["dispatch"]),
        "repeated_inference": is_("dispatch") & reuses & (~none(c("native")) | known["asked"]),
        "response_unmatched": is_("response") & ~same(known["dispatch"]),
        "second_response": is_("response") & known["response"].isNotNull(),
        "unplanned_observation": is_(*OBSERVATIONS) & ~planned,
        "repeated_observation": is_(*OBSERVATIONS) & known["observed"],
        "other_case": is_(*OBSERVATIONS) & planned & ~none(c("case_id") == c("planned_case")),
        "other_input": is_(*OBSERVATIONS) & planned & ~none(c("sha") == c("planned_sha")),
        "other_configuration": is_(*OBSERVATIONS) & ~none(c("config") == c("run_config")),
        "invalid_score": is_(*OBSERVATIONS) & ~none(c("score").between(0, 1)),
        "observation_unmatched": live & ~same(known["response"]),
        "request_scored_twice": live & known["scored"],
        "reuse_before_source": reused & reuses & ~none(known["origin"]["sha"] == c("sha")),
        "failure_unmatched": is_(*FAILURES) & ~same(known["dispatch"]),
        "provenance_failure": is_("error") & (c("issue") == PROVENANCE_FAILURE),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))


def audit(events: DataFrame, planned: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, at, fault) of every fault; clean checkpoints give none."""
    alone = lambda name, test: F.when(test & F.col(name).isNotNull(), F.col(name)).otherwise(F.concat(F.lit("\0"), F.col("at")))
    kind = F.col("type")
    observed, live = kind.isin(*OBSERVATIONS), kind == "observation"
    keys = {
        "request_": alone("request", F.lit(True)), "segment_": alone("segment", observed), "input_": alone("planned_sha", kind.isin("dispatch", "observation")),
        "origin_": F.when(kind == "derived_observation", alone("source", F.lit(True))).otherwise(alone("segment", live)),
    }
    rows = with_plan(events, planned, runs).withColumns(keys)
    before = lambda key: Window.partitionBy("run", key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda test, value, key: F.first(F.when(test, value), ignorenulls=True).over(before(key))
    any_ = lambda test, key: F.coalesce(F.bool_or(test).over(before(key)), F.lit(False))
    pair, origin = F.struct("segment", "case_id"), F.struct("sha", "case_id")
    rows = rows.withColumns({"dispatch": first(kind == "dispatch", pair, "request_"), "response": first(kind == "response", pair, "request_"), "scored": any_(live, "request_")})
    rows = rows.withColumn("observed", any_(observed, "segment_")).withColumn("origin", first(live, origin, "origin_")).withColumn("asked", any_(live, "input_"))
    known = {n: F.col(n) for n in ("dispatch", "response", "scored", "observed", "origin", "asked")}
    counted = observed & F.col("planned_case").isNotNull() & ~F.col("observed")
    judged = rows.select("run", "at", "type", "n", "expected", counted.alias("counted"), faults({c: F.col(c) for c in rows.columns}, known).alias("faults"))
    ends = judged.groupBy("run").agg(F.min(F.when(kind == "complete", F.col("at"))).alias("end"), F.min_by("type", "at").alias("opens"), F.min("at").alias("opened"))
    placed = judged.join(ends, "run")
    done = placed.groupBy("run").agg(F.count_if(F.col("counted") & (F.col("at") < F.col("end"))).alias("done"))
    placed = placed.join(done, "run")
    more = F.array_compact(F.array(
        F.when((F.col("at") == F.col("opened")) & ~F.col("opens").eqNullSafe(F.lit("metadata")), "no_metadata"),
        F.when((F.col("at") > F.col("end")) & ~kind.eqNullSafe(F.lit("complete")), "after_completion"),
        F.when((kind == "complete") & ~((F.col("n") == F.col("expected")) & (F.col("done") == F.col("expected"))).eqNullSafe(F.lit(True)), "incomplete_completion"),
    ))
    return placed.select("run", "at", F.explode(F.concat("faults", more)).alias("fault"))
