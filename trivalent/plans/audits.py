"""Audits of checkpoints: every fault planted in the life of whole tables of events, found in a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.operators import audit
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query
from trivalent.streaming import audit as live_audit
from trivalent.streaming import events as streams

#: What an event of the table writes into its run's checkpoint, by its number mod 24: (place, type, what differs), beside a dispatch at 0, a response at 3 and an observation at 6.
#: None stands for one of the three that is missing.
_LIVES = {
    1: [(0, "dispatch", "case_id=x")], 2: [(1, "dispatch", "segment=zz")], 3: [(0, None, "")], 4: [(4, "response", "")], 5: [(3, None, "")], 6: [(7, "observation", "")], 7: [(6, "observation", "sha=y")],
    8: [(6, "observation", "config=k")], 9: [(2, "error", "request=e")], 10: [(2, "error", "issue=")], 11: [(5, "note", "")], 12: [(6, "observation", "score=7")],
    13: [(0, None, ""), (3, None, ""), (1, "response", ""), (2, "dispatch", "")], 14: [(0, None, ""), (3, None, ""), (6, "derived_observation", "source=none")], 15: [(8, "derived_observation", "again")],
    16: [(7, "dispatch", "again"), (8, "response", "again"), (9, "observation", "again")], 17: [(0, "dispatch", "segment=u"), (3, "response", "segment=u"), (6, "observation", "segment=u")],
    18: [(0, None, ""), (3, None, ""), (6, None, "")], 19: [(2, "rateLimit", "")],
}
#: What the audit must say of each: (place, fault, the protocol for which it holds or ''), written down from the rules.
_SAID = [
    (1, 0, "unplanned_dispatch", ""), (1, 3, "response_unmatched", ""), (2, 1, "request_reused", ""), (2, 1, "unplanned_dispatch", ""), (2, 1, "repeated_inference", "exact_input"), (3, 3, "response_unmatched", ""), (4, 4, "second_response", ""),
    (5, 6, "observation_unmatched", ""), (6, 7, "repeated_observation", ""), (6, 7, "request_scored_twice", ""), (7, 6, "other_input", ""), (8, 6, "other_configuration", ""), (9, 2, "failure_unmatched", ""),
    (10, 2, "provenance_failure", ""), (11, 5, "unsupported_event", ""), (12, 6, "invalid_score", ""), (13, 1, "response_unmatched", ""), (14, 6, "reuse_not_allowed", "live"), (14, 6, "reuse_before_source", "exact_input"),
    (15, 8, "reuse_not_allowed", "live"), (16, 7, "repeated_inference", "exact_input"), (17, 0, "unplanned_dispatch", ""), (17, 0, "repeated_inference", "exact_input"), (17, 6, "unplanned_observation", ""),
]
_FIELDS = {"request": "'r' || id", "segment": "'s' || id", "case_id": "'c' || id", "sha": "'t' || id", "config": "'g'", "score": "0.5D", "source": "string(null)", "issue": "string(null)"}


def _life(k: int) -> list[str]:
    """The events of a life as SQL structs."""
    found = {(0, "dispatch"): "", (3, "response"): "", (6, "observation"): ""}
    for place, kind, what in _LIVES.get(k, []):
        for at in [at for at in found if at[0] == place]:
            del found[at]
        if kind:
            found[place, kind] = what
    each = []
    for (place, kind), what in found.items():
        fields = dict(_FIELDS)
        if what == "again":  # the segment beside it of the same input
            fields |= {"request": "'q' || id", "segment": "'s' || id || 'b'", "source": "'s' || id"}
        elif what:
            name, value = what.split("=")
            fields[name] = "7D" if name == "score" else f"'{value}' || id"
        if kind == "error" and what == "issue=":
            fields["issue"] = f"'{audit.PROVENANCE_FAILURE}'"
        elif kind == "rateLimit":
            fields["issue"] = "'quota'"
        each.append(f"named_struct('at', (id + 1) * 10 + {place}, 'type', '{kind}', {', '.join(f"'{n}', {v}" for n, v in fields.items())})")
    return each


def _run(source):
    return source.select(F.col("event_id").cast("long").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("run"), F.col("user_id").alias("u"))


def _lives(source):
    """The events that the rows of the table write, a row each."""
    lives = F.expr("CASE id % 24 " + " ".join(f"WHEN {k} THEN array({', '.join(_life(k))})" if _life(k) else f"WHEN {k} THEN null" for k in range(24)) + " END")
    rows = _run(source).select("run", F.explode(lives).alias("e")).select("run", "e.*")
    return rows.select("run", "at", "type", "request", "segment", "case_id", "sha", "config", "score", "source", "issue", F.lit(None).cast("long").alias("n"))


def _plans(spark, sf):
    rows = _run(fx.table(spark, sf, "events"))
    segment = F.explode(F.when(F.col("id") % 24 == 17, F.array(F.lit("s"))).when((F.col("id") % 24).isin(15, 16), F.array(F.lit("s"), F.lit("b"))).otherwise(F.array(F.lit("s"))))
    named = rows.withColumn("which", segment).select(
        "run", F.concat(F.lit("s"), "id", F.when(F.col("which") == "b", "b").otherwise("")).alias("segment"), F.concat(F.lit("c"), "id").alias("case_id"), F.concat(F.lit("t"), "id").alias("sha"), (F.col("id") * 2 + F.when(F.col("which") == "b", 1).otherwise(0)).alias("ordinal")
    )
    runs = rows.groupBy("run", "u").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    return named, runs.select("run", "u", "least", "most", F.lit("g").alias("config"), F.when(F.col("u") % 2 == 0, "exact_input").otherwise("live").alias("protocol"))


def _frames(runs, planned):
    """Metadata at the beginning of most runs, and completions: at the end of a third, in the middle of a third."""
    totals = runs.join(planned.groupBy("run").agg(F.count("*").alias("n")), "run")
    empty = ["request", "segment", "case_id", "sha", "config", "score", "source", "issue"]
    frame = lambda rows, at, kind, n: rows.select("run", F.expr(at).cast("long").alias("at"), F.lit(kind).alias("type"), *[F.lit(None).cast("double" if c == "score" else "string").alias(c) for c in empty], F.expr(n).cast("long").alias("n"))
    return frame(totals.where("u % 11 <> 5"), "0", "metadata", "null").unionByName(frame(totals.where("u % 3 < 2"), "IF(u % 3 = 0, (most + 2) * 10, ((least + most) div 2 + 1) * 10 + 9)", "complete", "n"))


_SQL = f"""WITH e AS (SELECT event_id AS id, 'u' || user_id AS run, user_id AS u, event_id % 24 AS k FROM events),
r AS (SELECT run, u, CASE WHEN u % 2 = 0 THEN 'exact_input' ELSE 'live' END AS protocol, CASE u % 3 WHEN 0 THEN (max(id) + 2) * 10 WHEN 1 THEN ((min(id) + max(id)) // 2 + 1) * 10 + 9 END AS fin,
  sum(CASE WHEN k IN (15, 16) THEN 2 ELSE 1 END) AS planned FROM e GROUP BY run, u),
said AS (SELECT * FROM (VALUES {", ".join(f"({k}, {p}, '{f}', '{o}')" for k, p, f, o in _SAID)}) AS t(k, place, fault, only_)),
lives AS (SELECT * FROM (VALUES {", ".join(f"({k}, {e.split("'at', (id + 1) * 10 + ")[1].split(",")[0]})" for k in range(24) for e in _life(k))}) AS t(k, place)),
o AS (SELECT e.run, (id + 1) * 10 + place AS pos FROM e JOIN (VALUES {", ".join(f"({k}, {p})" for k in range(24) for p in ([] if k in (17, 18) else [6, 8] if k == 15 else [6, 9] if k == 16 else [6]))}) AS t(k, place) USING (k)),
d AS (SELECT run, count(*) FILTER (pos < fin) AS done FROM o JOIN r USING (run) GROUP BY run),
a AS (SELECT e.run, (id + 1) * 10 + place AS pos FROM e JOIN lives USING (k))
SELECT e.run, (id + 1) * 10 + place AS "at", fault FROM e JOIN said USING (k) JOIN r USING (run) WHERE only_ IN ('', protocol)
UNION ALL SELECT a.run, a.pos, 'after_completion' FROM a JOIN r USING (run) WHERE a.pos > fin
UNION ALL SELECT run, fin, 'incomplete_completion' FROM r LEFT JOIN d USING (run) WHERE fin IS NOT NULL AND coalesce(done, 0) <> planned
UNION ALL SELECT run, pos, 'no_metadata' FROM (SELECT run, min(pos) AS pos FROM (SELECT run, pos FROM a UNION ALL SELECT run, fin FROM r WHERE fin IS NOT NULL) GROUP BY run) JOIN r USING (run) WHERE u % 11 = 5"""


@query(_SQL)
def checkpoint_protocol(spark, sf):
    """A run for each user: all that its events write into its checkpoint, with each fault planted apart."""
    planned, runs = _plans(spark, sf)
    events = _lives(fx.table(spark, sf, "events")).unionByName(_frames(runs, planned))
    return audit.audit(events, planned, runs)


@query(_SQL)
def stream_checkpoint_protocol(spark, sf):
    """The same checkpoints, judged while they are read."""
    planned, runs = _plans(spark, sf)
    events = _lives(fx.table(spark, sf, "events")).unionByName(_frames(runs, planned))
    written = streams.stored(events.repartition("run"), "checkpoints")  # a run in one file, so in order however many files a batch has
    events = audit.with_plan(streams.read_table(spark, written), planned, runs)
    return streams.drain(live_audit.faults(events))
