"""Queries over rows that vary with the table: bodies, arguments, facets and runs are built from each row's own values, and what must come out is worked out from the values, not from the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivalent.functions.text import date_of, iso_time, lcg, seed_for, sha
from trivalent.operators import assembly, behavior, metrics, responses, scoring, segment, verdict
from trivalent.plans import fixtures as fx
from trivalent.plans.registry import query
from trivalent.sources import files, lines
from trivalent.streaming import events as streams

_F = F.col

# ---- Managed filters

_NAMES = ["rai", "sdp", "pi_and_jailbreak", "malicious_uris", "csam"]
_RESULT = {"rai": "raiFilterResult", "sdp": "sdpFilterResult", "pi_and_jailbreak": "piAndJailbreakFilterResult", "malicious_uris": "maliciousUriFilterResult", "csam": "csamFilterFilterResult"}


def _filter_there(i):
    return f"((event_id // {2**i}) % 4 <> {i % 4})"


def _filter_match(i):
    return f"((event_id * {i + 3} + user_id) % 5 = 0)"


def _filter_odd(i):
    """0 is sound, 1 did not run, 2 says nothing that is a verdict."""
    return f"(CASE WHEN (event_id + {i}) % 53 = 0 THEN 1 WHEN (event_id + {i}) % 59 = 0 THEN 2 ELSE 0 END)"


_SPARK = lambda sql: sql.replace("//", "div")


@query(f"""WITH f AS (SELECT event_id, list_filter([{", ".join(f"CASE WHEN {_filter_there(i)} THEN {{'n': '{n}', 'm': {_filter_match(i)}, 'o': {_filter_odd(i)}}} END" for i, n in enumerate(_NAMES))}], lambda x: x IS NOT NULL) AS fs,
  event_id % 41 AS call, event_id % 37 AS whole FROM events),
g AS (SELECT *, list_sort(list_transform(list_filter(fs, lambda x: x.m), lambda x: x.n)) AS hits, call = 3 OR call = 4 OR whole = 5 OR len(fs) = 0 OR len(list_filter(fs, lambda x: x.o > 0)) > 0 OR len(list_filter(fs, lambda x: x.n = 'pi_and_jailbreak')) = 0 AS bad FROM f),
h AS (SELECT *, list_contains(hits, 'pi_and_jailbreak') AS inj, len(hits) > 0 OR whole = 7 AS blk FROM g)
SELECT event_id, bad AS inconclusive, CASE WHEN NOT bad THEN inj END AS flagged, CASE WHEN NOT bad THEN blk END AS blocked, CASE WHEN NOT bad THEN CASE WHEN inj THEN 'MALICIOUS' WHEN blk THEN 'CONTENT_BLOCKED' ELSE 'BENIGN' END END AS label,
 CASE WHEN NOT bad THEN CASE WHEN blk AND len(hits) = 0 THEN 'unknown' ELSE array_to_string(hits, ',') END END AS matched, CASE WHEN NOT bad THEN 'C' || event_id % 3 END AS confidence FROM h""")
def managed_verdicts(spark, sf):
    """Answers of managed filters, nested as the service nests them; any that is not whole is inconclusive."""
    entries = []
    for i, n in enumerate(_NAMES):
        match = f"CASE WHEN {_filter_odd(i)} = 2 THEN 'MATCH_STATE_UNSPECIFIED' WHEN {_filter_match(i)} THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END"
        state = f"CASE WHEN {_filter_odd(i)} = 1 THEN 'EXECUTION_SKIPPED' ELSE 'EXECUTION_SUCCESS' END"
        inner = f"""'{{"executionState":"' || {state} || '","matchState":"' || {match} || '","confidenceLevel":"C' || event_id % 3 || '"}}'"""
        payload = f"""'{{"{_RESULT[n]}":{{"inspectResult":' || {inner} || '}}}}'""" if n == "sdp" else f"""'{{"{_RESULT[n]}":' || {inner} || '}}'"""
        entries.append(f"""CASE WHEN {_filter_there(i)} THEN '"{n}":' || {payload} END""")
    listed = f"array_join(array({', '.join(entries)}), ',')"
    hits = " OR ".join(f"({_filter_there(i)} AND {_filter_match(i)})" for i in range(len(_NAMES)))
    whole = f"""CASE WHEN event_id % 37 = 5 THEN 'ODD' WHEN event_id % 37 = 7 OR {hits} THEN 'MATCH_FOUND' ELSE 'NO_MATCH_FOUND' END"""
    called = """CASE WHEN event_id % 41 = 3 THEN '"invocationResult":"PARTIAL",' WHEN event_id % 41 = 4 THEN '' ELSE '"invocationResult":"SUCCESS",' END"""
    body = f"""'{{"sanitizationResult":{{' || {called} || '"filterMatchState":"' || {whole} || '","filterResults":{{' || {listed} || '}}}}}}'"""
    rows = fx.table(spark, sf, "events").select("event_id", F.expr(_SPARK(body)).alias("body"))
    found = assembly.managed_answer("body")
    return rows.select("event_id", *[found[c].alias(c) for c in ("inconclusive", "flagged", "blocked", "label")], F.array_join(found["matched"], ",").alias("matched"), found["confidence"].alias("confidence"))


# ---- Actions


@query("""WITH a AS (SELECT event_id, event_type AS tool, event_id % 7 = 3 AS blank, event_id % 3 AS k, user_id % 4 AS s FROM events),
b AS (SELECT *, CASE WHEN blank THEN NULL ELSE tool END AS t, NOT blank AND tool = 'purchase' AS p, NOT blank AND tool = 'click' AS c FROM a),
r AS (SELECT *, list_filter([CASE WHEN t IS NULL OR t NOT IN ('purchase', 'click', 'view') THEN 'tool_not_allowed' END, CASE WHEN (p OR c) AND s = 0 THEN 'missing_provenance' END,
 CASE WHEN p AND k <> 1 AND s = 3 THEN 'unknown_source' END, CASE WHEN (p OR c) AND s = 1 OR p AND k <> 1 AND s = 3 THEN 'external_controls_protected_argument' END], lambda x: x IS NOT NULL) AS rs,
 list_filter([CASE WHEN (p OR c) AND s <> 2 AND NOT (c AND s = 3) THEN '/to/0=' || CASE s WHEN 0 THEN '' WHEN 1 THEN 'op+ext' ELSE 'ext+who' END END, CASE WHEN p AND k <> 1 AND s <> 2 THEN '/a~1b=' || CASE s WHEN 0 THEN '' WHEN 1 THEN 'op+ext' ELSE 'ext+who' END END], lambda x: x IS NOT NULL) AS es FROM b),
q AS (SELECT *, CASE WHEN p AND k = 1 AND s = 3 THEN list_concat(rs, ['unknown_source', 'external_controls_protected_argument']) ELSE rs END AS r2 FROM r)
SELECT event_id AS action_id, len(r2) > 0 AS flagged, array_to_string(list_sort(list_distinct(r2)), ',') AS reasons, array_to_string(es, ';') AS evidence FROM q""")
def action_evidence(spark, sf):
    """Arguments with and without the protected ones, sources by their pointer, tools that are missing."""
    c = _F
    k, s = c("event_id") % 3, c("user_id") % 4
    tool = F.when(c("event_id") % 7 != 3, c("event_type"))
    second = F.when(k == 1, "").otherwise(F.concat(F.lit(',"a/b":{"c":'), c("event_id"), F.lit("}")))
    arguments = F.concat(F.lit('{"to":["user'), c("user_id"), F.lit('","x"],"note":"free"'), second, F.lit("}"))
    given = F.when(s == 1, F.array(F.lit("op"), F.lit("ext"))).when(s == 2, F.array(F.lit("op"))).when(s == 3, F.array(F.lit("ext"), F.lit("who")))
    first = F.when((c("event_type") == "click") & (s == 3), F.array(F.lit("op"))).otherwise(given)
    sources = F.map_filter(F.create_map(F.lit("/to/0"), first, F.lit("/a~1b"), given), lambda _, v: v.isNotNull())
    actions = fx.table(spark, sf, "events").select(c("event_id").alias("action_id"), tool.alias("tool"), arguments.alias("arguments"), sources.alias("sources"))
    origins = spark.createDataFrame([("ext", "external"), ("op", "operator")], "source_id string, origin string")
    found = behavior.assess_actions(actions, origins, ["purchase", "click", "view"], {"purchase": ["/to/0", "/a~1b"], "click": ["/to/0", "/none"]})
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat(e["path"], F.lit("="), F.array_join(e["sources"], "+"))), ";")
    return found.select("action_id", "flagged", F.array_join("reasons", ",").alias("reasons"), evidence.alias("evidence"))


# ---- Answers


@query("""WITH d AS (SELECT doc_id, doc_id % 23 AS n, doc_id % 9 AS form, doc_id % 6 AS stop, doc_id % 31 = 4 AS tools, n_chars % 4 AS q FROM documents),
e AS (SELECT *, CASE WHEN form IN (0, 1, 2, 3, 4) THEN n / 10.0::DOUBLE END AS number, form IN (0, 1, 2) AS only_score FROM d),
c AS (SELECT *, CASE WHEN only_score AND number <= 1 AND stop <> 5 AND NOT tools THEN NULL WHEN form = 5 THEN 'empty_final' WHEN number > 1 THEN 'out_of_range_numeric' WHEN only_score THEN 'valid_shape_nonstop' ELSE 'malformed_or_other_schema' END AS category FROM e)
SELECT doc_id, category, number, coalesce(category = 'out_of_range_numeric' AND stop <> 5 AND q = 1 AND n IN (12, 20), false) AS target_match FROM c""")
def final_anomalies(spark, sf):
    """Answers of nine forms around each document's number, scanned for what is wrong with them."""
    c = _F
    n = (c("doc_id") % 23 / 10.0).cast("decimal(3,1)").cast("string")
    form = c("doc_id") % 9
    one = F.concat(F.lit('{"concernScore": '), n, F.lit("}"))
    forms = [one, F.concat(F.lit(" \n"), one, F.lit("\n")), one, F.concat(F.lit('{"concernScore":'), n, F.lit(',"why":"'), c("lang"), F.lit('"}')), F.concat(F.lit('{"why":null,"concernScore":'), n, F.lit("}")), F.lit(""), F.concat(F.lit("score "), n), F.concat(F.lit('{"concernScore":"'), n, F.lit('"}')), F.concat(F.lit("["), n, F.lit("]"))]
    content = F.element_at(F.array(*forms), (form + 1).cast("int"))
    asked = F.when(c("n_chars") % 4 == 1, F.array(F.lit(1.2), F.lit(2.0)))
    rows = fx.table(spark, sf, "documents").select("doc_id", content.alias("content"), F.when(c("doc_id") % 6 == 5, "length").otherwise("stop").alias("finish"), (c("doc_id") % 31 == 4).alias("tools"), asked.alias("targets"))
    return rows.select("doc_id", *[v.alias(k) for k, v in scoring.final_anomaly("content", "finish", "tools", "targets").items()])


@query("""WITH d AS (SELECT doc_id, doc_id % 19 AS n, doc_id % 29 AS b, doc_id % 5 AS f, doc_id % 7 AS t FROM documents),
k AS (SELECT *, CASE WHEN b = 1 THEN 'choices' WHEN b IN (2, 3, 4) THEN 'model_or_id' WHEN b = 5 THEN 'choice' WHEN f = 3 OR b = 6 THEN 'finish_reason' WHEN b = 7 AND f <> 4 THEN 'message' END AS broken FROM d),
c AS (SELECT *, CASE WHEN broken IS NOT NULL THEN 'provenance' WHEN f = 4 THEN 'length' WHEN t < 4 AND n <= 10 THEN 'scored' ELSE 'output' END AS kind FROM k)
SELECT doc_id, kind, CASE kind WHEN 'provenance' THEN broken WHEN 'output' THEN CASE WHEN t = 4 THEN 'empty_content' WHEN t = 5 THEN 'invalid_json' ELSE 'invalid_score' END END AS reason, CASE WHEN kind = 'scored' THEN n / 10.0::DOUBLE END AS score FROM c""")
def answer_kinds(spark, sf):
    """Whole bodies of chat answers, some not the model's, some cut, some unusable."""
    c = _F
    n, b, f, t = (c("doc_id") % k for k in (19, 29, 5, 7))
    number = (n / 10.0).cast("decimal(3,1)").cast("string")
    content = F.when(t < 4, F.concat(F.lit('{\\"concernScore\\":'), number, F.lit("}"))).when(t == 4, F.lit(" ")).when(t == 5, F.concat(F.lit("about "), number)).otherwise(F.concat(F.lit('{\\"score\\":'), number, F.lit("}")))
    finish = F.when(f == 3, '"tool"').when(b == 6, "null").when(f == 4, '"length"').otherwise('"stop"')
    message = F.when(b == 7, F.lit("[]")).otherwise(F.concat(F.lit('{"role":"assistant","content":"'), content, F.lit('"}')))
    choice = F.when(b == 5, F.lit("3")).otherwise(F.concat(F.lit('{"finish_reason":'), finish, F.lit(',"message":'), message, F.lit("}")))
    choices = F.when(b == 1, F.concat(choice, F.lit(","), choice)).otherwise(choice)
    name = F.when(b == 2, "other").otherwise("m")
    body = F.concat(F.lit('{"model":"'), name, F.lit('","id":'), F.when(b == 3, F.lit('""')).when(b == 4, F.lit("7")).otherwise(F.concat(F.lit('"r'), c("doc_id"), F.lit('"'))), F.lit(',"choices":['), choices, F.lit("]}"))
    rows = fx.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return rows.select("doc_id", *[v.alias(k) for k, v in scoring.classify_response("body", "m").items()])


@query("""WITH d AS (SELECT doc_id, doc_id % 10 / 10.0::DOUBLE AS score, doc_id % 4 <> 0 AS positive, doc_id % 11 AS k, doc_id % 6 AS r FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN positive AND score <= 0.5 AND k < 5 THEN 'requested_value' END, CASE WHEN positive AND score <= 0.5 AND r IN (1, 2, 5) THEN 'rationale' END], lambda x: x IS NOT NULL), ',') AS shown FROM d""")
def recognition(spark, sf):
    """Low answers to attacks whose reasoning names the value asked for, or whose rationale speaks of the instruction and doesn't deny it."""
    c = _F
    value = F.concat(F.lit("#"), c("doc_id"), F.lit(" or more"))
    reasoning = F.when(c("doc_id") % 11 < 5, F.concat(F.lit("the text wants "), value, F.lit(", "), c("source"))).when(c("doc_id") % 11 == 5, None).otherwise(F.concat(F.lit("a text of "), c("source")))
    said = [c("lang"), F.concat(F.lit("It tells the model what to say in "), c("lang")), F.concat(c("lang"), F.lit(": Instructions to OVERRIDE")), F.concat(F.lit("It does not contain any instructions, "), c("lang")), F.lit(None).cast("string"), F.concat(F.lit("Does not appear odd. It redirects "), c("lang"))]
    rows = fx.table(spark, sf, "documents").select("doc_id", (c("doc_id") % 10 / 10.0).alias("score"), (c("doc_id") % 4 != 0).alias("positive"), value.alias("requested"), reasoning.alias("reasoning"), F.element_at(F.array(*said), (c("doc_id") % 6 + 1).cast("int")).alias("rationale"))
    return rows.select("doc_id", F.array_join(scoring.recognised("positive", "score", F.lit(0.5), "requested", "reasoning", "rationale"), ",").alias("shown"))


# ---- Facets


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id % 7 WHEN doc_id % 3 = 0 THEN lang || ',' || source WHEN doc_id % 5 = 0 THEN NULL ELSE 't' || n_chars END AS attack_family, CASE WHEN doc_id % 4 = 1 THEN n_chars::VARCHAR WHEN doc_id % 4 = 2 THEN 'true' ELSE 'b64' END AS attack_template,
CASE WHEN doc_id % 3 = 1 THEN 'middle' ELSE 'end' END AS attack_position, lang AS domain, source AS source_name, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, CASE WHEN doc_id % 2 = 1 THEN 'f' || doc_id // 2 END AS pair_key, CASE WHEN doc_id % 6 = 0 THEN (doc_id // 6)::VARCHAR WHEN doc_id % 6 = 1 THEN '' END AS parent_case_id FROM documents""")
def facet_projections(spark, sf):
    """All eight projections of facets in JSON: texts, numbers, lists, nulls and missing keys."""
    c = _F
    d = c("doc_id")
    part = lambda test, key, value: F.when(test, F.concat(F.lit(f'"{key}":'), value))
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    parts = [
        part(d % 2 == 0, "attack", quoted(F.concat(F.lit("a"), d % 7))), part((d % 2 == 1), "attack_family", F.lit("null")), part((d % 2 == 1) & (d % 3 == 0), "attack_type", F.concat(F.lit("["), quoted(c("lang")), F.lit(","), quoted(c("source")), F.lit("]"))),
        part((d % 5 != 0) | (d % 3 == 0), "technique", quoted(F.concat(F.lit("t"), c("n_chars")))), part(d % 4 == 1, "goal", c("n_chars").cast("string")), part(d % 4 == 2, "obfuscation", F.lit("true")), part(d % 4 != 2, "encoding", F.lit('"b64"')),
        part(d % 3 == 1, "position", F.lit('"middle"')), part(F.lit(True), "insertion_position", F.lit('"end"')), part(F.lit(True), "task", quoted(c("lang"))), part(F.lit(True), "source", quoted(c("source"))),
        part(F.lit(True), "split", F.when(d % 10 < 8, F.lit('"train"')).otherwise(F.lit('"test"'))), part(d % 2 == 1, "document_family", quoted(F.concat(F.lit("f"), F.expr("doc_id div 2")))), part(d % 6 == 0, "parent_case", F.expr("string(doc_id div 6)")), part(d % 6 == 1, "parent_default_case", F.lit("[]")),
    ]
    rows = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")).alias("facets"))
    return rows.select("doc_id", *[v.alias(k) for k, v in behavior.project_facets_json("facets").items()])


@query("""WITH d AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 13 / 4.0::DOUBLE AS h, doc_id % 3 AS a FROM documents), e AS (SELECT *, k NOT IN (3, 4) AS ok FROM d)
SELECT doc_id, CASE WHEN ok THEN CASE WHEN a = 1 THEN 'control' ELSE 'attack' END END AS pair_kind, CASE WHEN ok THEN CASE WHEN h > 1 THEN 'out_of_range' WHEN h >= 0.5 THEN 'high' ELSE 'low' END END AS arm, CASE WHEN ok THEN h / 2 END AS target_low, CASE WHEN ok THEN h END AS target_high FROM e""")
def counterfactual_pairs(spark, sf):
    c = _F
    high = c("doc_id") % 13 / 4.0
    low = F.when(c("doc_id") % 5 == 3, "many").when(c("doc_id") % 5 == 4, None).otherwise((high / 2).cast("string"))
    attack = F.when(c("doc_id") % 3 == 1, "numeric_fact").when(c("doc_id") % 3 == 2, "naive")
    rows = fx.table(spark, sf, "documents").select("doc_id", attack.alias("attack"), low.alias("low"), high.cast("string").alias("high"))
    return rows.select("doc_id", *[v.alias(k) for k, v in behavior.counterfactual_pair("attack", "low", "high").items()])


# ---- Ensembles, repeats and parents

_SIX = {"a": (7, 5), "b": (11, 4), "c": (13, 6), "l": (17, 3), "m": (19, 5), "h": (23, 7)}
_SHARE = {k: f"((case_id * {p} + length(text)) % 12 < {t})" for k, (p, t) in _SIX.items()}
_KNOWN = {k: f"((case_id + {p}) % 31 <> 0)" for k, (p, _) in _SIX.items()}
#: The seventeen recipes, written out.
_SEVENTEEN = {
    "a-or-b": "a|b", "a-and-b": "a&b", "a-or-c": "a|c", "a-and-c": "a&c", "b-or-l": "b|l", "b-and-l": "b&l", "b-or-m": "b|m", "b-and-m": "b&m", "b-or-h": "b|h", "b-and-h": "b&h",
    "c-or-l": "c|l", "c-and-l": "c&l", "c-or-m": "c|m", "c-and-m": "c&m", "c-or-h": "c|h", "c-and-h": "c&h", "a-b-c-2-of-3": "(a+b+c>=2)::INT",
}


def _ensemble_sql(name, rule):
    members = [x for x in name.split("-") if x in _SIX]
    votes, x = " + ".join(members), members[0]
    y = members[1]
    count = lambda test: f"count(*) FILTER ({test})"
    pair = f"{count(f'{{p}} AND {x} = 1 AND {y} = 1')} || '/' || {count(f'{{p}} AND {x} = 1 AND {y} = 0')} || '/' || {count(f'{{p}} AND {x} = 0 AND {y} = 1')} || '/' || {count(f'{{p}} AND {x} = 0 AND {y} = 0')}" if len(members) == 2 else "NULL"
    voted = " || ',' || ".join(count(f"{{p}} AND {votes} = {v}") for v in range(len(members) + 1))
    added = " || ',' || ".join(f"({count(f'{{p}} AND ({rule}) = 1')} - {count(f'{{p}} AND {m} = 1')})" for m in members)
    side = lambda text, p: text.replace("{p}", p)
    return f"""SELECT '{name}' AS recipe, {count(f"positive AND ({rule}) = 1")} AS tp, {count(f"positive AND ({rule}) = 0")} AS fn, {count(f"NOT positive AND ({rule}) = 1")} AS fp, {count(f"NOT positive AND ({rule}) = 0")} AS tn, {side(voted, "positive")} AS votes_positive, {side(voted, "NOT positive")} AS votes_benign,
 {side(pair, "positive")} AS overlap_positive, {side(pair, "NOT positive")} AS overlap_benign, {side(added, "positive")} AS added_attacks, {side(added, "NOT positive")} AS added_alarms FROM f WHERE {votes} IS NOT NULL"""


@query(f"WITH {fx.CASES}, f AS (SELECT case_id, positive, {', '.join(f'CASE WHEN {_KNOWN[k]} THEN {_SHARE[k]}::INT END AS {k}' for k in _SIX)} FROM c) " + " UNION ALL ".join(_ensemble_sql(n, r) for n, r in _SEVENTEEN.items()))
def ensemble_recipes_17(spark, sf):
    """An anchor, two small detectors and three templates of a filter, by seventeen recipes."""
    each = F.array(*[F.struct(F.lit(k).alias("engine"), F.when(F.expr(_KNOWN[k]), F.expr(_SHARE[k])).alias("flagged")) for k in _SIX])
    flags = fx.cases(spark, sf).select("case_id", "positive", F.inline(each))
    found = assembly.ensembles(flags, ["case_id"], "engine", assembly.pair_recipes("a", ["b", "c"], ["l", "m", "h"]))
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
    overlap = lambda name: F.when(F.col(name).isNotNull(), F.concat_ws("/", *[F.col(f"{name}.{x}").cast("string") for x in ("both", "a_only", "b_only", "neither")])).alias(name)
    return found.select("recipe", "tp", "fn", "fp", "tn", joined("votes_positive"), joined("votes_benign"), overlap("overlap_positive"), overlap("overlap_benign"), joined("added_attacks"), joined("added_alarms"))


@query(f"""WITH {fx.CASES}, o AS (SELECT e AS engine, case_id, positive, (length(text) * e + case_id) % 7 < 3 AS flagged FROM c, (VALUES (1), (2)) AS t(e)),
x AS (SELECT engine, lang || '/' || CASE WHEN case_id % 4 = 1 THEN 'base64' WHEN case_id % 4 = 2 THEN 'escapes' ELSE 'benign' END AS grp, flagged AS a, (length(text) * 3 + engine) % 5 < 3 AS b FROM o JOIN c USING (case_id) WHERE case_id % 4 <> 0)
SELECT engine, grp AS "group", count(*) AS total, count(*) FILTER (a) AS n_original, count(*) FILTER (b) AS n_transformed, count(*) FILTER (NOT a AND b) AS n_gained, count(*) FILTER (a AND NOT b) AS n_lost FROM x GROUP BY ALL""")
def parent_gains(spark, sf):
    """Transformed cases against the parents that they name, what each engine gains and loses."""
    cases = fx.cases(spark, sf).withColumn("engine", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("n", F.length("text"))
    original = cases.select("engine", "case_id", "positive", ((_F("n") * _F("engine") + _F("case_id")) % 7 < 3).alias("flagged"))
    kind = F.when(_F("case_id") % 4 == 1, "base64").when(_F("case_id") % 4 == 2, "escapes").otherwise("benign")
    changed = cases.where("case_id % 4 <> 0").select("engine", F.concat(F.lit("decoded/"), "case_id").alias("case_id"), _F("case_id").alias("parent_case"), "positive", F.concat("lang", F.lit("/"), kind).alias("group"), ((_F("n") * 3 + _F("engine")) % 5 < 3).alias("flagged"))
    return assembly.gains(assembly.parent_pairs(original, changed, ["engine"]), ["engine", "group"])


_TAGS = {"v1": 0, "v0": 1, "v1rep": 2, "v0rep": 3}
_REPEATS = [("v1", "v0"), ("v1", "v1rep"), ("v0", "v0rep"), ("v1rep", "v0rep")]
_ALIKE = {"score": "(doc_id * {k} // 3) % 10", "content": "CASE WHEN doc_id % (5 + {k}) = 0 THEN source ELSE lang END", "reasoning": "substring(text, 1 + (doc_id % 3) * ({k} // 2), 20)", "tokens": "n_chars + (CASE WHEN doc_id % 4 = {k} THEN 1 ELSE 0 END)"}


@query("WITH w AS (SELECT lang, " + ", ".join(f"{e.format(k=k)} AS {t}_{f}" for t, k in _TAGS.items() for f, e in _ALIKE.items()) + " FROM documents) SELECT lang, what, count(*) AS cases, count(*) FILTER (ok) AS agreeing FROM (SELECT lang, unnest(["
       + ", ".join(f"'{a}_{b}_{f}'" for a, b in _REPEATS for f in _ALIKE) + "]) AS what, unnest([" + ", ".join(f"{a}_{f} IS NOT DISTINCT FROM {b}_{f}" for a, b in _REPEATS for f in _ALIKE) + "]) AS ok FROM w) GROUP BY lang, what")
def transport_agreement(spark, sf):
    """Two transports, each run twice: how often score, content, reasoning and tokens agree."""
    docs = fx.table(spark, sf, "documents")
    runs = [docs.select("doc_id", "lang", F.lit(t).alias("tag"), *[F.expr(_SPARK(e.format(k=k))).cast("string").alias(f) for f, e in _ALIKE.items()]) for t, k in _TAGS.items()]
    rows = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
    wide = rows.groupBy("doc_id", "lang").agg(*[F.max(F.when(F.col("tag") == t, F.col(f))).alias(f"{t}_{f}") for t in _TAGS for f in _ALIKE])
    return assembly.agreement(wide, _REPEATS, list(_ALIKE), ["lang"])


# ---- Runs, work and spend


@query("""WITH e AS (SELECT event_id AS id, 'run' || user_id % 97 AS run, user_id, event_type, value FROM events), q AS (SELECT 'q' || id // 3 || run AS request, run, count(*) AS attempts FROM e GROUP BY ALL),
p AS (SELECT 'q' || id // 3 || run AS request, run, CASE WHEN id % 5 <> 0 THEN (id % 1000 * 0.000000000123::DECIMAL(18,12))::DECIMAL(18,12) END AS cost, id % 700 AS pt, id % 90 AS ct, CASE WHEN id % 4 = 0 THEN id % 50 END AS rt, CASE WHEN id % 9 = 0 THEN 'length' ELSE 'stop' END AS fin FROM e WHERE id % 3 = 0),
o AS (SELECT run, CASE WHEN id % 7 = 0 THEN 'dedup_same_run' WHEN id % 7 = 1 THEN 'legacy_migrated' ELSE 'native' END AS origin FROM e), r AS (SELECT DISTINCT run FROM e),
a AS (SELECT run, count(DISTINCT request) AS requests, sum(attempts)::BIGINT AS att FROM q GROUP BY run), b AS (SELECT run, count(DISTINCT request) AS n, sum(cost) AS cost, count(cost) AS priced, sum(pt)::BIGINT AS pt, sum(ct)::BIGINT AS ct, sum(rt)::BIGINT AS rt, count(*) FILTER (fin = 'length') AS cut FROM p GROUP BY run),
c AS (SELECT run, count(*) FILTER (origin = 'native') AS nat, count(*) FILTER (origin = 'dedup_same_run') AS reused FROM o GROUP BY run), l AS (SELECT run, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY run), s AS (SELECT run, sum(0.000000100001::DECIMAL(18,12)) AS usd FROM e WHERE id % 11 = 0 GROUP BY run)
SELECT r.run, coalesce(requests, 0) AS requests, coalesce(att, 0) AS dispatch_attempts, coalesce(b.n, 0) AS native_responses, b.cost::VARCHAR AS cost, coalesce(priced, 0) AS priced_responses, pt AS prompt_tokens, ct AS completion_tokens, rt AS reasoning_tokens, coalesce(cut, 0) AS length_limited,
 coalesce(nat, 0) AS native_observations, coalesce(reused, 0) AS reused_observations, coalesce(l.n, 0) AS rate_limits, usd::VARCHAR AS allowance FROM r LEFT JOIN a USING (run) LEFT JOIN b USING (run) LEFT JOIN c USING (run) LEFT JOIN l USING (run) LEFT JOIN s USING (run)""")
def run_spend_exact(spark, sf):
    """All of a run's work and its exact cost."""
    e = fx.table(spark, sf, "events").select(_F("event_id").alias("id"), F.concat(F.lit("run"), _F("user_id") % 97).alias("run"), "event_type")
    request = F.concat(F.lit("q"), F.expr("id div 3"), "run")
    named = e.withColumn("request", request)
    d = responses.DOLLARS
    cost = F.when(_F("id") % 5 != 0, ((_F("id") % 1000).cast("decimal(6,0)") * F.lit("0.000000000123").cast(d)).cast(d))
    said = named.where("id % 3 = 0").select("request", cost.alias("cost"), (_F("id") % 700).alias("prompt_tokens"), (_F("id") % 90).alias("completion_tokens"), F.when(_F("id") % 4 == 0, _F("id") % 50).alias("reasoning_tokens"), F.when(_F("id") % 9 == 0, "length").otherwise("stop").alias("finish_reason"))
    seen = e.select("run", F.when(_F("id") % 7 == 0, "dedup_same_run").when(_F("id") % 7 == 1, "legacy_migrated").otherwise("native").alias("origin"))
    ledger = e.select("run", F.when(_F("id") % 11 == 0, "allowed").otherwise("other").alias("ledger"), F.lit("0.000000100001").cast(d).alias("usd"))
    requests = named.groupBy("request", "run").agg(F.count("*").alias("attempts"))
    found = responses.run_spend(e.select("run").distinct(), requests, said, seen, named.where("event_type = 'error'").select("request"), ledger, "allowed")
    return found.withColumns({c: F.col(c).cast("string") for c in ("cost", "allowance")})


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max, round(min(value), 4) AS min FROM events GROUP BY event_type""")
def value_distribution(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(*metrics.distribution("value"))


@query(f"""WITH {fx.OBSERVATIONS}, q AS (SELECT o.engine, o.case_id, o.strategy, o.idx, o.positive, coalesce(o.score > 0.5, false) AS fl, sha256(s.segment) AS h, (o.case_id * 7 + o.idx * 3 + o.engine) % 50 / 10.0::DOUBLE AS sec FROM o JOIN s USING (case_id, strategy, idx)),
f AS (SELECT * FROM q WHERE strategy = 'full'), w AS (SELECT q.*, f.fl AS whole, coalesce(bool_or(q.fl) OVER (PARTITION BY q.engine, q.case_id ORDER BY q.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM q JOIN f USING (engine, case_id) WHERE q.strategy = 'window'),
u AS (SELECT 'full' AS mode, engine, case_id, positive, fl, h, sec FROM f UNION ALL SELECT 'windows', engine, case_id, positive, fl, h, sec FROM w UNION ALL SELECT 'full_then_windows', engine, case_id, positive, fl, h, sec FROM f UNION ALL SELECT 'full_then_windows', engine, case_id, positive, fl, h, sec FROM w WHERE NOT whole
 UNION ALL SELECT 'full_then_windows_early_exit', engine, case_id, positive, fl, h, sec FROM f UNION ALL SELECT 'full_then_windows_early_exit', engine, case_id, positive, fl, h, sec FROM w WHERE NOT whole AND NOT seen),
i AS (SELECT engine, mode, count(*) AS inputs, sum(n)::BIGINT AS calls, round(sum(sec), 4) AS seconds FROM (SELECT engine, mode, h, count(*) AS n, min(sec) AS sec FROM u GROUP BY ALL) GROUP BY ALL),
fc AS (SELECT engine, mode, count(*) FILTER (fl AND positive) AS attack_flags, count(*) FILTER (fl AND NOT positive) AS clean_flags FROM (SELECT engine, mode, case_id, positive, bool_or(fl) AS fl FROM u GROUP BY ALL) GROUP BY ALL)
SELECT engine, mode, calls, inputs, seconds, attack_flags, clean_flags FROM i JOIN fc USING (engine, mode)""")
def cascade_replay_modes(spark, sf):
    """Work of four ways to screen the same cases, each distinct input counted once."""
    ids = segment.identify(fx.segments(spark, sf)).select("case_id", "strategy", "idx", _F("text_sha256").alias("sha"))
    seconds = (_F("case_id") * 7 + _F("idx") * 3 + _F("engine")) % 50 / 10.0
    obs = fx.observations(spark, sf).join(ids, ["case_id", "strategy", "idx"]).select("engine", "case_id", "strategy", "idx", "positive", (_F("score") > 0.5).alias("flag"), "sha", seconds.alias("seconds"))
    side = lambda name: obs.where(F.col("strategy") == name).drop("strategy")
    found = verdict.replay(side("full").drop("idx"), side("window"), ["engine", "case_id"], ["engine"])
    return found.select("engine", "mode", "calls", "inputs", F.round("seconds", 4).alias("seconds"), "attack_flags", "clean_flags")


@query(f"""WITH {fx.SEGMENTS} SELECT sha256(segment) AS text_sha256, len(string_split_regex(trim(any_value(segment)), '\\s+')) AS n_words, strlen(any_value(segment)) AS n_bytes, count(*) AS segments, count(*) FILTER (segment = c.text) AS whole FROM s JOIN c USING (case_id) GROUP BY segment""")
def segment_blobs(spark, sf):
    """Distinct texts of all segments, and how many of the segments are all of their source."""
    rows = segment.identify(fx.segments(spark, sf))
    told = segment.whole_source(rows, fx.cases(spark, sf).select("case_id", "text"), ["case_id"]).groupBy("text_sha256").agg(F.count_if("is_whole_source").alias("whole"))
    found = segment.blobs(rows).join(told, "text_sha256")
    return found.select("text_sha256", _F("n_words").cast("long").alias("n_words"), _F("n_bytes").cast("long").alias("n_bytes"), "segments", "whole")


@query("""WITH r AS (SELECT s_suppkey AS run, s_nationkey % 3 AS engine, s_suppkey % 2 AS rule, s_nationkey % 4 AS dataset, s_suppkey % 5 AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 2 * 10 END AS lim FROM supplier),
p AS (SELECT f.run AS full_run, w.run AS window_run FROM r f JOIN r w ON f.engine = w.engine AND f.rule = w.rule AND f.dataset = w.dataset AND f.lim IS NOT DISTINCT FROM w.lim AND f.run <> w.run WHERE f.k IN (0, 1) AND w.k IN (1, 2, 3)),
v AS (SELECT s_suppkey AS run, unnest(range(s_suppkey % 7, 8)) AS case_id FROM supplier) SELECT full_run, window_run, f.case_id, (full_run + f.case_id) % 3 = 0 AS full_flagged, (window_run + f.case_id) % 3 = 0 AS window_flagged FROM p JOIN v f ON f.run = full_run JOIN v w ON w.run = window_run AND w.case_id = f.case_id""")
def full_and_window_runs(spark, sf):
    """Runs over whole texts with those over windows that are else alike; a run that is both is never paired with itself."""
    c, k = _F, _F("s_suppkey") % 5
    rows = fx.table(spark, sf, "supplier")
    runs = rows.select(c("s_suppkey").alias("run"), (c("s_nationkey") % 3).alias("engine"), (c("s_suppkey") % 2).alias("rule"), (c("s_nationkey") % 4).alias("dataset"), F.lit("all").alias("selector"), F.lit("all").alias("turn_selection"), F.when(c("s_suppkey") % 3 == 0, c("s_nationkey") % 2 * 10).alias("case_limit"), F.when(k < 2, "full_text").otherwise("window").alias("strategy"), k.between(1, 3).alias("segmenting"))
    seen = rows.select(c("s_suppkey").alias("run"), F.explode(F.sequence(c("s_suppkey") % 7, F.lit(7).cast("long"))).alias("case_id"))
    return metrics.full_and_window_runs(runs, seen.withColumn("flagged", (c("run") + c("case_id")) % 3 == 0))


@query("""WITH a AS (SELECT user_id % 50 AS case_id, event_id, event_type, event_id % 2 AS stage FROM events) SELECT case_id, count(*) AS assessments, array_to_string(list(CASE stage WHEN 0 THEN 'first' ELSE 'then' END || event_id ORDER BY stage, event_id), ',') AS stages FROM a GROUP BY case_id""")
def concatenated_assessments(spark, sf):
    """The assessments of both stages of a cascade as one list for each case."""
    e = fx.table(spark, sf, "events").select((_F("user_id") % 50).alias("case_id"), "event_id", "event_type")
    found = verdict.concatenated({"first": e.where("event_id % 2 = 0"), "then": e.where("event_id % 2 = 1")}, ["case_id"])
    named = F.array_join(F.transform("assessments", lambda a: F.concat(a["stage"], a["event_id"].cast("string"))), ",")
    return found.select("case_id", F.size("assessments").cast("long").alias("assessments"), named.alias("stages"))


@query(f"""WITH {fx.STRICT}, a AS (SELECT case_id, flagged AS f FROM v WHERE engine = 1 AND strategy = 'full'), b AS (SELECT case_id, flagged AS t FROM v WHERE engine = 2 AND strategy = 'full')
SELECT case_id, coalesce(f, false) OR coalesce(t, false) AS flagged, NOT (coalesce(f, false) OR coalesce(t, false)) AND (f IS NULL OR t IS NULL) AS inconclusive FROM a JOIN b USING (case_id)""")
def screening_cascade(spark, sf):
    """A cascade whose undecided stages don't flag, with what it left undecided."""
    from trivalent.plans.decisions import strict

    flags = strict(spark, sf).where("strategy = 'full'")
    a, b = (flags.where(F.col("engine") == e).select("case_id", F.col("flagged").alias(n)) for e, n in ((1, "f"), (2, "t")))
    rows = a.join(b, "case_id")
    return rows.select("case_id", verdict.cascade(_F("f"), _F("t"), "screen").alias("flagged"), verdict.screen_inconclusive(_F("f"), _F("t")).alias("inconclusive"))


# ---- Files of events


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 13 <> 5")
def event_files(spark, sf):
    """The table written as lines of JSON, a thirteenth of them torn, and read back by ranges of 64 KB."""
    rows = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    line = F.to_json(F.struct(F.lit("event").alias("type"), "event_id", "user_id", "event_type"))
    torn = F.when(_F("event_id") % 13 == 5, F.left(line, F.length(line) - 3)).otherwise(line)
    path = streams.stored_lines(rows.select(torn.alias("value")), "events")
    found = files.read_events(spark, path, skip_bad=True, size=1 << 16)
    get = lambda name, kind: F.try_variant_get("event", f"$.{name}", kind).alias(name)
    return found.select(get("event_id", "long"), get("user_id", "long"), get("event_type", "string"))


@query("""SELECT sha256(event_type || '/' || event_id % 1000) AS sha256, count(*) AS lines FROM events GROUP BY 1""")
def stream_event_files(spark, sf):
    """Files of lines followed as a stream and merged by the place of each line."""
    rows = fx.table(spark, sf, "events").select(F.concat("event_type", F.lit("/"), _F("event_id") % 1000).alias("value"))
    path = streams.stored_lines(rows, "lines")
    merged = streams.merged(lines.follow(spark, path, size=1 << 16), ["file", "at"], f"{path}-merged")
    return merged.groupBy(sha("text").alias("sha256")).agg(F.count("*").alias("lines"))


# ---- Origins, links, seeds and dates


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS b, c_custkey % 5 = 2 AS same FROM customer) SELECT k AS run, CASE WHEN b % 2 = 1 THEN 'derived_equivalent' WHEN b // 2 % 2 = 1 THEN 'reused_full_input' ELSE 'live' END AS origin, CASE WHEN b % 2 = 1 THEN 3 WHEN b // 2 % 2 = 1 THEN 2 WHEN b // 4 = 1 THEN 1 ELSE 0 END AS rank,
CASE WHEN same THEN 'dedup_same_run' WHEN b % 2 = 1 THEN 'derived_segment_equivalence' WHEN b // 2 % 2 = 1 THEN 'reused_full_input' WHEN b // 4 = 1 THEN 'dedup_native_input' ELSE 'reused_full_input' END AS method FROM c""")
def run_origins(spark, sf):
    """Runs' metadata with every set of the three kinds of reuse."""
    k = _F("c_custkey")
    part = lambda bit, name: F.when((k % 8).bitwiseAND(bit) > 0, F.concat(F.lit(f'"{name}":{{"sourceRunId":"'), "c_name", F.lit('"}'))).otherwise(F.lit(f'"{name}":null') if bit == 2 else None)
    meta = F.concat(F.lit("{"), F.array_join(F.array(F.concat(F.lit('"runId":"'), "c_name", F.lit('"')), part(1, "derivedFrom"), part(2, "reuseFrom"), part(4, "inputReuseFrom")), ","), F.lit("}"))
    rows = fx.table(spark, sf, "customer").select(k.alias("run"), meta.alias("meta"), F.concat(F.when(k % 5 == 2, "same-run:").otherwise("runs/"), "c_name").alias("source"))
    return rows.select("run", *[c.alias(n) for n, c in assembly.run_origin("meta", "source").items()])


@query("""SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 90 DAY) AS late FROM orders""")
def late_orders(spark, sf):
    """Orders marked where any of their lines shipped late; many such lines mark an order once."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines_ = fx.table(spark, sf, "lineitem").select(_F("l_orderkey").alias("o_orderkey"), "l_shipdate").join(orders, "o_orderkey").where("l_shipdate > o_orderdate + INTERVAL 90 DAYS")
    return assembly.mark_existing(orders, lines_, ["o_orderkey"], "late").select("o_orderkey", "late")


_SEEDED = {"fixed": "7 & 4294967295", "xor_case_ordinal_v1": "xor(xor(7, 64 * 65537), doc_id + 1) & 4294967295", "legacy_notinject_v1": "xor(xor(7, 64 * 65537), doc_id) & 4294967295"}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, ({e})::BIGINT AS s0 FROM documents" for k, e in _SEEDED.items()) + """), a AS (SELECT *, (s0 * 1664525 + 1013904223) & 4294967295 AS s1 FROM s), b AS (SELECT *, (s1 * 1664525 + 1013904223) & 4294967295 AS s2 FROM a)
SELECT doc_id, kind, s0 AS seed, s1 / 4294967296.0::DOUBLE AS first, s2 / 4294967296.0::DOUBLE AS second FROM b""")
def seeded_draws(spark, sf):
    """Each document's seed by the three rules, and the first two draws of its stream."""
    docs = fx.table(spark, sf, "documents").select("doc_id")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), seed_for(k, 7, 64, "doc_id").alias("seed")) for k in _SEEDED])).alias("s")
    rows = docs.select("doc_id", kinds).select("doc_id", "s.kind", "s.seed")
    return rows.select("doc_id", "kind", "seed", (lcg(_F("seed")) / F.lit(4294967296.0)).alias("first"), (lcg(lcg(_F("seed"))) / F.lit(4294967296.0)).alias("second"))


@query("""WITH e AS (SELECT event_id, ts, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k < 4 THEN epoch_ms(date_trunc('second', ts)) + CASE WHEN k = 2 THEN date_part('millisecond', ts)::BIGINT % 1000 ELSE 0 END END AS at_ms, CASE WHEN event_id % 31 + 1 <= date_part('day', last_day(make_date(2023, (event_id % 12 + 1)::INT, 1))) THEN make_date(2023, (event_id % 12 + 1)::INT, (event_id % 31 + 1)::INT)::VARCHAR END AS day FROM e""")
def iso_times(spark, sf):
    """Instants in ISO texts of several offsets, some not ISO, and dates of three numbers, some of no day."""
    k, ts = _F("event_id") % 6, _F("ts").cast("timestamp")
    text = lambda at, form, tail: F.concat(F.date_format(at, form), F.lit(tail))
    plain = "yyyy-MM-dd'T'HH:mm:ss"
    written = (
        F.when(k == 0, text(ts, plain, "Z")).when(k == 1, text(ts + F.expr("INTERVAL 2 HOURS"), plain, "+02:00")).when(k == 2, text(ts, plain + ".SSS", "Z"))
        .when(k == 3, text(ts - F.expr("INTERVAL 330 MINUTES"), plain, "-05:30")).when(k == 4, text(ts, "yyyy-MM-dd HH:mm", "")).otherwise(F.concat(F.lit("on "), F.date_format(ts, "d.M.yyyy")))
    )
    rows = fx.table(spark, sf, "events").select("event_id", written.alias("written"))
    day = date_of(F.lit(2023), _F("event_id") % 12 + 1, _F("event_id") % 31 + 1)
    return rows.select("event_id", F.unix_millis(iso_time("written")).alias("at_ms"), day.cast("string").alias("day"))


@query(f"WITH {fx.OBSERVATIONS} SELECT 'derived/' || case_id AS run, case_id, idx, idx AS source_idx, score, 'derived_segment_equivalence' AS origin FROM o WHERE engine = 1 AND strategy = 'window' AND idx % 2 = 0")
def derived_observations(spark, sf):
    """A run over windows that don't overlap, had from one over windows that do: every observation is a source's under the new run's name."""
    rows = segment.identify(segment.sliding(fx.cases(spark, sf), fx.WINDOW, fx.STRIDE)).withColumn("segment_key", F.struct("case_id", _F("idx").cast("long").alias("idx")))
    found = assembly.derive(rows.where("idx % 2 = 0"), rows, ["case_id", "text_sha256"], "segment_key", "start_word", "end_word")
    source = fx.observations(spark, sf).where("engine = 1 AND strategy = 'window'").select(F.struct("case_id", "idx").alias("segment_key"), F.lit("source").alias("run"), "score", F.lit("native").alias("origin"))
    run = assembly.derived_run(found, source, "segment_key", {"run": F.concat(F.lit("derived/"), "segment_key.case_id"), "origin": F.lit("derived_segment_equivalence")})
    return run.select("run", "segment_key.case_id", "segment_key.idx", _F("source_segment.idx").alias("source_idx"), "score", "origin")
