"""Cohorts, probes, policies, controls and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import col, sha, words


def run_cases(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases of each run (revision, selector, case_limit): by class, the first by ordinal up to the limit; null is no limit."""
    joined = runs.join(cases, "revision").where((F.col("selector") == "all") | ((F.col("selector") == "positive") == F.col("positive")))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("ordinal"))
    return joined.withColumn("nth_", nth).where(F.col("case_limit").isNull() | (F.col("nth_") <= F.col("case_limit"))).drop("nth_")


def selected(cases: DataFrame, ids: DataFrame, case: str = "case_id") -> DataFrame:
    """The cases of a list of ids, in the cases' own order; fails on unknown or repeated ids."""
    if ids.groupBy(case).count().where("count > 1").limit(1).count() or ids.join(cases, case, "left_anti").limit(1).count():
        raise ValueError("unknown or repeated case ids")
    return cases.join(ids, case, "left_semi")


def probe_groups(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Flags, mean score and the histogram of values of each group."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.count_if("flagged").alias("f"), F.sum("score").alias("s"), F.count("score").alias("k"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("cases"), F.sum("f").alias("flagged"), F.round(F.sum("s") / F.nullif(F.sum("k"), F.lit(0)), 6).alias("mean_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(value).cast("string"), F.lit("none")), "n")))).alias("histogram"),
    )


def probe_pairs(rows: DataFrame, keys: list[str], family: list[str], target: str, low: float, high: float, threshold: float = 0.5, near: float = 0.1) -> DataFrame:
    """Families with a low and a high target, by keys: how many, scored in both arms, flipped up, in reach of both targets, and the mean change.

    Rows have score (null unless scored) and the target value; a score is in reach of a target if it is the target or `near` below it.
    """
    at = lambda t: F.max(F.when(F.round(target, 6) == t, F.col("score")))
    known = rows.where(F.round(target, 6).isin(low, high)).groupBy(*keys, *family).agg(at(low).alias("l"), at(high).alias("h"))
    valid = F.col("l").isNotNull() & F.col("h").isNotNull()
    reach = lambda c, t: F.round(c, 6).isin(round(t - near, 6), t)
    return known.groupBy(*keys).agg(
        F.count("*").alias("families"), F.count_if(valid).alias("both_valid"), F.count_if(valid & (F.col("l") <= threshold) & (F.col("h") > threshold)).alias("low_to_high_flips"),
        F.count_if(valid & reach("l", low) & reach("h", high)).alias("matched_both_targets"), F.round(F.avg(F.when(valid, F.col("h") - F.col("l"))), 6).alias("mean_high_minus_low"),
    )


def target_matches(value: Column | str, targets: list[Column]) -> Column:
    """How many rows have one of the requested values."""
    return F.count_if(F.coalesce(col(value).isin(*targets), F.lit(False)))


def shifts(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """How scores move from a to b: up, down, the same, and across the threshold."""
    a, b = F.col("a_score"), F.col("b_score")
    return pairs.groupBy(*keys).agg(
        F.count_if(b > a).alias("increased"), F.count_if(b < a).alias("decreased"), F.count_if(a == b).alias("unchanged"),
        F.count_if((a <= threshold) & (b > threshold)).alias("crossed_up"), F.count_if((a > threshold) & (b <= threshold)).alias("crossed_down"),
    )


def policy_outcome(allowed_flag: Column, forbidden_flag: Column) -> Column:
    """What a detector makes of one text under a policy that allows it and one that forbids it."""
    return F.when(~allowed_flag & forbidden_flag, "both_correct").when(allowed_flag & forbidden_flag, "always_flag").when(~allowed_flag & ~forbidden_flag, "never_flag").when(allowed_flag & ~forbidden_flag, "reversed")


def coverage(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Each planned cell: validated, partial or unstarted, by the cases done of those expected."""
    joined = plan.join(done.groupBy(*keys).agg(F.count("*").alias("done")), keys, "left")
    n = F.coalesce("done", F.lit(0))
    return joined.withColumn("done", n).withColumn("state", F.when(n == 0, "unstarted").when(n >= F.col("expected"), "validated").otherwise("partial"))


def unequal_cases(rows: DataFrame, case: list[str], models: int) -> DataFrame:
    """Cases that the models did not see alike: another label or input, or not all of the models."""
    seen = rows.groupBy(*case).agg(F.count_distinct("engine").alias("models"), F.count_distinct("positive").alias("labels"), F.count_distinct("input_sha256").alias("inputs"))
    return seen.where((F.col("labels") > 1) | (F.col("inputs") > 1) | (F.col("models") != models))


def cohort_hash(cases: DataFrame, keys: list[str]) -> DataFrame:
    """A hash of each cohort's (ordinal, case_id, text_sha256, positive), in order."""
    row = F.struct("ordinal", F.concat_ws("|", "case_id", "text_sha256", F.col("positive").cast("string")).alias("line"))
    return cases.groupBy(*keys).agg(F.count("*").alias("cases"), sha(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n")).alias("cohort_sha256"))


def placed(text: Column | str, payload: Column, position: str, key: Column | str) -> Column:
    """The text with a payload at its start, end, or after a word chosen by the hash of a key (its first 60 bits, by the number of words)."""
    if position == "start":
        return F.concat(payload, F.lit(" "), col(text))
    if position == "end":
        return F.concat(col(text), F.lit(" "), payload)
    w = words(text)
    at = (F.conv(F.substring(sha(col(key).cast("string")), 1, 15), 16, 10).cast("long") % F.greatest(F.size(w), F.lit(1))).cast("int")
    return F.array_join(F.concat(F.slice(w, F.lit(1), at), F.array(payload), F.slice(w, at + 1, F.size(w))), " ")


def encoded(text: Column | str) -> dict[str, Column]:
    """Controls: Base64 of the UTF-8 text, and its ASCII letters as escapes."""
    plain = F.regexp_replace(F.base64(F.encode(col(text), "utf-8")), r"[\r\n]", "")
    escape = lambda c: F.when(c.rlike("^[A-Za-z]$"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)
    return {"base64": plain, "escaped": F.array_join(F.transform(F.filter(F.split(col(text), ""), lambda c: c != ""), escape), "")}


def batches(lines: DataFrame, order: str, kind: str) -> DataFrame:
    """Start and finish lines of each ledger paired: a finish with the last start before it."""
    upto = Window.partitionBy("ledger").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    keyed = lines.withColumn("started", F.last(F.when(F.col(kind) == "start", F.col(order)), ignorenulls=True).over(upto))
    return keyed.where((F.col(kind) == "finish") & F.col("started").isNotNull())


def usage(raw: Column | str) -> dict[str, Column]:
    """Tokens and the stop reason out of a response, whichever of the known shapes it has; null where it isn't JSON."""
    v = F.try_parse_json(col(raw))
    first = lambda *paths, kind="long": F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])
    return {
        "prompt_tokens": first("$.usage.prompt_tokens", "$.usage.input_tokens", "$.stats.input_tokens"), "completion_tokens": first("$.usage.completion_tokens", "$.usage.output_tokens", "$.stats.total_output_tokens"),
        "finish_reason": first("$.choices[0].finish_reason", "$.stop_reason", kind="string"),
    }


def budget(limit: Column, used: Column, reserve: Column) -> Column:
    """What may still be spent: never below nothing, nor above the limit less the reserve."""
    return F.greatest(F.lit(0.0), F.least(limit - reserve, limit - used))
