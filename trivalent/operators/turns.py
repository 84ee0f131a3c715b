"""Cases, turns and redaction of authored spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.functions.text import SPACE, col, is_blank, sha, trimmed

ORIGINS = {"system": "operator", "assistant": "agent", "user": "external"}
ACTIONS = {"operator": "observe", "agent": "observe", "external": "abort"}


def origin_of(role: Column | str) -> Column:
    """A turn's origin by its role; unknown and missing roles are external."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv])[col(role)], F.lit("external"))


def action_for(origin: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.coalesce(col(origin), F.lit("external"))]


def cases_of_turns(turns: DataFrame) -> DataFrame:
    """One case a conversation: its turns in order, and the hash of their joined text."""
    turn = F.struct(F.col("turn"), F.concat_ws("/", "conv_id", "turn").alias("id"), "role", origin_of("role").alias("origin"), "text")
    cases = turns.groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return cases.withColumn("text_sha256", sha(F.array_join("turns.text", "\n")))


def select_turns(turns: Column | str, selection: str) -> Column:
    """The turns that are screened: `all`, `all_external` or `last_external`; null where an external one is asked for and there is none."""
    if selection == "all":
        return col(turns)
    external = F.filter(col(turns), lambda t: t["origin"] == "external")
    if selection == "all_external":
        return F.when(F.size(external) > 0, external)
    if selection == "last_external":
        return F.when(F.size(external) > 0, F.slice(external, -1, 1))
    raise ValueError(f"unknown turn selection {selection}")


def redact(df: DataFrame, registry: DataFrame, text: str = "text", span: str = "text", least: int = 40, batch: int = 1000, name: str = "redacted") -> DataFrame:
    """Replace every registered span of `least` characters or more by one space, the longest first whatever it is made of, spans of equal length in their order.

    A span's longest inner word (with white space on both sides within the span) stands as a word in every text that
    holds the span, so candidates meet by an equi-join on words; of these, spans that a text really holds are replaced.
    Work grows with candidates, not with spans times texts. Spans without an inner word, rare at that length, are
    looked for in all texts, in batches of bounded number. What both ways find is replaced in one pass over each distinct
    text. A span that only comes about where a longer one has gone, across the blank left by it, is not looked for.
    """
    spans = registry.select(trimmed(span).alias("span")).where(F.length("span") >= least).distinct()
    inner = F.split("span", rf"[{SPACE}]+")
    anchor = F.array_max(F.transform(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    anchored = spans.withColumn("word", anchor)
    texts = df.select(F.col(text).alias("body")).where(F.col("body").isNotNull()).select(sha("body").alias("key"), "body").dropDuplicates(["key"])
    met = texts.select("key", F.explode(F.array_distinct(F.split("body", rf"[{SPACE}]+"))).alias("word")).join(anchored.where("word IS NOT NULL"), "word").select("key", "span")
    held = texts.join(met, "key").where(F.contains("body", F.col("span"))).select("key", "body", "span")
    for some in _batches(anchored.where("word IS NULL").select("span"), batch):
        held = held.unionByName(texts.crossJoin(some).select("key", "body", F.explode(F.filter("spans_", lambda s: F.contains(F.col("body"), s))).alias("span")))
    lists = held.groupBy("key").agg(F.first("body").alias("body"), F.array_sort(F.collect_list(F.struct((-F.length("span")).alias("n"), "span"))).alias("spans"))
    shorter = lists.select("key", F.aggregate("spans", F.col("body"), lambda acc, s: F.replace(acc, s["span"], F.lit(" "))).alias("body"))
    out = df.withColumn("key_", sha(text)).join(shorter.select(F.col("key").alias("key_"), F.col("body").alias("body_")), "key_", "left")
    return out.withColumn(name, F.coalesce("body_", text)).drop("key_", "body_")


def _batches(spans: DataFrame, batch: int) -> list[DataFrame]:
    """The spans as tables of one row, an array of about `batch`, dealt by hash."""
    parts = -(-spans.count() // batch)
    dealt = spans.withColumn("part_", F.pmod(F.xxhash64("span"), F.lit(max(parts, 1))))
    return [F.broadcast(dealt.where(F.col("part_") == b).agg(F.collect_list("span").alias("spans_"))) for b in range(parts)]


def has_unauthored(redacted: Column | str) -> Column:
    """Whether anything but white space is left of a redacted text."""
    return ~is_blank(redacted)


def redacted_decision(original: Column | str, redacted: Column | str) -> Column:
    """`allow` where nothing is left to screen."""
    return F.when(is_blank(redacted), F.lit("allow"))
