"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once and keeps, for each document, its measurements and one long whose bit r
is set where rule r failed. Versioned policies are masks over those bits: applying one, or comparing many,
reads the ledger alone. `ablation` groups the ledger by the failed bits that a policy looks at, a table of at
most 2^rules rows, and counts from it what each rule alone rejects and what it would keep if dropped.

Everything happens within a row; there is no shuffle before the small group-by of the ablation. The ledger is
stored, so that filters on it never evaluate the rules again. Repeated
5-word windows are found by hash; a text without any (the common case) is told by its distinct hashes, and
only the others are sorted.

Defined cases: a null or empty text has no words, fails `few_words`, and measures zero throughout; very long texts
are measured whole; an empty table has an empty ledger and no ablation; repeated rows each return; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: (name, SQL condition of failure over the measurements), in bit order; append only, so that old ledgers stay readable.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_density", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamation", "5 * n_exclaim > n_words"),
    ("digits", "4 * n_digits > word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: the rules that each rejects by.
POLICIES = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbol_density", "word_length"),
    "v2": mask(*BIT),
}


def _count(text: str, chars: str) -> Column:
    """How often any of these characters stands in the text."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeats(words: str, hashes: str) -> Column:
    """Words that stand in windows found twice or more: window places in hash order, those like a neighbour, then their union."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    like = lambda s, x, j: (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])
    twice = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, j: like(s, x, j - 1) | like(s, x, j + 1)))[0]
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    union = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(union)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that the text fails; written once, as Parquet in the shared folder."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    split = texts.withColumn("w", F.array_remove(F.split("t", SPACE), "")).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    measured = split.withColumn("h", hashes).select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count("t", SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeats("w", "h").alias("n_repeat_words"),
        _count("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _count("t", "!").cast("long").alias("n_exclaim"),
        _count("t", "0123456789").cast("long").alias("n_digits"),
    )
    failed = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(0).cast("long") for name, test in RULES), F.lit(0).cast("long"))
    return stored(measured.withColumn("failed", failed), "ledger")


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(POLICIES[policy]) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents that fail it, that it alone rejects, and that stay with and without it."""
    names = [n for n in BIT if BIT[n] & POLICIES[policy]]
    by_mask = rows.groupBy(F.col("failed").bitwiseAND(POLICIES[policy]).alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in names]))
    each = by_mask.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    kept = F.col("bits") == 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(alone).alias("n_only"), total(kept).alias("n_kept"), total(kept | alone).alias("n_kept_without")
    )


#: The same ledger and policy v2 in DuckDB SQL.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
h AS (SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] || chr(10) || w[i+3] || chr(10) || w[i+4] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(5, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -5)) AS n FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
        (length(t) - length(regexp_replace(t, '!', '', 'g')))::BIGINT AS n_exclaim,
        (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS n_digits FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {test} THEN {BIT[name]} ELSE 0 END" for name, test in RULES)})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {POLICIES["base"]} <> 0 AS base_failed,
       failed & {POLICIES["v2"]} = 0 AS kept, n_lines, n_upper, n_exclaim, n_digits, failed FROM f
"""

_EACH = ", ".join(f"('{p}', '{n}', {BIT[n]}, {m})" for p, m in POLICIES.items() for n in BIT if BIT[n] & m)
#: The ablations of all policies in DuckDB SQL, a pass over the ledger for each rule.
ABLATION_SQL = f"""
WITH led AS ({SQL}), r AS (SELECT * FROM (VALUES {_EACH}) AS r(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only, count(*) FILTER (failed & mask = 0) AS n_kept,
  count(*) FILTER (failed & mask & ~bit = 0) AS n_kept_without
FROM r LEFT JOIN led ON true GROUP BY policy, rule
"""
