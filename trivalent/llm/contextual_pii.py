r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the spans of four kinds that fixed patterns and checks find: email, ip, card and phone. Every identifier-like
string of a text (a seed, or a run with a digit or an @) is an occurrence with its context: the word before, two words
before, the word before and the one after. Contexts are patterns, normalised strings are instances, and distinct pairs
of both are a graph, so copies of a text count once. Rounds over the graph score both sides: a pattern's confidence in a
kind is the lower Wilson bound of the share of its instances believed to be of that kind (a single word, which meets by
chance, is bounded more strictly than a label or more words); patterns of enough belief and confidence are accepted; an unseen
instance is believed as much as the best accepted pattern that it stands in, and counts with that in the next round. Unseen
identifiers that stand in an accepted pattern become spans of its kind, beside the seeds.

A text is scanned within its row and read once; what leaves it (spans, occurrences) is stored. The graph is aggregated
before it is shuffled on, patterns of fewer than `LEAST` instances go first (none of them can be accepted), and
every round is a join by pattern and one by instance of what is left. Nothing is broadcast but what Spark sizes itself.
Patterns use possessive repetition and start at borders of runs, so a scan is linear in a text's length; positions are
running sums in blocks of about the square root of their number.

Defined cases: a null or empty text has no spans; very long texts are scanned whole (contexts are read within 48 characters
of an occurrence); an occurrence that overlaps a seed of any kind is never discovered; of two kinds the more confident,
then the first listed, names a discovered span; repeated rows and null ids each return; an empty table has no rows; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, so written that they never backtrack over a run and start at its border only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Cheap conditions without which a kind has no valid match.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

_RUN = "A-Za-z0-9_@.+/%-"
#: An identifier-like string that is none of the four: a run with a digit or an @, and what goes on from it after a blank or bracket with a digit.
OTHER = rf"(?<![{_RUN}])[A-Za-z_.+/%-]*+[0-9@](?:[{_RUN}]*[A-Za-z0-9])?(?:\)?\x20?\(?[0-9](?:[{_RUN}]*[A-Za-z0-9])?)*+"
SCAN = rf"{EMAIL}|{PHONE}|(?<![0-9.]){IP}|(?<![0-9])[0-9](?:[\x20-]?[0-9]){{12,18}}(?![\x20-]?[0-9])|{OTHER}"

#: What may stand between a context and an occurrence without being of either.
AROUND = r"""[\x20\x09-\x0D("'\[{<+]+$|^[\x20\x09-\x0D)"'\]}>]+"""
#: Characters around an occurrence in which its context is read.
REACH = 48
#: Characters of the longest identifier that can be discovered; longer strings are instances by their hash.
LONG = 64
#: Distinct instances, and whole beliefs among them, that a pattern needs; confidence from which it is accepted; rounds.
LEAST = 3
ACCEPT = 0.5
ROUNDS = 3
#: Deviations by which the confidence of each type of pattern is bounded: a word before, two words before, words around, and a word before that ends like a label.
STRICT = {"1": 1.96, "2": 1.0, "3": 1.0, "4": 1.0}
LABEL = "[:=#]$"


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def _before(lengths: Column) -> Column:
    """Running sums before each place, block by block."""

    def blocks(n: Column, width: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: F.slice(lengths, b * width + 1, width))
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
        inner = lambda b, top: F.transform(b, lambda _, j: top + total(F.slice(b, F.lit(1), j)))
        placed = lambda bs, sums: F.transform(bs, lambda b, i: _let(total(F.slice(sums, F.lit(1), i)), lambda top: inner(b, top)))
        return _let(cut, lambda bs: _let(F.transform(bs, total), lambda sums: F.flatten(placed(bs, sums))))

    return _let(F.size(lengths), lambda n: F.when(n == 0, F.array().cast("array<int>")).otherwise(_let(F.ceil(F.sqrt(n)).cast("int"), lambda w: blocks(n, w))))


def _found(text: Column, pattern: str, fields) -> Column:
    """A struct for each match, by fields(start, end, value, gap before, gap after)."""

    def each(m: Column, gaps: Column) -> Column:
        lengths = F.transform(m, lambda v, i: F.length(v) + F.length(gaps[i]))
        return _let(_before(lengths), lambda at: F.transform(m, lambda v, i: fields(at[i] + F.length(gaps[i]), at[i] + F.length(gaps[i]) + F.length(v), v, gaps[i], gaps[i + 1])))

    matched = lambda t: _let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda m: _let(F.split(t, pattern, -1), lambda gaps: each(m, gaps)))
    return _let(text, matched)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' weighted sum, every second from the right doubled, is a multiple of ten."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """(start, end) of each valid match, in code points, the end exclusive."""
    spans = _found(text, PATTERNS[kind], lambda a, b, v, *_: F.struct(a.alias("start"), b.alias("end"), v.alias("v")))
    checked = F.transform(F.filter(spans, lambda s: valid(kind, s["v"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(HINTS[kind]), checked).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def seed_kind(value: Column) -> Column:
    """The kind that a whole string is of, or null."""
    of = {k: value.rlike(rf"^(?:{PATTERNS[k]})$") & valid(k, value) for k in KINDS}
    return F.coalesce(*[F.when(test, F.lit(k)) for k, test in of.items()])


def _context(before: Column, after: Column) -> list[Column]:
    """The three patterns of an occurrence, or null: a type, and words in lower case with the marks between them and the occurrence, but for blanks, brackets and quotes around it."""
    tail, head = F.lower(F.substring(before, F.greatest(F.length(before) - (REACH - 1), F.lit(1)), F.lit(REACH))), F.lower(F.substring(after, 1, REACH))
    squeeze = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(c, AROUND, ""), r"[\x20\x09-\x0D]+", " "), F.lit(""))
    one = squeeze(F.regexp_extract(tail, r"(?<!\p{L})(\p{L}+[^\p{L}]*)$", 1))
    two = squeeze(F.regexp_extract(tail, r"(?<!\p{L})(\p{L}+[^\p{L}]+\p{L}+[^\p{L}]*)$", 1))
    right = squeeze(F.regexp_extract(head, r"^([^\p{L}]*\p{L}+)", 1))
    return [F.concat(F.when(one.rlike(LABEL), "4|").otherwise("1|"), one), F.concat(F.lit("2|"), two), F.concat(F.lit("3|"), one, F.lit("|"), right)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its number, id, base spans by kind, and occurrences with instance, seed kind, patterns, and whether they could be discovered."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    based = texts.select("row", "doc_id", "t", *[base_spans(F.col("t"), k).alias(k) for k in KINDS])

    def occurrence(a: Column, b: Column, v: Column, before: Column, after: Column) -> Column:
        patterns = F.filter(F.array(*_context(before, after)), lambda p: p.isNotNull())
        return F.struct(a.alias("start"), b.alias("end"), F.when(F.length(v) > LONG, F.sha2(v, 256)).otherwise(F.lower(v)).alias("instance"), seed_kind(v).alias("seed"), patterns.alias("patterns"))

    found = F.when(F.col("t").rlike("[0-9@]"), F.filter(_found(F.col("t"), SCAN, occurrence), lambda o: F.size(o["patterns"]) > 0))
    seen = based.select("row", "doc_id", *KINDS, F.concat(*KINDS).alias("spans"), found.alias("found"))
    clear = lambda o: ~F.exists("spans", lambda s: (s["start"] < o["end"]) & (o["start"] < s["end"]))
    # an identifier that could be discovered: 6 to LONG characters, three digits or an @, and no seed in it
    able = lambda o: o["seed"].isNull() & (o["end"] - o["start"]).between(6, LONG) & ((F.length(_digits(o["instance"])) >= 3) | o["instance"].contains("@")) & clear(o)
    marked = F.transform("found", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["instance"].alias("instance"), o["seed"].alias("seed"), o["patterns"].alias("patterns"), able(o).alias("able")))
    return stored(seen.select("row", "doc_id", *KINDS, marked.alias("found")), "scan")


def _bound(share: str, n: str) -> Column:
    """Lower Wilson bound of a share of n, by the pattern's type."""
    z = F.coalesce(*[F.when(F.substring("pattern", 1, 1) == t, F.lit(z)) for t, z in STRICT.items()])
    p, n = F.col(share), F.col(n)
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def learn(scanned: DataFrame, rounds: int = ROUNDS, least: int = LEAST, accept: float = ACCEPT) -> DataFrame:
    """The accepted patterns: (pattern, kind, confidence)."""
    rows = scanned.select(F.explode("found").alias("o")).select(F.explode("o.patterns").alias("pattern"), "o.instance", "o.seed", "o.able")
    edges = stored(rows.groupBy("pattern", "instance").agg(F.min("seed").alias("seed"), F.max("able").alias("able")), "edges")
    tally = edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("seed") == k, 1)).alias(k) for k in KINDS]).where(F.col("n") >= least)
    seeds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS])).alias("s")
    tally = stored(tally.where(sum(F.col(k) for k in KINDS) > 0).select("pattern", "n", seeds).select("pattern", "n", "s.kind", "s.seeds"), "tally")
    unseen = stored(edges.where("seed IS NULL AND able").join(tally.select("pattern").distinct(), "pattern", "left_semi").select("pattern", "instance"), "unseen")
    accepted, believed = None, None
    for _ in range(rounds):
        # beliefs are whole thousandths, so sums don't depend on their order
        sums = tally.withColumn("belief", 1000 * F.col("seeds"))
        if believed is not None:
            added = unseen.join(believed, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("added"))
            sums = sums.join(added, ["pattern", "kind"], "left").withColumn("belief", F.col("belief") + F.coalesce("added", F.lit(0))).drop("added")
        scored = sums.withColumn("share", F.col("belief") / (1000.0 * F.col("n"))).withColumn("confidence", _bound("share", "n"))
        accepted = stored(scored.where((F.col("belief") >= 1000 * least) & (F.col("confidence") >= accept)).select("pattern", "kind", "confidence"), "accepted")
        believed = unseen.join(accepted, "pattern").groupBy("instance", "kind").agg(F.max(F.floor(1000 * F.col("confidence")).cast("long")).alias("belief"))
    return accepted


def discovered(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(row, more): the spans of unseen identifiers, (place of the kind, start, end), of the rows that have any."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    open_ = scanned.select("row", F.explode("found").alias("o")).where("o.able").select("row", "o.start", "o.end", F.explode("o.patterns").alias("pattern"))
    best = open_.join(accepted, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-order).alias("place"))).alias("best"))
    return best.groupBy("row").agg(F.collect_list(F.struct((-F.col("best.place")).alias("place"), "start", "end")).alias("more"))


def find(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (place of the kind, start, end), base ones and all, in order; and n_<kind>, the base counts."""
    scanned = scan(docs, id_col, text_col)
    more = discovered(scanned, learn(scanned, rounds))
    placed = lambda i: lambda s: F.struct(F.lit(i).alias("place"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.concat(*[F.transform(k, placed(i)) for i, k in enumerate(KINDS)])
    all_ = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<place:int,start:int,end:int>>"))))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("row", "doc_id", *counts, base.alias("base")).join(more, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base", all_.alias("spans"))


def as_text(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["place"]], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of find()'s rows."""
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_discovered"))
