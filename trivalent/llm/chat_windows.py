r"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `### <role>\n<text>\n</turn>\n`, the role percent-encoded and the text with a backslash
before each backslash, `#` and `<`; so neither a turn's head nor its end can stand inside a text, and removing
the backslashes restores it. A conversation whose turns don't fit one window is cut into spans at turn borders, by prefix sums
of the turns' tokens that begin anew where a turn would exceed its span's room: what the budget leaves beside the opening
system turn, and, but in the first span, the history. So spans are as full as turns allow. A sum runs over at most `RUN`
turns of a conversation and begins anew with the next, so the sizes that a turn is placed by are bounded in number. Each
window holds the opening system turn again, then the last turns of the span before it as far as they fit the history
budget and what its own span leaves, then its own span.
Loss lies on the texts of assistant turns in the window of their own span; repeated ones are masked. A turn is never
cut: a window exceeds its budget only where a single turn (with the system turn) does, and says so.

A turn's place in its conversation comes from its sort order (turn, then role and text for ties; null turns
first). Window functions over a conversation stream and spill; no list of its turns is built but for a
window, whose size the budget bounds, and for the digest that `read_back` feeds.

Defined cases: null texts and roles are empty; a null conv_id is a conversation like any other; repeated rows
are turns of their own; a very long text is one turn, over budget; an empty table gives no window; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "\n</turn>\n"
BUDGET, HISTORY = 512, 128
#: Turns of a conversation over which spans are cut together.
RUN = 1024
#: What counts as a token here: a run of letters, a digit, or a run of other signs.
TOKEN = r"[\p{L}\p{M}]+|\p{N}|[^\s\p{L}\p{M}\p{N}]+"
HEAD_TOKENS = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Each turn with its window, and again for each window that repeats it."""
    own = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + HEAD_TOKENS).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    nth = own.withColumn("nth", F.row_number().over(order)).withColumn("opens", (F.col("nth") == 1) & (F.col("role") == "system"))
    whole = Window.partitionBy("conv_id")
    body = F.when(F.col("opens"), F.lit(0).cast("long")).otherwise(F.col("tokens"))
    nth = nth.withColumn("body", body).withColumn("system", F.coalesce(F.max(F.when(F.col("opens"), F.col("tokens"))).over(whole), F.lit(0).cast("long")))
    nth = nth.withColumn("prefix", F.coalesce(F.sum("body").over(before), F.lit(0).cast("long")))
    # the sizes of the turns of a run up to this one; sums restart where the next would exceed the room
    run = Window.partitionBy("conv_id", "run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    nth = nth.withColumn("run", F.floor((F.col("nth") - 1) / RUN)).withColumn("sizes", F.collect_list("body").over(run))
    least = F.greatest(F.lit(budget - history) - F.col("system"), F.lit(1))
    first = F.when(F.col("run") == 0, F.lit(history)).otherwise(0)
    zero = F.lit(0).cast("long")

    def put(a: Column, size: Column) -> Column:
        more = (a["used"] > 0) & (a["used"] + size > least + F.when(a["span"] == 0, first).otherwise(0))
        return F.struct(F.when(more, size).otherwise(a["used"] + size).alias("used"), (a["span"] + more.cast("long")).alias("span"))

    nth = nth.withColumn("span", F.col("run") * 2 * RUN + F.aggregate("sizes", F.struct(zero.alias("used"), zero.alias("span")), put, lambda a: a["span"])).drop("sizes")
    nth = nth.withColumn("span", F.when(F.col("opens"), F.coalesce(F.lead("span").over(order), F.lit(0).cast("long"))).otherwise(F.col("span")))
    nth = nth.withColumn("window", F.sum(F.when(F.col("span") != F.lag("span", 1).over(order), 1).otherwise(0)).over(upto).cast("long"))
    each = Window.partitionBy("conv_id", "window")
    nth = nth.withColumn("last", F.max("window").over(whole)).withColumn("end", F.max(F.col("prefix") + F.col("body")).over(each)).withColumn("own", F.sum("body").over(each))
    nth = nth.withColumn("follows", F.when(F.lead("window").over(order) != F.col("window"), F.lead("own").over(order))).withColumn("follows", F.max("follows").over(each))
    room = F.least(F.lit(history), F.lit(budget) - F.col("system") - F.col("follows"))
    again = (F.col("window") < F.col("last")) & (F.col("end") - F.col("prefix") <= room) & ~F.col("opens")
    windows = F.when(F.col("opens"), F.sequence(F.lit(0).cast("long"), F.col("last"))).when(again, F.array("window", F.col("window") + 1)).otherwise(F.array("window"))
    return nth.select("conv_id", "nth", "role", "text", "tokens", "opens", F.col("window").alias("home"), F.explode(windows).alias("window"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, text, loss (start and length in code points, from 0), n_turns, n_repeated (they come first), n_tokens, over_budget."""
    if not 0 <= history < budget:
        raise ValueError("the history must be less than the budget")
    placed = _placed(turns, budget, history)
    head = F.concat(F.lit("### "), F.url_encode("role"), F.lit("\n"))
    fresh = F.col("home") == F.col("window")
    placed = placed.select("conv_id", "window", "nth", "tokens", "role", fresh.alias("fresh"), head.alias("head"), escape(F.col("text")).alias("body"))
    placed = placed.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id", "window").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")))
    counts = (F.col("role") == "assistant") & F.col("fresh")
    loss = F.when(counts, F.struct((F.col("at") + F.length("head")).cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    piece = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"))
    windows = placed.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "").alias("text"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
        F.count("*").alias("n_turns"),
        F.count(F.when(~F.col("fresh"), 1)).alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    )
    return windows.withColumn("over_budget", F.col("n_tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """From the formatted windows alone, one row a conversation: its turns in order, and all text under the loss, both unescaped."""
    pieces = F.slice(F.split("text", END, -1), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, r"(?s)\A### ([^\n]*)\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"\A### [^\n]*\n", "")).alias("text")
        ),
    )
    under = F.array_join(F.transform("loss", lambda s: unescape(F.substring("text", s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    each = windows.select("conv_id", F.struct("window", turns.alias("turns"), under.alias("under")).alias("w"), F.length("text").cast("long").alias("chars"), "over_budget")
    whole = each.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.count(F.when(F.col("over_budget"), 1)).alias("n_over_budget")
    )
    loss = F.array_join(F.transform("w", lambda x: x["under"]), "")
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), loss.alias("loss"), "formatted_chars", "n_windows", "n_over_budget")


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the windows, and how many windows there are and exceed the budget."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(windows).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over_budget",
    )


#: The same digests in DuckDB SQL, from the turns; formatted_chars repeats the windows' rules, spans are cut turn by turn.
SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
  len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{N}}|[^\s\p{{L}}\p{{M}}\p{{N}}]+')) + {HEAD_TOKENS} AS tokens FROM t),
b AS (SELECT *, nth = 1 AND role = 'system' AS opens, CASE WHEN nth = 1 AND role = 'system' THEN 0 ELSE tokens END AS body FROM n),
y AS (SELECT *, coalesce(max(CASE WHEN opens THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys FROM b),
p AS MATERIALIZED (SELECT *, (sum(body) OVER (PARTITION BY conv_id ORDER BY nth) - body)::BIGINT AS prefix, greatest({BUDGET - HISTORY} - sys, 1) AS room FROM y),
g AS (SELECT conv_id, nth, body::BIGINT AS used, 0 AS span FROM p WHERE nth = 1
  UNION ALL SELECT p.conv_id, p.nth, CASE WHEN fresh THEN p.body ELSE g.used + p.body END, g.span + fresh::INT
  FROM g JOIN p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.nth = g.nth + 1, LATERAL (SELECT g.nth % {RUN} = 0 OR (g.used > 0 AND g.used + p.body > p.room + CASE WHEN g.span = 0 THEN {HISTORY} ELSE 0 END) AS fresh)),
w0 AS (SELECT p.*, g.span AS spot FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.nth = g.nth),
s AS (SELECT *, CASE WHEN opens THEN coalesce(lead(spot) OVER (PARTITION BY conv_id ORDER BY nth), 0) ELSE spot END AS span FROM w0),
w AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) - 1 AS win, max(prefix + body) OVER (PARTITION BY conv_id, span) AS fin,
  sum(body) OVER (PARTITION BY conv_id, span) AS own FROM s),
x AS (SELECT *, lead(own) OVER (PARTITION BY conv_id ORDER BY nth) AS lo, lead(win) OVER (PARTITION BY conv_id ORDER BY nth) AS lw FROM w),
f AS (SELECT *, max(CASE WHEN lw <> win THEN lo END) OVER (PARTITION BY conv_id, win) AS follows, max(win) OVER (PARTITION BY conv_id) AS fin_win FROM x),
c AS (SELECT *, CASE WHEN opens THEN 1 + fin_win WHEN win < fin_win AND fin - prefix <= least({HISTORY}, {BUDGET} - sys - follows) THEN 2 ELSE 1 END AS times,
  length(role) + 5 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + {len(END)} AS chars FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(times * chars)::BIGINT AS formatted_chars,
  1 + max(win)::BIGINT AS n_windows, count(DISTINCT CASE WHEN sys + own > {BUDGET} THEN win END)::BIGINT AS n_over_budget
FROM c GROUP BY conv_id
"""
