"""Research notes in markdown as tables: log entries, findings, evidence references.

A document is split to lines; a running count of headings groups them to blocks, so a window holds the lines of one
document, and what stands in a block is read by patterns over its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import col, trimmed

#: How headings, blocks, dates and references are written.
LOG_HEAD = r"^###\s+([RL]\d+[a-z]?)\s+[—–-]+\s+(.+)$"
SECTION = r"^##\s+(.+)$"
FINDING = r"^\*\*(O\d+[a-z]?):\s*(.*)$"
NUMBERED = r"^###\s+(\d+\.\d+)\s+(.+)$"
HEADING = r"^#{2,3}\s"
DATE = r"(20\d\d-\d\d-\d\d)"
MONTH = r"\b(September|October|November)\s+(\d{1,2})\b"
MONTHS = {"September": "2026-09-", "October": "2026-10-", "November": "2026-11-"}
STRENGTHS = r"(?i)\b(strong|moderate|suggestive|anecdotal)\b"
STATES = ("retracted", "superseded", "provisional")
LINK = r"\]\(([^)\s]+)\)"
QUOTED = r"`((?:\.\./)*(?:{root}/)?(?:runs|private)/[^`\s]+)`"
LOG_REF = r"\b([RL]\d{1,3})\b"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return docs.select(F.col(key), *more, F.posexplode(F.split(text, "\n")).alias("at", "line"))


def log_entries(docs: DataFrame, key: str = "path", text: str = "text", date: str = "document_date") -> DataFrame:
    """The entries of research logs: id, ordinal, title, dated (its own date, else its section's, else the document's), body."""
    line, order = F.col("line"), Window.partitionBy(key).orderBy("at")
    month = F.concat(F.coalesce(*[F.when(found(line, MONTH) == m, start) for m, start in MONTHS.items()]), F.lpad(found(line, MONTH, 2), 2, "0"))
    rows = _lines(docs, key, text, F.col(date).alias("document_date_")).withColumns({"section_": line.rlike(SECTION), "head_": line.rlike(LOG_HEAD)})
    rows = rows.withColumn("block_", F.sum((F.col("section_") | F.col("head_")).cast("int")).over(order))
    rows = rows.withColumn("date_", F.last(F.when(F.col("section_"), F.coalesce(found(line, DATE), month)), True).over(order))
    first = lambda c: F.max(F.when(F.col("head_"), c))
    blocks = rows.groupBy(key, "block_").agg(
        F.bool_or("head_").alias("head_"), first(found(line, LOG_HEAD)).alias("entry_id"), first(trimmed(found(line, LOG_HEAD, 2))).alias("title"),
        first(F.coalesce(found(found(line, LOG_HEAD, 2), DATE), F.col("date_"), F.col("document_date_").cast("string"))).alias("dated"), _body("head_").alias("body"),
    )
    return blocks.where("head_").select(key, "entry_id", _ordinal(key).alias("ordinal"), "title", "dated", "body")


def _body(head: str) -> Column:
    """The lines of a block but for its head, in order."""
    kept = F.array_sort(F.collect_list(F.when(~F.col(head), F.struct("at", "line"))))
    return trimmed(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def _ordinal(key: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy("block_")) - 1


def bullet(body: Column | str, labels: list[str]) -> Column:
    """What stands after the first bullet whose label begins with one of these, with its indented further lines; null without one."""
    label = rf"(?m)^-\s+(?i:{'|'.join(labels)})[A-Za-z -]*?:[ \t]*(.*(?:\n(?!\s*-\s+[A-Z][a-z -]+:)[ \t]{{2,}}\S.*)*)"
    return trimmed(F.regexp_replace(found(col(body), label), r"\n\s+", " "))


def findings(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """The findings of documents: id, section, title (which may run over lines, up to its closing asterisks), strength, caveats, follow-up, status, whether checked, body."""
    line, order = F.col("line"), Window.partitionBy(key).orderBy("at")
    rows = _lines(docs, key, text).withColumns({"head_": line.rlike(FINDING), "other_": line.rlike(HEADING)})
    rows = rows.withColumn("block_", F.sum((F.col("head_") | F.col("other_")).cast("int")).over(order))
    part = F.when(line.rlike(NUMBERED), F.struct(found(line, NUMBERED).alias("section"), trimmed(found(line, NUMBERED, 2)).alias("section_title")))
    no_part = F.when(line.rlike(r"^##\s"), F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("section_title")))
    rows = rows.withColumn("part_", F.last(F.coalesce(part, no_part), True).over(order))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy(key, "block_").agg(F.bool_or("head_").alias("head_"), whole.alias("whole_"), F.max("part_").alias("part_")).where("head_")
    c = F.col
    head = r"(?s)^\*\*(O\d+[a-z]?):\s*(.*?)(?:\*\*[^\n]*(?:\n(.*))?)?\z"
    blocks = blocks.select(key, "block_", "part_.*", F.regexp_extract("whole_", head, 1).alias("finding_id"), trimmed(F.regexp_replace(F.regexp_extract("whole_", head, 2), r"\s*\n\s*", " ")).alias("title"),
                           trimmed(F.regexp_extract("whole_", head, 3)).alias("inner_"), trimmed("whole_").alias("body"))
    blocks = blocks.withColumn("strength_note", bullet("inner_", ["strength"]))
    said = F.lower(F.concat_ws(" ", "title", F.coalesce("strength_note", F.lit(""))))
    return blocks.select(
        key, "finding_id", "section", "section_title", _ordinal(key).alias("ordinal"), "title", F.lower(found(c("strength_note"), STRENGTHS)).alias("strength"), "strength_note",
        bullet("inner_", ["caveat", "confound"]).alias("confounds"), bullet("inner_", ["follow-up", "follow up", "followup"]).alias("follow_up"),
        F.coalesce(*[F.when(F.contains(said, F.lit(s)), s) for s in STATES], F.lit("active")).alias("status"), F.coalesce(F.contains(found(c("inner_"), r"(?m)^(-\s+Evidence.*)$"), F.lit("✔")), F.lit(False)).alias("spot_checked"), "body",
    )


def repo_path(folder: Column | str, target: Column | str, root: str) -> Column:
    """The target as a path from the repository's top: from the folder, unless it begins at the root; `.`, `..` and empty parts are resolved."""
    t = col(target)
    parts = F.split(F.when(t.startswith(f"{root}/"), t).otherwise(F.concat_ws("/", col(folder), t)), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", up(done)).otherwise(F.array_append(done, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def evidence_refs(docs: DataFrame, key: str = "path", text: str = "text", folder: str = "folder", root: str = "evals") -> DataFrame:
    """(key, kind, value), each once: documents that a text links to, and paths of runs and private files in links or backticks."""
    pulled = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (LINK, QUOTED.format(root=root))])
    target = F.regexp_replace(F.regexp_replace(F.trim("raw_"), r"[#?].*$", ""), r"[),.;:]+$", "")
    rows = docs.select(key, folder, F.explode(pulled).alias("raw_")).withColumn("target_", target).where(r"target_ <> '' AND NOT target_ RLIKE '^https?:'")
    rows = rows.select(key, repo_path(folder, "target_", root).alias("value")).where(F.col("value").startswith(f"{root}/"))
    v = F.col("value")
    kind = F.when(v.endswith(".md") & ~F.contains(v, F.lit("/runs/")), "document").when(v.startswith(f"{root}/runs/") | v.startswith(f"{root}/private/"), "path")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "kind", "value").distinct()


def log_refs(text: Column | str) -> Column:
    """The ids of log entries that a text names, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(LOG_REF), F.lit(1)))
