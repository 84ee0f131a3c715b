"""Sources and sinks: case files, checkpoints, inventories, canonical lines, merges and ledgers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivalent.functions.text import sha
from trivalent.operators.behavior import latest
from trivalent.sources import lines

TURN = "array<struct<id:string,role:string,origin:string,text:string>>"
CANONICAL = f"id string, label string, turns {TURN}, facets map<string,string>, text_sha256 string"


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, if the file's content has this hash."""
    found = lines.file_hashes(spark.createDataFrame([(path,)], "path string")).first()
    if found.sha256 != sha256:
        raise ValueError(f"{path} does not have the hash that is expected")
    return path


def read_cases(spark: SparkSession, path: str, kind: str, positive: list[str], negative: list[str], expected: int | None = None, sha256: str | None = None) -> DataFrame:
    """Cases of `canonical-jsonl`, `llmail-jsonl` or `notinject-json` files: case_id, label, positive, turns, facets, text_sha256.

    Fails on another hash or number of cases, and on any invalid case: no id, an unknown label, no turns or repeated ones, a repeated id, or a text hash that differs.
    """
    if sha256:
        pinned(spark, path, sha256)
    if kind == "canonical-jsonl":
        rows = spark.read.schema(CANONICAL).json(path)
    else:
        flat = "id string, label string, text string, technique string, category string, split string, source string, text_sha256 string"
        raw = spark.read.schema(flat).json(path) if kind == "llmail-jsonl" else spark.read.schema(f"cases array<struct<{flat.replace(' string', ':string')}>>").option("multiLine", True).json(path).select(F.inline("cases"))
        turn = F.array(F.struct(F.concat("id", F.lit("/source")).alias("id"), F.lit("document").alias("role"), F.lit("external").alias("origin"), "text"))
        facets = F.map_filter(F.create_map(*[x for k in ("technique", "category", "split", "source") for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
        rows = raw.select("id", "label", turn.alias("turns"), facets.alias("facets"), "text_sha256")
    cases = rows.select(
        F.col("id").alias("case_id"), "label", F.when(F.col("label").isin(*positive), True).when(F.col("label").isin(*negative), False).alias("positive"), "turns", "facets",
        F.col("text_sha256").alias("given"), sha(F.array_join("turns.text", "\n")).alias("text_sha256"),
    )
    bad = invalid_cases(cases).limit(1).collect()
    if bad:
        raise ValueError(f"invalid case {bad[0].case_id}: {bad[0].problem}")
    if expected is not None and cases.count() != expected:
        raise ValueError(f"{path} has not the {expected} cases that are expected")
    return cases.drop("given")


def invalid_cases(cases: DataFrame) -> DataFrame:
    """Rows that break a rule of cases, with the first rule that they break."""
    ids = F.col("turns.id")
    seen = F.count(F.lit(1)).over(Window.partitionBy("case_id"))
    problem = (
        F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "no id")
        .when(F.col("positive").isNull(), "label")
        .when(F.coalesce(F.size("turns"), F.lit(0)) < 1, "no turns")
        .when(F.exists("turns", lambda t: t["text"].isNull() | (F.coalesce(F.trim(t["id"]), F.lit("")) == "")), "turn")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated turn")
        .when(F.col("given").isNotNull() & (F.col("given") != F.col("text_sha256")), "text hash")
        .when(F.col("seen_") > 1, "repeated id")
    )
    return cases.withColumn("seen_", seen).withColumn("problem", problem).where("problem IS NOT NULL").select("case_id", "problem")


def read_events(spark: SparkSession, path: str, skip_bad: bool = False, size: int = lines.RANGE) -> DataFrame:
    """JSON events of checkpoint files, a line each: file, line, type and event (a variant). A file is read by a task for each `size` bytes.

    An unfinished last line, without its line end, is left out. A complete line that isn't JSON fails the read, or with skip_bad is left out too.
    """
    each = lines.read_lines(spark, path, size).where(F.col("ended") & (F.trim("text") != ""))
    parsed = each.select("file", "line", "text", F.try_parse_json("text").alias("event"))
    if skip_bad:
        parsed = parsed.where("event IS NOT NULL")
    else:
        parsed = parsed.withColumn("event", F.when(F.col("event").isNull(), F.raise_error(F.concat(F.lit("malformed line "), F.col("line").cast("string")))).otherwise(F.col("event")))
    return parsed.select("file", "line", F.try_variant_get("event", "$.type", "string").alias("type"), "event")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and sha256 of every file below a folder; files are hashed piece by piece, a task for each."""
    found = lines.listed(folder)
    return lines.file_hashes(spark.createDataFrame([(f,) for f in found], "path string").repartition(max(1, len(found)), "path"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """Compact JSON with fields and keys in name order at every depth, one line a row."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(F.to_json(F.struct(*[_by_name(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"}).alias("value"))


def _by_name(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of structs and the keys of maps in name order, all the way down."""
    if isinstance(kind, T.StructType):
        inner = [_by_name(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _by_name(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _by_name(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))
    return value


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The target with the newest row of each key."""
    both = target.withColumn("new_", F.lit(0)).unionByName(changes.withColumn("new_", F.lit(1)))
    return latest(both, keys, [F.desc(version), F.desc("new_")]).drop("new_")


def insert_missing(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(changes.dropDuplicates(keys).join(target, keys, "left_anti"))


def not_imported(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (area, path, sha256) is not in the ledger."""
    return files.join(ledger, ["area", "path", "sha256"], "left_anti")


def storable(text: Column) -> Column:
    """The text without NUL characters, bytes that are no UTF-8 replaced."""
    return F.replace(F.make_valid_utf8(text), F.lit("\0"), F.lit(""))


def unfence(text: Column) -> Column:
    """JSON from an answer that may stand in a code fence; null if it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*|\s*```$", ""))


#: Kinds of artifacts by their path, in order of precedence; `checkpoint` needs a first line that is a run's metadata. Fixed values.
KINDS = (
    ("source_provenance", r"^evals/private/sources/(.*/)?[^/]*-provenance\.json$"),
    ("source_dataset", r"^evals/private/sources/|^evals/datasets/.*\.jsonl$"),
    ("upstream_snapshot", r"^evals/private/upstream/"),
    ("other", r"^evals/reports/.*/runs/|^evals/reports/runs/|/runs/.*\.md$"),
    ("report", r"^evals/reports/|\.md$"),
    ("literature", r"/research-literature-"),
    ("checkpoint", r"[^/]\.jsonl$"),
    ("legacy_event_log", r"/migrated-(.*/)?observations\.jsonl$|/assistant-2026-09/.*\.jsonl$"),
    ("batch_ledger", r"(^|/)batch-ledger\.jsonl$"),
    ("budget_ledger", r"(^|/)armor-budget[^/]*\.jsonl$"),
    ("driver_log", r"(^|/)driver[^/]*\.ndjson$"),
    ("console_log", r"[^/]\.log$"),
    ("script", r"[^/]\.(ts|py|sh|jinja)$"),
    ("figure", r"[^/]\.(png|svg|pdf)$"),
    ("file_inventory", r"(^|/)(artifact-inventory|inventory-result)\.json$"),
    ("coverage_ledger", r"(^|/)research-coverage-ledger\.json$"),
    ("endpoint_snapshot", r"/model-endpoints-|(^|/)openrouter-models-[^/]*$"),
    ("lmstudio_inventory", r"lmstudio.*/inventory[^/]*\.json$|(^|/)inventory[^/]*lmstudio[^/]*\.json$"),
    ("key_snapshot", r"(^|/)[^/]*budget[^/]*\.json$"),
    ("analysis_snapshot", r"(^|/)[0-9a-f]{64}\.json$|snapshots(.*/)?[^/]*[0-9a-f]{12,}\.json$"),
    ("plan", r"(^|/)[^/]*plan[^/]*$"),
    ("summary", r"(^|/)[^/]*summary[^/]*$"),
    ("comparison", r"(^|/)[^/]*comparison[^/]*$"),
    ("audit", r"(^|/)[^/]*audit[^/]*$"),
    ("diagnostic", r"(^|/)[^/]*diagnostic[^/]*$"),
)
#: The schema of runs whose metadata opens a checkpoint: a fixed value.
RUN_SCHEMA = "security-eval-run/v1"


def artifact_kind(path: Column | str, first_line: Column | str | None = None) -> Column:
    """The first kind that a path, and for checkpoints its first line, fits."""
    path = F.col(path) if isinstance(path, str) else path
    line = F.lit(None).cast("string") if first_line is None else F.col(first_line) if isinstance(first_line, str) else first_line
    head = F.try_parse_json(line)
    read = lambda at: F.coalesce(F.try_variant_get(head, at, "string"), F.lit(""))
    opens = (read("$.type") == "metadata") & (read("$.value.schemaVersion") == RUN_SCHEMA) & (read("$.value.runId") != "")
    # extensions are told whatever their case, folders and names are not
    extension = F.regexp_extract(path, EXTENSION, 1)
    path = F.concat(F.left(path, F.length(path) - F.length(extension)), F.lower(extension))
    fits = [F.when(path.rlike(pattern) & (opens if kind == "checkpoint" else F.lit(True)), kind) for kind, pattern in KINDS]
    return F.coalesce(*fits, F.lit("other"))


#: A name's extension; a name that begins with its only dot has none.
EXTENSION = r"[^/]\.([^./]*)$"
#: Content types by extension; anything else is octets. Fixed values.
CONTENT_TYPES = {
    "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson", "md": "text/markdown", "txt": "text/plain", "log": "text/plain", "csv": "text/csv",
    "png": "image/png", "svg": "image/svg+xml", "pdf": "application/pdf", "ts": "text/plain", "py": "text/plain", "sh": "text/plain", "jinja": "text/plain",
}


def content_type(path: Column | str) -> Column:
    extension = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, EXTENSION, 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])[extension], F.lit("application/octet-stream"))


def read_csv(spark: SparkSession, path: str, text: str, positive: Column, case_id: str | None = None) -> DataFrame:
    """case_id, text and positive of CSV files with a header; fields may hold line ends and doubled quotes. Without an id column the id is the hash of the text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.select((F.col(case_id) if case_id else sha(F.col(text))).alias("case_id"), F.col(text).alias("text"), positive.alias("positive"))


def append_run(rows: DataFrame, folder: str, run_id: str) -> None:
    """Add the rows of a run to a checkpoint folder, partitioned by run; what is there stays."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(folder)


def unfinished(planned: DataFrame, done: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Planned segments that a run has not finished. A run resumes under exactly its own metadata: another value of an identity field, nulls compared too, is an error."""
    other = done.select(*identity).distinct().withColumn("n_", F.lit(1)).join(planned.select(*identity).distinct().withColumn("m_", F.lit(1)), on=[done[c].eqNullSafe(planned[c]) for c in identity], how="left_anti")
    if other.limit(1).count():
        raise ValueError("the checkpoint is of a run with other metadata")
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def report_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows as lines of a Markdown table, in order, below its head: a table of one column, value, to write as text."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.select(F.lit(2).alias("part_"), *[F.col(c).alias(f"{c}_by_") for c in order], line.alias("value"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, f"|{' --- |' * len(df.columns)}")], "part_ int, value string")
    return body.unionByName(head, allowMissingColumns=True).orderBy("part_", *[f"{c}_by_" for c in order], "value").select("value")


def write_report(df: DataFrame, folder: str, order: list[str]) -> None:
    """A report as lines of JSON in `folder`/json and as a Markdown table in `folder`/markdown, both in order by the names of their files."""
    df.orderBy(*order).write.json(f"{folder}/json", ignoreNullFields=False)
    report_lines(df, order).write.text(f"{folder}/markdown")


def file_sha(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
