"""Batch ledgers, late links, comparisons of runs, and runs seeded from another run's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.functions.text import col

#: Lines of a ledger that are looked at together; longer ledgers are many tasks.
BLOCK = 100_000


def last_at(df: DataFrame, keys: list[str], line: str, wanted: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The line number of the last wanted row of the same keys at or before each row, or null.

    By blocks of line numbers: a window inside each block, and the carry over from the blocks before in a window that sees one row a
    block. A ledger that holds most of all rows is thus sorted by many tasks. Line numbers are unique within the keys.
    """
    rows = df.withColumn("block_", F.floor(F.col(line) / block)).withColumn("here_", F.when(wanted, F.col(line)))
    inside = Window.partitionBy(*keys, "block_").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "block_").agg(F.max("here_").alias("end_"))
    earlier = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"{k}_k_") for k in keys], F.col("block_").alias("b_"), F.max("end_").over(earlier).alias("carry_"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_k_")) for k in keys] + [F.col("block_") == F.col("b_")]
    joined = rows.withColumn("own_", F.max("here_").over(inside)).join(carry, same, "left")
    return joined.withColumn(name, F.coalesce("own_", "carry_")).drop("block_", "here_", "own_", "b_", "carry_", *[f"{k}_k_" for k in keys])


def batches_and_cells(lines: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The batches of ledgers, and the cells that were worked on within each.

    lines: ledger, line, type, test, condition, and what else a line says. A batch goes from its batch_start to the next one; the last
    batch_finish within finishes it, and a batch without is unfinished. A cell is a condition_start; it is finished by the next line
    about the same test and condition in its batch if that is a condition_finish. A second start leaves the first open, and a finish
    without a start says nothing. A budget_stop is a cell of its own, never finished. Lines before the first batch are ignored.

    batches: ledger, start_line, finish_line. cells: ledger, start_line (the batch's), line, finish_line, budget_stopped, test, condition.
    """
    kept = lines.where(F.col("type").isin("batch_start", "batch_finish", "condition_start", "condition_finish", "budget_stop"))
    placed = last_at(kept, ["ledger"], "line", F.col("type") == "batch_start", "start_line", block).where("start_line IS NOT NULL")
    batches = placed.groupBy("ledger", "start_line").agg(F.max(F.when(F.col("type") == "batch_finish", F.col("line"))).alias("finish_line"))
    about = placed.where(F.col("type").isin("condition_start", "condition_finish"))
    following = Window.partitionBy("ledger", "start_line", "test", "condition").orderBy("line")
    ends = F.when(F.lead("type").over(following) == "condition_finish", F.lead("line").over(following))
    fields = ["ledger", "start_line", "line", "finish_line", "budget_stopped", "test", "condition"]
    cells = about.withColumn("finish_line", ends).where("type = 'condition_start'").withColumn("budget_stopped", F.lit(False)).select(*fields)
    stops = placed.where("type = 'budget_stop'").withColumns({"finish_line": F.lit(None).cast("long"), "budget_stopped": F.lit(True)})
    return batches, cells.unionByName(stops.select(*fields))


def resolve(rows: DataFrame, field: str, found: DataFrame, on: dict[str, str], value: str, other_than: str | None = None) -> DataFrame:
    """Fill a link that is null from rows that came later; a link that is there stays.

    on: columns of rows to columns of found, none of which match where null. Of several values found the least counts, so the link is
    the same however often it is made. With other_than, a column of rows, a row is never linked to that value of its own: found's two least
    values are enough to tell.
    """
    keys = list(on.values())
    each = found.select(*[F.col(k).alias(f"{k}_f_") for k in keys], F.col(value).alias("value_")).dropna().distinct()
    nth = F.row_number().over(Window.partitionBy(*[f"{k}_f_" for k in keys]).orderBy("value_"))
    two = each.withColumn("nth_", nth).where("nth_ <= 2").groupBy(*[f"{k}_f_" for k in keys]).agg(F.min("value_").alias("least_"), F.max("value_").alias("next_"))
    joined = rows.join(two, [F.col(a) == F.col(f"{b}_f_") for a, b in on.items()], "left")
    pick = F.col("least_")
    if other_than:
        own = F.col(other_than)
        pick = F.when(~F.col("least_").eqNullSafe(own), F.col("least_")).when(~F.col("next_").eqNullSafe(own), F.col("next_"))
    return joined.withColumn(field, F.coalesce(F.col(field), pick.cast(rows.schema[field].dataType))).drop("least_", "next_", *[f"{k}_f_" for k in keys])


def compare_runs(a: DataFrame, b: DataFrame, cohort: list[str]) -> DataFrame:
    """Flags of two runs over the same cases by class: both, a_only, b_only, neither. a, b: the cohort columns (dataset, revision), case_id, positive, flagged.

    Only cohorts that both runs have are compared. Of these every case must be in both, with one label and a verdict each: anything else
    fails the job when it runs, since counts over a part of a cohort look like counts over all of it.
    """
    keys = [*cohort, "case_id"]
    shared = a.select(*cohort).distinct().join(b.select(*cohort).distinct(), cohort)
    sides = [x.join(shared, cohort, "left_semi").select(*keys, F.struct("positive", "flagged", F.lit(1).alias("there")).alias(n)) for x, n in ((a, "a_"), (b, "b_"))]
    both = sides[0].join(sides[1], keys, "full")
    sound = F.col("a_.there").isNotNull() & F.col("b_.there").isNotNull() & (F.col("a_.positive") == F.col("b_.positive")) & F.col("a_.flagged").isNotNull() & F.col("b_.flagged").isNotNull()
    told = F.when(F.coalesce(sound, F.lit(False)), F.col("a_.positive")).otherwise(F.raise_error(F.concat(F.lit("paired cohort differs at case "), F.coalesce(F.col("case_id").cast("string"), F.lit("null")))).cast("boolean"))
    f, g = F.col("a_.flagged"), F.col("b_.flagged")
    counts = {"both": f & g, "a_only": f & ~g, "b_only": ~f & g, "neither": ~f & ~g}
    return both.withColumn("positive", told).groupBy(*cohort, "positive").agg(*[F.count_if(test).alias(n) for n, test in counts.items()])


def seeds(targets: DataFrame, source: DataFrame, configuration: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments of a new run that a whole-text run has answered already, and answers that would seed more than one.

    targets: run_id, case_id, segment_id, text_sha256, context_sha256, turn_ids, and the columns of the configuration. source: the same with line,
    request_id and what an answer holds; of a case's answers the last line counts. An answer fits a segment of the same case with exactly its input,
    turns and context, of another run with the same configuration; a missing context or configuration only fits a missing one, a
    missing input fits nothing.

    The first table has the segments with source_run_id, source_segment_id and source_request_id and the answer's other columns; the
    second the answers with the number of their segments. A run is seeded only if the second is empty: see `seeded`.
    """
    by = Window.partitionBy("run_id", "case_id").orderBy(F.desc("line"), F.desc("segment_id"))
    last = source.withColumn("nth_", F.row_number().over(by)).where("nth_ = 1").drop("nth_", "line")
    renamed = {c: f"{c}_s_" for c in ["case_id", "text_sha256", "context_sha256", "turn_ids", *configuration]} | {c: f"source_{c}" for c in ("run_id", "segment_id", "request_id")}
    last = last.withColumnsRenamed(renamed)
    same = [F.col("case_id") == F.col("case_id_s_"), F.col("text_sha256") == F.col("text_sha256_s_"), F.col("run_id") != F.col("source_run_id")]
    same += [F.col(c).eqNullSafe(F.col(f"{c}_s_")) for c in ["context_sha256", "turn_ids", *configuration]]
    met = targets.join(last, same).drop(*[c for c in renamed.values() if c.endswith("_s_")])
    answer = ["run_id", "source_run_id", "source_segment_id"]
    return met, met.groupBy(*answer).agg(F.count("*").alias("segments")).where("segments > 1")


def seeded(targets: DataFrame, source: DataFrame, configuration: list[str]) -> DataFrame:
    """The segments that can be seeded; an error if there are none, or if an answer would seed two."""
    met, twice = seeds(targets, source, configuration)
    if twice.limit(1).count():
        raise ValueError("one answer cannot seed several segments")
    if not met.limit(1).count():
        raise ValueError("no answer to the same whole input is there to be reused")
    return met


def suite_stem(path: Column | str) -> Column:
    """The name of a suite's file without folders and .json; null for null."""
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"\.json$", "")
