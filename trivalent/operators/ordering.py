"""Orders over whole tables: numbers, the first n, tranches of a run, and files in order, without a task that sees all rows.

Orders are lists of columns, `F.desc` and the like included. Rows that tie go by a hash of all their values; equal rows are
interchangeable. So a value that a third of all rows share is still dealt over many ranges. Nulls come where Spark puts them: first when
ascending. Empty tables give empty tables. Names ending in _ are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivalent.session import shared_dir

#: monotonically_increasing_id has a partition's number above these bits and the row's place in it below.
PLACE_BITS = 33


def _ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows in ranges of the order, one a task, each sorted."""
    tied = df.withColumn("tie_", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return tied.repartitionByRange(*order, "tie_").sortWithinPartitions(*order, "tie_").drop("tie_")


def numbered(df: DataFrame, order: list[Column | str], name: str = "nth") -> DataFrame:
    """Rows numbered 1, 2, 3 and so on: each range counts for itself, and a prefix sum over the ranges' sizes (a row a range) gives where it begins.

    The ranges are stored in between, since a range that a lost executor took along could be cut another way when it is made again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "numbered")
    at = F.monotonically_increasing_id()
    places = {"range_": F.shiftright(at, PLACE_BITS), "at_": at.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}
    _ranges(df, order).withColumns(places).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("before_"))
    return rows.join(F.broadcast(before), "range_").withColumn(name, F.col("before_") + F.col("at_") + 1).drop("range_", "at_", "before_", "n_")


def first(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of an order, however large n is."""
    if n < 1:
        raise ValueError("n must be positive")
    return numbered(df, order, "nth_").where(F.col("nth_") <= n).drop("nth_")


def write_ordered(df: DataFrame, folder: str, order: list[Column | str], n: int | None = None) -> None:
    """The rows, or the first n, as lines of JSON in order: by the names of the files, then by line."""
    (_ranges(df, order) if n is None else _ranges(first(df, order, n), order)).write.json(folder, ignoreNullFields=False)


def tranche(planned: DataFrame, done: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The next n planned rows, in order, that are not done. Unlike a limit on the cohort it leaves the plan whole."""
    return first(planned.join(done.select(*keys).distinct(), keys, "left_anti"), order, n)


def standing(planned: DataFrame, done: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """One row on how a run stands: expected, scored and abstained segments, and its status.

    `complete` is a run that scored everything; `finished_with_abstentions` one that has nothing left, yet no score for some; anything
    else is a `checkpointed_tranche`. Done rows that nobody planned count for nothing.
    """
    found = planned.select(*keys).distinct().join(done.groupBy(*keys).agg(F.max(F.col(outcome) == "scored").alias("ok_")), keys, "left")
    counts = found.agg(F.count("*").alias("expected"), F.count_if("ok_").alias("scored"), F.count_if(~F.col("ok_")).alias("abstained"))
    left = F.col("expected") - F.col("scored") - F.col("abstained")
    return counts.withColumn("status", F.when(left > 0, "checkpointed_tranche").when(F.col("abstained") > 0, "finished_with_abstentions").otherwise("complete"))
