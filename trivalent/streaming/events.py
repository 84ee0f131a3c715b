"""Structured Streaming over append-only event logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.session import shared_dir


def read_log(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream."""
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, name = path.rstrip("/").rsplit("/", 1)
    if [f.rstrip("/").rsplit("/", 1)[1] for f in rows.inputFiles()] == [name]:  # a stream can't be of one file
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def first_of(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key; the state of a key is dropped once the watermark has passed it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def first_ever(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key, however late another comes: the state holds every key and grows with their number. For keys without end, first_of."""
    return events.dropDuplicates(keys)


def fold_requests(events: DataFrame, request: str, attempt: str, at: str) -> DataFrame:
    """Requests as they stand: attempts, first and last event."""
    return events.groupBy(request).agg(F.max(attempt).alias("attempts"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("events"))


def stored(rows: DataFrame, name: str) -> str:
    """The path of the rows as Parquet in the shared folder."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return path


def stored_lines(rows: DataFrame, name: str) -> str:
    """The path of the rows' one column as text files in the shared folder."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.text(path)
    return path


def drain(stream: DataFrame, mode: str = "append", resume: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, as Parquet in the shared folder.

    Each call has a folder and a checkpoint of its own; given `resume`, a folder, a later call goes on where the last one ended.
    Streams append, or are complete: then each batch is the whole result. What an updating stream writes is a change to an
    earlier result, so it is refused here; `merged` takes it, by key.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"the batches of a stream in mode {mode} are no result by themselves")
    spark = stream.sparkSession
    root = resume or shared_dir(spark, "stream")
    started = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        started = started.format("parquet").option("path", f"{root}/rows").start()
    else:
        started = started.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def merged(stream: DataFrame, keys: list[str], folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a folder that later calls go on with, and return its rows, the newest of each key.

    A batch is written under its number, in place of what an interrupted run left of it, so no batch counts twice or in
    part; of the rows of a key that of the last batch counts, which makes updates and rereads idempotent.
    """
    spark = stream.sparkSession
    path = f"{folder}/rows"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode(mode).foreachBatch(write).start().awaitTermination()
    schema = stream.schema.add("batch", "long")
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no batch was written yet
        rows = spark.createDataFrame([], schema)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("row_"))
    return newest.select("row_.*").drop("batch")
