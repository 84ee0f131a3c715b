"""Token counts of flat, unindexed token files, by scanning for the separator.

A file is nothing but little-endian token ids, each document's followed by the end-of-document id. Files are
read in blocks of some MB, dealt over all tasks; each block is one vectorised search that yields the places of
its separators. A prefix scan over two numbers for each block of a file (the last separator before the block, and how many
there were) stitches documents that begin in one block and end in another, however many blocks lie between.

`write_flat` makes such files from documents; it keeps the order of their ids in a manifest beside them, which
the scan doesn't read. File names hold the task attempt, so a retried task never meets its own remains.

Defined cases: a null or empty text is a document of no tokens; tokens after a file's last separator are a
document with terminated = false; an empty file or folder has no documents; a size that isn't a whole number of
ids is an error. Separator ids can't come from a text: special tokens' names are encoded as ordinary text. A null
doc_id, and repeated rows, are documents like others; a very long text spans as many blocks as it takes; an empty
table has no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trivalent.llm.common import shared_dir, stored
from trivalent.llm.tokens import encoder

BLOCK_BYTES = 4 << 20
FILE_BYTES = 256 << 20
READERS = 20_000


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode docs into flat files; returns the stored manifest: file, nth, doc_id and the file's bytes per id."""
    folder = folder or shared_dir(docs.sparkSession, "flat")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, run = encoder(tokenizer, special_as_text=True), TaskContext.get(), uuid.uuid4().hex[:8]
        end = np.array([end_id], encode.dtype).tobytes()
        system, path = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, file, size, nth, number = None, "", 0, 0, 0
        for batch in batches:
            files, places = [], []
            for value in encode.encode(batch.column(1)):
                if out is None:
                    file, size, nth, number = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}-{run}.bin", 0, 0, number + 1
                    out = system.open_output_stream(f"{path}/{file}")
                out.write(value + end)
                files.append(file)
                places.append(nth)
                size, nth = size + len(value) + len(end), nth + 1
                if size >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), batch.column(0), pa.array([encode.dtype.itemsize] * len(files), pa.int32())], names=["file", "nth", "doc_id", "width"])
        if out is not None:
            out.close()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    manifest = stored(chosen.mapInArrow(write, "file string, nth long, doc_id long, width int"), "flat-manifest")
    return manifest.withColumn("file", F.concat(F.lit(f"{folder}/"), F.col("file")))


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """file and size of the token files in a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def scan(files: DataFrame, end_id: int, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, nth, start, n_tokens (without the separator) and terminated of every document of the files (file, size)."""
    block_bytes -= block_bytes % width
    whole = files.select("file", F.when(F.col("size") % width == 0, F.col("size")).otherwise(F.raise_error(F.concat(F.lit("not whole ids: "), "file"))).alias("size"))
    blocks = whole.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                system, path = pyarrow.fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                places = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end_id) + block * (block_bytes // width)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size]), pa.array([block]), pa.array([places], pa.list_(pa.int64()))], names=["file", "size", "block", "ends"])

    tasks = max(1, min(blocks.count(), READERS))  # a number that adaptive execution leaves alone, however small the table of blocks is
    found = stored(blocks.repartition(tasks).mapInArrow(search, "file string, size long, block long, ends array<bigint>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.try_element_at("ends", F.lit(-1)).alias("last"), F.size("ends").alias("n"))  # the prefix scan sees two numbers a block
    opened = summary.select(
        "file", "block", F.coalesce(F.max("last").over(before) + 1, F.lit(0).cast("long")).alias("open"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("count")
    )
    carried = found.join(opened, ["file", "block"])
    last = F.col("block") == F.floor((F.col("size") - 1) / block_bytes)
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("open"))
    ids = (F.col("size") / width).cast("long")
    ended = F.transform(
        "ends", lambda e, i: F.struct((F.col("count") + i).alias("nth"), F.when(i == 0, F.col("open")).otherwise(F.get("ends", i - 1) + 1).alias("start"), e.alias("stop"), F.lit(True).alias("terminated"))
    )
    rest = F.struct((F.col("count") + F.size("ends")).alias("nth"), tail.alias("start"), ids.alias("stop"), F.lit(False).alias("terminated"))
    each = carried.select("file", F.explode(F.when(last & (tail < ids), F.concat(ended, F.array(rest))).otherwise(ended)).alias("d"))
    return each.select("file", "d.nth", "d.start", (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), "d.terminated")


def counts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """doc_id and n_tokens of every row: flat files are written, scanned, and joined to the order of the ids."""
    manifest = write_flat(docs, tokenizer, end_id)
    spark = docs.sparkSession
    names = manifest.select("file").distinct()
    folder = shared_folder(manifest)
    if folder is None:
        return manifest.select("doc_id", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_tokens"), F.lit(True).alias("terminated"))
    files = files_in(spark, folder).withColumn("name", F.substring_index("file", "/", -1))
    named = names.select(F.substring_index("file", "/", -1).alias("name"), F.col("file").alias("full"))
    ours = files.join(named, "name").select(F.col("full").alias("file"), "size")
    return scan(ours, end_id, width).join(manifest, ["file", "nth"], "full").select("doc_id", "start", "n_tokens", "terminated")


def shared_folder(manifest: DataFrame) -> str | None:
    row = manifest.select(F.regexp_replace("file", "/[^/]*$", "")).limit(1).collect()
    return row[0][0] if row else None
