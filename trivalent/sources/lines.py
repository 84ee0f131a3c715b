"""Lines of append-only files by ranges of bytes: a data source for batches and for streams of files that grow.

A file is cut into ranges; a task reads one and takes the lines that begin in it, to their ends. So a file of any size is
read by many tasks, and no row is larger than a line. A last line without its line end is unfinished: batches mark it,
streams leave it until it is whole. A stream's offset holds, for each file, how far it has been read and a hash of the
bytes before that place; a file that shrank or was written anew is an error, not a silent reread.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, of a read, and before an offset that its hash is of.
RANGE = 32 << 20
READ = 1 << 20
MARK = 1 << 12
SCHEMA = "file string, range long, nth long, at long, ended boolean, value binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


def listed(uri: str) -> dict[str, int]:
    """The files of a folder, at any depth, or a single file, with their sizes. Names that begin with . or _ are left out."""
    system, path = opened(uri)
    base = system.get_file_info(path)
    found = [base] if base.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    scheme = uri.split("/", 1)[0] + "//" if ":" in uri.split("/", 1)[0] else ""
    return {f"{scheme}{f.path}": f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at start or after and before stop; nothing from end on is read."""

    file: str
    start: int
    stop: int
    end: int
    first: int  # where lines certainly begin: the file's beginning, or where a stream has read to


def cut(file: str, first: int, end: int, size: int) -> list[Range]:
    return [Range(file, a, min(a + size, end), end, first) for a in range(first, end, size)]


def lines(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range as batches of about a read."""
    system, path = opened(part.file)
    names = ["file", "range", "nth", "at", "ended", "value"]

    def batch(found: list[bytes], at: int, nth: int, ended: bool) -> pa.RecordBatch:
        places, here = [], at
        for x in found:
            places.append(here)
            here += len(x) + 1
        columns = [pa.array([part.file] * len(found), pa.string()), pa.array([part.start] * len(found), pa.int64()), pa.array(range(nth, nth + len(found)), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array([ended] * len(found), pa.bool_()), pa.array(found, pa.binary())], names=names)

    with system.open_input_file(path) as f:
        at = part.start
        # a line begins here if the byte before ends one; else the first line end from there on ends another range's line
        seek = at if at == part.first else at - 1
        rest, nth, skipping, done = b"", 0, at != part.first, False
        while not done and seek < part.end:
            data = f.read_at(min(READ, part.end - seek), seek)
            if not data:
                break
            seek += len(data)
            if skipping:
                cut_at = data.find(b"\n")
                if cut_at < 0:
                    continue
                at, data, skipping = seek - len(data) + cut_at + 1, data[cut_at + 1 :], False
            *whole, rest = (rest + data).split(b"\n")
            keep, here = [], at
            for x in whole:
                if here >= part.stop:
                    done = True
                    break
                keep.append(x)
                here += len(x) + 1
            if keep:
                yield batch(keep, at, nth, True)
                nth, at = nth + len(keep), here
        if not done and not skipping and rest and at < part.stop:
            yield batch([rest], at, nth, False)


class _Batch(DataSourceReader):
    def __init__(self, files: dict[str, int], size: int) -> None:
        self.files, self.size = files, size

    def partitions(self) -> list[Range]:
        return [r for file, end in self.files.items() for r in cut(file, 0, end, self.size)] or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from lines(partition)


def _mark(file: str, at: int) -> str:
    """A hash of the bytes before a place of a file."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        return hashlib.sha256(f.read_at(min(at, MARK), max(0, at - MARK))).hexdigest()


def _last_end(file: str, least: int, size: int) -> int:
    """The place after the last line end between these places, or least."""
    system, path = opened(file)
    with system.open_input_file(path) as f:
        stop = size
        while stop > least:
            start = max(least, stop - READ)
            if (found := f.read_at(stop - start, start).rfind(b"\n")) >= 0:
                return start + found + 1
            stop = start
    return least


class _Stream(DataSourceStreamReader):
    """Offsets are {file: [bytes read, hash of what stands before]}."""

    def __init__(self, uri: str, size: int) -> None:
        self.uri, self.size = uri, size
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for file, size in listed(self.uri).items():
            read, mark = self.known.get(file, (0, None))
            self._same(file, size, read, mark)
            end = _last_end(file, read, size)
            if end:
                found[file] = [end, _mark(file, end)]
        self.known = found
        return found

    def _same(self, file: str, size: int, read: int, mark: str | None) -> None:
        if size < read or (mark and _mark(file, read) != mark):
            raise ValueError(f"{file} was written anew below the place that was read")

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for file, (read, mark) in start.items():
            if file in end:
                self._same(file, end[file][0], read, mark)
        return [r for file, (to, _) in end.items() for r in cut(file, start.get(file, [0])[0], to, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from lines(partition)

    def commit(self, end: dict) -> None:
        pass


class LineFiles(DataSource):
    """Options: path; range, bytes of a range; files, for batches, a listing that stays the same for several reads."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        files = json.loads(self.options["files"]) if "files" in self.options else listed(self.options["path"])
        return _Batch(files, int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("range", RANGE)))


def read_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, line (from 1), ended and text of every line, by as many tasks as there are ranges; numbers by a prefix sum over the ranges' counts.

    The files are listed once, so counts and lines are of the same bytes even where a file grows meanwhile.
    """
    spark.dataSource.register(LineFiles)
    rows = spark.read.format("line_files").option("files", json.dumps(listed(path))).option("range", str(size)).load()
    counts = rows.groupBy("file", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("file", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before_"))
    return rows.join(starts, ["file", "range"]).select("file", (F.col("before_") + F.col("nth") + 1).alias("line"), "ended", F.col("value").cast("string").alias("text"))


def follow(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """A stream of the whole lines of files that grow: file, at (the byte at which a line begins) and text."""
    spark.dataSource.register(LineFiles)
    rows = spark.readStream.format("line_files").option("path", path).option("range", str(size)).load()
    return rows.select("file", "at", F.col("value").cast("string").alias("text"))


def file_hashes(files: DataFrame, path: str = "path") -> DataFrame:
    """path, bytes and sha256 of each file, read in pieces by a task: no file is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, at = opened(uri)
                total, h = 0, hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while data := f.read(READ):
                        total += len(data)
                        h.update(data)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([total], pa.int64()), pa.array([h.hexdigest()])], names=["path", "bytes", "sha256"])

    return files.select(F.col(path).alias("path")).mapInArrow(run, "path string, bytes long, sha256 string")
