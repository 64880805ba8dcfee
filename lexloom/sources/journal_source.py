"""Journals (one JSON text a line, only ever appended to) as a source of Spark, in batches and as a stream.

spark.dataSource.register(JournalSource); spark.read.format("journal").load(path). A file is read by ranges of bytes in as many
tasks, and a line belongs to the range in which it begins, so that one large journal is no large task. Only what is committed is
read: the bytes up to the last line break of the moment at which a read or a batch was planned; a torn line behind it comes once
its writer has ended it. A stream's offsets are the committed bytes of every file.

Options: path (a file or a folder, which is searched for files to its ground; names that begin with '.' or '_' are left out),
splitBytes. Paths are those of pyarrow.fs: local ones, and of stores that it opens (hdfs needs libhdfs, s3 and gs are built in).

Rows: path, split (number of the range in its file), nth (of the line in its range, from 0), at (the line's place in bytes), line
(UTF-8, wrong bytes replaced, without its line break or a carriage return before it). Empty lines are rows too; an empty or torn
file has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, split int, nth long, at long, line string"
SPLIT_BYTES = 32 << 20
#: Bytes that are read at a time, and lines of a batch.
CHUNK, LINES = 1 << 20, 8_192


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def files_below(path: str) -> dict[str, int]:
    """Files and their sizes."""
    from pyarrow import fs

    store, root = _filesystem(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return {prefix + root: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = re.compile(r"(^|/)[._][^/]*")
    return {prefix + f.path: f.size for f in found if f.type == fs.FileType.File and not hidden.search(f.path[len(root) :])}


def committed(path: str, size: int, floor: int = 0) -> int:
    """The bytes up to the last line break behind floor, which is itself committed."""
    store, root = _filesystem(path)
    with store.open_input_file(root) as f:
        end = size
        while end > floor:
            begin = max(floor, end - CHUNK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return floor


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from one byte to before another."""

    path: str
    split: int
    begin: int
    end: int
    #: Where the committed lines of this read begin: the byte before it is a line's end.
    origin: int = 0


def ranges(path: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(path, i, at, min(at + size, end), begin) for i, at in enumerate(range(begin, end, size))]


def read_range(r: Range, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    store, root = _filesystem(r.path)
    rows: list[tuple] = []
    nth = held = 0
    with store.open_input_file(root) as f:
        # a line that began in the range before is that one's
        at = r.begin if r.begin == r.origin else r.begin - 1
        first, rest = r.begin != r.origin, b""
        f.seek(at)
        while at < r.end:
            more = f.read(CHUNK)
            if not more:
                break
            # lines of a chunk are cut together; what is left over waits for the next chunk
            *whole, rest = (rest + more).split(b"\n")
            for line in whole:
                begun, at = at, at + len(line) + 1
                if first:
                    first = False
                    continue
                if begun >= r.end:
                    break
                rows.append((r.path, r.split, nth, begun, line.removesuffix(b"\r").decode("utf-8", "replace")))
                nth, held = nth + 1, held + len(line)
                if len(rows) >= LINES or held >= 4 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


class JournalReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Range]:
        return [r for p, n in sorted(files_below(self.path).items()) for r in ranges(p, 0, committed(p, n), self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Range):  # without any file there is a task without a range
            yield from read_range(partition, _arrow())


class JournalStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files_below(self.path).items():
            if size > self.known.get(path, 0):
                self.known[path] = committed(path, size, self.known.get(path, 0))
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**end, **self.known}
        return [r for p, n in sorted(end.items()) for r in ranges(p, start.get(p, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition, _arrow())


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(self.options)


def _arrow() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("split", pa.int32()), ("nth", pa.int64()), ("at", pa.int64()), ("line", pa.string())])


def read_journal(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(JournalSource)
    return spark.read.format("journal").options(**options).load(path)


def stream_journal(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(JournalSource)
    return spark.readStream.format("journal").options(**options).load(path)


def numbered(lines: DataFrame) -> DataFrame:
    """lines with line_no, from 1 in every file: what ranges before hold (a row for each range) and the place in its own."""
    held = lines.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return lines.join(base, ["path", "split"]).withColumn("line_no", F.col("_before") + F.col("nth") + 1).drop("_before")
