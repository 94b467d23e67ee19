"""A data source of JSON lines in files: spark.read.format("echo_lines"), readStream and write with it.

Reading cuts files in byte ranges, one a task; a range has the lines that begin in it. Only the fields of the schema that
is given are taken from a line, so a schema of two columns reads two. Values are texts, or JSON where a field is no text.
A stream's offset is how far each file was read; files may grow by whole lines. Writing is by tasks, each
to a file of its own beside the table, and a commit renames all of them; a task that fails, or a job that is aborted,
leaves no rows. Files are reached through Arrow's file systems (local, HDFS, S3 and GCS paths).

Blank lines are left out, null fields and missing ones are null, a malformed line is an error that names its file. An empty
folder has no rows. Options: ``path``, and ``split_bytes``, the size of a range (more in a table of
more than ``MOST_TASKS`` ranges).
"""

from __future__ import annotations

import itertools
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "echo_lines"
_PENDING = "_pending"
#: Tasks of a read at most: of larger tables the ranges grow, since a task of Python costs much before its first line.
MOST_TASKS = 512


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def files_of(path: str) -> dict[str, int]:
    """The files of a table, by name, with their sizes; hidden and pending ones are none of them."""
    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=False))
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "_."}


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``low`` on and before ``high``."""

    file: str
    low: int
    high: int


def ranges_of(file: str, low: int, high: int, split_bytes: int) -> list[Range]:
    return [Range(file, at, min(high, at + split_bytes)) for at in range(low, high, split_bytes)]


_BEYOND = 1 << 15


def lines_of(path: str, part: Range, chunk: int = 1 << 20) -> Iterator[bytes]:
    system, _ = file_system(path)
    with system.open_input_file(part.file) as f:
        at = part.low
        held = b""
        skip = at > 0
        if skip:  # a line that begins at the edge is this range's if the byte before ends one
            at -= 1
        f.seek(at)
        left = part.high - at
        while data := f.read(min(chunk, max(left, _BEYOND))):  # no chunk beyond the range for the rest of its last line
            left -= len(data)
            held += data
            *lines, held = held.split(b"\n")
            for line in lines:
                begin, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begin >= part.high:
                    return
                yield line
        if held and not skip and at < part.high:
            yield held


def row_of(line: bytes, names: list[str], file: str) -> tuple | None:
    if not line.strip():
        return None
    try:
        given = json.loads(line)
        values = [given.get(n) for n in names]
    except (ValueError, AttributeError) as e:
        raise ValueError(f"malformed line in {file}: {line[:80]!r}") from e
    return tuple(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values)


def rows_of(path: str, part: Range, schema: T.StructType) -> Iterator[tuple]:
    names = schema.fieldNames()
    for line in lines_of(path, part):
        row = row_of(line, names, part.file)
        if row is not None:
            yield row


def batches_of(rows: Iterator[tuple], schema: T.StructType, together: int = 128) -> Iterator[pa.RecordBatch]:
    """Rows of texts as Arrow batches, which pass to the JVM as they are."""
    names = schema.fieldNames()
    while some := list(itertools.islice(rows, together)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)] if names else [], names=names)


class LineReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int) -> None:
        self.path, self.schema, self.split_bytes = path, schema, split_bytes

    def partitions(self) -> list[Range]:
        files = files_of(self.path)
        split = max(self.split_bytes, -(-sum(files.values()) // MOST_TASKS))
        return [r for file, size in files.items() for r in ranges_of(file, 0, size, split)]

    def read(self, partition: Range) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if partition is None:
            return iter(())
        rows = rows_of(self.path, partition, self.schema)
        return batches_of(rows, self.schema) if all(isinstance(f.dataType, T.StringType) for f in self.schema) else rows


class LineStream(DataSourceStreamReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int) -> None:
        self.path, self.schema, self.split_bytes = path, schema, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return files_of(self.path)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, size in end.items() for r in ranges_of(file, start.get(file, 0), size, self.split_bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self.path, partition, self.schema)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LineWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.job = path, names, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return posixpath.join(root, f"{_PENDING}-{self.job}")

    def write(self, rows: Iterator) -> Written:
        system, root = file_system(self.path)
        system.create_dir(self._pending(root), recursive=True)
        file, n = posixpath.join(self._pending(root), f"part-{uuid.uuid4().hex}.jsonl"), 0
        with system.open_output_stream(file) as out:
            for row in rows:
                out.write(json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n")
                n += 1
        return Written(file, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for file in files_of(self.path):
                system.delete_file(file)
        for m in messages:
            if m is not None and m.rows:
                system.move(m.file, posixpath.join(root, posixpath.basename(m.file)))
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(root))


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "source string, prompt string, response string"

    def _at(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split_bytes", 64 << 20))

    def reader(self, schema: T.StructType) -> LineReader:
        path, split = self._at()
        return LineReader(path, schema, split)

    def streamReader(self, schema: T.StructType) -> LineStream:
        path, split = self._at()
        return LineStream(path, schema, split)

    def writer(self, schema: T.StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self._at()[0], schema.fieldNames(), overwrite)


def register_lines(spark: SparkSession) -> None:
    spark.dataSource.register(JsonLines)
