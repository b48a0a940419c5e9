"""Sinks that write one file in the order of the rows' partitions.

Every task writes a part of its own next to the target; the driver's commit puts the parts of the tasks that counted together, in the order of their
partitions, and moves the result to its place. A failed task or job leaves nothing there. Formats must be joinable byte by byte, as members of gzip
files are.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

BUFFER = 1 << 20


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a path (local where it has no scheme) and the path inside it."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:/", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class OneFileWriter(DataSourceWriter):
    """Subclasses give the bytes before and after all parts and the bytes of rows."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.folder = options["path"], overwrite, f"{options['path']}.parts-{uuid.uuid4().hex}"
        files, name = place(self.path)
        if not overwrite and files.get_file_info(name).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")

    def head(self) -> bytes:
        return b""

    def tail(self) -> bytes:
        return b""

    def encoded(self, rows: Iterator) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Part:
        context, counted = TaskContext.get(), [0]
        files, folder = place(self.folder)
        files.create_dir(folder, recursive=True)
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"

        def counting() -> Iterator:
            for row in rows:
                counted[0] += 1
                yield row

        with files.open_output_stream(name) as out:
            for raw in self.encoded(counting()):
                out.write(raw)
        return Part(context.partitionId(), name, counted[0])

    def commit(self, messages: list[Part | None]) -> None:
        files, name = place(self.path)
        _, folder = place(self.folder)
        files.create_dir(folder, recursive=True)
        whole = f"{folder}/whole"
        with files.open_output_stream(whole) as out:
            out.write(self.head())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with files.open_input_stream(part.name) as own:
                    while raw := own.read(BUFFER):
                        out.write(raw)
            out.write(self.tail())
        files.move(whole, name)
        files.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = place(self.folder)
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            files.delete_dir(folder)


class GzipLines(DataSource):
    """`df.write.format("gzip_lines").option("header", text).save(path)`: the one string column of df as lines of one gzip file; every partition is a member
    of it, the header one before them."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return GzipLinesWriter(self.options, overwrite)


class GzipLinesWriter(OneFileWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.header = options.get("header", "")

    def head(self) -> bytes:
        return gzip.compress(self.header.encode(), mtime=0) if self.header else b""

    def encoded(self, rows: Iterator) -> Iterator[bytes]:
        held, size = [], 0
        for (value,) in rows:
            held.append(f"{value}\n".encode())
            size += len(held[-1])
            if size > BUFFER:
                yield gzip.compress(b"".join(held), mtime=0)
                held, size = [], 0
        if held:
            yield gzip.compress(b"".join(held), mtime=0)

    def tail(self) -> bytes:
        # A file without members is no gzip file.
        return gzip.compress(b"", mtime=0)


def write_lines(lines: DataFrame, order: list[str], path: str, header: str = "", value: str = "value") -> None:
    """lines(value, order...) as one gzip file in that order, whatever the number of rows: ranges of the order are sorted in tasks of their own."""
    lines.sparkSession.dataSource.register(GzipLines)
    lines.orderBy(*order).select(value).write.format("gzip_lines").option("header", header).mode("overwrite").save(path)
