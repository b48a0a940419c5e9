"""The first reads of large FASTQ files, without reading on."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .onefile import place

#: Bytes that are asked of a file at a time, and reads of a batch.
STEP, BATCH = 1 << 16, 10_000


class FastqHead(DataSource):
    """`spark.read.format("fastq_head").option("reads", n).option("skip", k).load(path)`: reads k to k + n of every file of a list with commas. A file is read, and inflated,
    up to the last line asked for and STEP bytes beyond at most; files are read side by side."""

    @classmethod
    def name(cls) -> str:
        return "fastq_head"

    def schema(self) -> str:
        return "file string, place long, qname string, seq string, qual string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqHeadReader(self.options)


class FastqHeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.reads, self.skip = int(options["reads"]), int(options.get("skip", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, rows, record = partition.value, [], []
        if not self.reads:
            return
        for number, line in enumerate(lines(path)):
            if number < 4 * self.skip:
                continue
            record.append(line)
            if len(record) < 4:
                continue
            if not record[0] or not (record[1] or record[3]):  # the end of the records
                break
            at = number // 4
            rows.append((path, at, record[0][1:].split()[0] if record[0][1:].split() else "", record[1], record[3]))
            record = []
            if at + 1 == self.skip + self.reads:
                break
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["file", "place", "qname", "seq", "qual"])


def lines(path: str) -> Iterator[str]:
    """Lines of a plain or gzip file (of any number of members), as they are asked for."""
    files, name = place(path)
    rest = b""
    with files.open_input_file(name) as file:
        raw = file.read(STEP)
        packed = raw[:2] == b"\x1f\x8b"
        inflate = zlib.decompressobj(31) if packed else None
        while raw:
            text = raw
            if packed:
                text = b""
                while raw:
                    text += inflate.decompress(raw)
                    raw = inflate.unused_data if inflate.eof else b""
                    if inflate.eof:
                        inflate = zlib.decompressobj(31)
            *whole, rest = (rest + text).split(b"\n")
            yield from (x.decode().rstrip("\r") for x in whole)
            raw = file.read(STEP)
    if rest:
        yield rest.decode().rstrip("\r")


def first_of_files(spark: SparkSession, paths: list[str], reads: int, skip: int = 0) -> DataFrame:
    """(file, place, qname, seq, qual): reads number `skip` to `skip + reads` of every file."""
    spark.dataSource.register(FastqHead)
    return spark.read.format("fastq_head").option("reads", reads).option("skip", skip).load(",".join(paths))
