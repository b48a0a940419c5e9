"""BAM files: read in parts, sliced by an index, and written as one file.

A BAM file is a row of small compressed blocks, and records run on across them. A part of a file begins with the first block in its byte range and, inside
it, with the first place where a chain of sound records begins; it ends with the last record that begins in a block of the range. So parts of any size
give the same rows as the whole. A place in the file is a virtual offset: a block's place times 2**16 plus a place in what the block holds.

The index is a table: records are filed under the smallest bin that holds them (bins of 16 kb, each level eight times as wide), as runs of
virtual offsets, and every 16 kb window knows the first record that reaches into it. A slice reads only the runs of the bins that its windows touch.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from ..functions.sequence import reverse_complement
from ..operators.intervals import complete_pairs, near_windows
from .onefile import BUFFER, OneFileWriter, place

RECORD = "file_order long, qname string, flag int, rname string, pos1 long, mapq int, cigar string, seq string, qual string, nm int, split boolean, tlen int, end0 long, file string, voffset long, voffset_end long"
#: Bytes of one part of a file, records of a batch, and sound records in a row that prove a record's start.
SPLIT_BYTES, BATCH, CHAIN = 64 << 20, 4096, 16
#: Parts of a file beyond which small ones become larger, up to SPLIT_BYTES: a part costs a task, a header and a search, whatever its size.
PARTS = 64
#: Bits of a window, and levels of bins above the windows.
WINDOW_BITS, LEVELS = 14, 5
#: Fixed values of the format: a block's first bytes, the empty block at a file's end, the letters of bases and of CIGAR operations.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_HEX_BASES = str.maketrans("0123456789abcdef", BASES)
_QUALITY = bytes(min(q + 33, 126) for q in range(256))


# Blocks


def block_size(raw: bytes, at: int = 0) -> int | None:
    """Bytes of the block whose header stands at `at`; None where none does."""
    if raw[at : at + 4] != MAGIC or len(raw) < at + 18:
        return None
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    field = at + 12
    while field + 6 <= min(at + 12 + extra, len(raw)):
        size = struct.unpack_from("<H", raw, field + 2)[0]
        if raw[field : field + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", raw, field + 4)[0] + 1
        field += 4 + size
    return None


class Blocks:
    """Blocks of one open file, by their places."""

    def __init__(self, path: str):
        files, name = place(path)
        self.file = files.open_input_file(name)
        self.size, self.base, self.raw = self.file.size(), 0, b""

    def _bytes(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.raw):
            self.file.seek(at)
            self.base, self.raw = at, self.file.read(max(n, BUFFER))
        return self.raw[at - self.base : at - self.base + n]

    def at(self, offset: int) -> tuple[bytes, int] | None:
        """What the block at `offset` holds, and the next block's place; None at the end of the file."""
        if offset >= self.size:
            return None
        size = block_size(self._bytes(offset, 1 << 16))
        if size is None:
            raise ValueError(f"no block at {offset}")
        header = 12 + struct.unpack("<H", self._bytes(offset + 10, 2))[0]
        return zlib.decompress(self._bytes(offset, size)[header:-8], -15), offset + size

    def first(self, low: int, high: int) -> int | None:
        """The first block of [low, high): a header that the next block's header, or the end of the file, follows."""
        at = low
        while at < high:
            raw = self._bytes(at, BUFFER)
            found = raw.find(MAGIC)
            if found < 0:
                at += max(1, len(raw) - 3)
                continue
            at += found
            if at < high and (size := block_size(self._bytes(at, 1 << 16))) and (at + size == self.size or block_size(self._bytes(at + size, 1 << 16))):
                return at
            at += 1
        return None


class Text:
    """What blocks hold, from one block on, as one growing text with the blocks' places."""

    def __init__(self, blocks: Blocks, offset: int):
        self.blocks, self.next, self.text = blocks, offset, b""
        self.starts: list[tuple[int, int]] = []  # where in the text a block begins, and its place

    def reach(self, n: int) -> bool:
        """Have n bytes, if there are as many."""
        while len(self.text) < n:
            got = self.blocks.at(self.next)
            if got is None:
                return False
            self.starts.append((len(self.text), self.next))
            self.text += got[0]
            self.next = got[1]
        return True

    def drop(self, n: int) -> None:
        """Forget the first n bytes, and the blocks that end before them."""
        self.text = self.text[n:]
        self.starts = [(at - n, offset) for at, offset in self.starts]
        while len(self.starts) > 1 and self.starts[1][0] <= 0:
            self.starts.pop(0)

    def virtual(self, at: int) -> int:
        """The virtual offset of a place in the text; the end of a block is the start of the next."""
        for start, offset in reversed(self.starts):
            if start <= at:
                return self.next << 16 if at == len(self.text) else offset << 16 | at - start
        raise ValueError("a place before the text")


# Records


@dataclass
class Header:
    text: str
    names: list[str]
    lengths: list[int]
    first: int  # the virtual offset of the first record


def read_header(path: str) -> Header:
    text = Text(Blocks(path), 0)
    if not text.reach(12) or text.text[:4] != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    at = 8 + struct.unpack_from("<i", text.text, 4)[0]
    text.reach(at + 4)
    said = text.text[8:at].decode().rstrip("\0")
    names, lengths = [], []
    many = struct.unpack_from("<i", text.text, at)[0]
    at += 4
    for _ in range(many):
        text.reach(at + 4)
        size = struct.unpack_from("<i", text.text, at)[0]
        text.reach(at + 8 + size)
        names.append(text.text[at + 4 : at + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", text.text, at + 4 + size)[0])
        at += 8 + size
    text.reach(at + 1)
    return Header(said, names, lengths, text.virtual(at))


def sound_starts(raw: bytes, upto: int, lengths: np.ndarray) -> np.ndarray:
    """The places before `upto` where the fields of a record could stand."""
    n = min(upto, len(raw) - 36)
    if n <= 0:
        return np.zeros(0, np.int64)

    def field(kind: str, at: int) -> np.ndarray:
        return np.ndarray((n,), kind, raw, at, (1,))

    def somewhere(ref: np.ndarray, pos: np.ndarray) -> np.ndarray:
        known = (ref >= 0) & (ref < len(lengths))
        most = lengths[np.where(known, ref, 0)] if len(lengths) else np.zeros(n, np.int64)
        return (pos >= -1) & ((ref == -1) | (known & (pos <= most)))

    size, name, cigar, bases = field("<i4", 0).astype(np.int64), field("u1", 12).astype(np.int64), field("<u2", 16).astype(np.int64), field("<i4", 20).astype(np.int64)
    good = (size >= 34) & (size < 1 << 29) & (name >= 2) & (bases >= 0)
    good &= somewhere(field("<i4", 4), field("<i4", 8)) & somewhere(field("<i4", 24), field("<i4", 28))
    good &= 32 + name + 4 * cigar + (bases + 1) // 2 + bases <= size
    return np.flatnonzero(good)


def _named(raw: bytes, at: int) -> bool:
    name = raw[at + 36 : at + 36 + raw[at + 12]]
    return name[-1:] == b"\0" and all(33 <= c <= 126 for c in name[:-1])


def first_record(blocks: Blocks, low: int, high: int, lengths: np.ndarray) -> int | None:
    """The virtual offset of the first record that begins in a block of [low, high)."""
    offset = blocks.first(low, high)
    while offset is not None and offset < high:
        held, following = blocks.at(offset)
        text = Text(blocks, offset)
        text.reach(len(held) + (1 << 16))
        for at in sound_starts(text.text, len(held), lengths).tolist():
            if _chained(text, at, lengths):
                return offset << 16 | at
        offset = following
    return None


def _chained(text: Text, at: int, lengths: np.ndarray) -> bool:
    """Whether CHAIN sound records, or as many as there are, follow each other from `at` on."""
    for _ in range(CHAIN):
        if not text.reach(at + 36):
            return at == len(text.text)
        if not len(sound_starts(text.text[at : at + 37], 1, lengths)):
            return False
        if not text.reach(at + 36 + text.text[at + 12]) or not _named(text.text, at):
            return False
        at += 4 + struct.unpack_from("<i", text.text, at)[0]
        if not text.reach(at):
            return False
    return True


def records(blocks: Blocks, first: int, stop: int) -> Iterator[tuple[int, int, bytes]]:
    """(virtual offset, that of its end, bytes) of the records that begin at `first` and before `stop`."""
    text, at = Text(blocks, first >> 16), first & 0xFFFF
    while text.reach(at + 4):
        begin = text.virtual(at)
        if begin >= stop:
            return
        size = struct.unpack_from("<i", text.text, at)[0]
        if not text.reach(at + 4 + size):
            raise ValueError("the file ends inside a record")
        yield begin, text.virtual(at + 4 + size), text.text[at + 4 : at + 4 + size]
        at += 4 + size
        if at > BUFFER:
            text.drop(at)
            at = 0


_TAG_SIZE = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_TAG_CODE = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def _tags(raw: bytes) -> tuple[int | None, bool]:
    """The NM tag, and whether there is an SA tag."""
    nm, split, at = None, False, 0
    while at + 3 <= len(raw):
        tag, kind = raw[at : at + 2], chr(raw[at + 2])
        at += 3
        split |= tag == b"SA"
        if kind in "ZH":
            at = raw.index(0, at) + 1
        elif kind == "B":
            count = struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + count * _TAG_SIZE[chr(raw[at])]
        else:
            if tag == b"NM" and kind in _TAG_CODE:
                nm = struct.unpack_from(_TAG_CODE[kind], raw, at)[0]
            at += _TAG_SIZE[kind]
    return nm, split


def decode(raw: bytes, names: list[str]) -> tuple:
    """The fields of a record, from qname to end0."""
    ref, pos, name_len, mapq, _, n_cigar, flag, n_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + name_len
    operations = struct.unpack_from(f"<{n_cigar}I", raw, at)
    cigar = "".join([f"{v >> 4}{OPERATIONS[v & 15]}" for v in operations]) or "*"
    span = sum(v >> 4 for v in operations if v & 15 in (0, 2, 3, 7, 8))
    at += 4 * n_cigar
    seq = raw[at : at + (n_seq + 1) // 2].hex().translate(_HEX_BASES)[:n_seq] or "*"
    at += (n_seq + 1) // 2
    quals = raw[at : at + n_seq]
    qual = "*" if not quals or quals[0] == 255 else quals.translate(_QUALITY).decode("ascii")
    nm, split = _tags(raw[at + n_seq :])
    return raw[32 : 31 + name_len].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, qual, nm, split, tlen, pos + max(1, span)


class BamSource(DataSource):
    """`spark.read.format("bam").load(path)`: the records of BAM files (a path, several with commas, or a folder of them), each file in parts of `split_bytes`
    bytes, or of a multiple where those were too many (see `part_bytes`). With the option `chunks`, a JSON object of paths and lists of virtual ranges, only those are read. file_order rises with a record's place, whatever
    the parts. `df.write.format("bam").option("contigs", json).save(path)` writes one file, see `write_bam`."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), self.options.get("chunks"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BamWriter(self.options, schema.names, overwrite)


def bam_files(path: str) -> list[str]:
    out = []
    for own in (p.strip() for p in path.split(",")):
        files, name = place(own)
        if files.get_file_info(name).type == pafs.FileType.Directory:
            found = (x.path for x in files.get_file_info(pafs.FileSelector(name)) if x.path.endswith(".bam"))
            out += sorted(own[: own.find(name)] + x for x in found)
        else:
            out.append(own)
    return out


def part_bytes(size: int, split_bytes: int) -> int:
    """Bytes of a part of a file of that size: a multiple of split_bytes, the smallest that makes PARTS parts or fewer, but no more than SPLIT_BYTES."""
    return max(split_bytes, min(-(-size // (PARTS * split_bytes)) * split_bytes, SPLIT_BYTES))


class BamReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, chunks: str | None):
        self.paths, self.split_bytes, self.chunks = bam_files(path), max(1, split_bytes), json.loads(chunks) if chunks else None

    def partitions(self) -> list[InputPartition]:
        """(number, path, first, end, exact): byte ranges, or virtual ranges where exact."""
        if len(self.paths) >= 1 << 12:
            raise ValueError("more files than file_order can number")
        parts = []
        for number, path in enumerate(self.paths):
            if self.chunks is not None:
                parts += [InputPartition((number, path, low, high, True)) for low, high in self.chunks.get(path, [])]
                continue
            files, name = place(path)
            size = files.get_file_info(name).size
            parts += [InputPartition((number, path, low, min(size, low + step), False)) for step in [part_bytes(size, self.split_bytes)] for low in range(0, size, step)]
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        number, path, low, high, exact = partition.value
        header, blocks = read_header(path), Blocks(path)
        if blocks.size >= 1 << 40:
            raise ValueError("a file larger than file_order can number")
        if exact:
            first, stop = low, high
        elif low <= header.first >> 16 < high:
            first, stop = header.first, high << 16
        elif high <= header.first >> 16:
            return
        else:
            first, stop = first_record(blocks, low, high, np.array(header.lengths, np.int64)), high << 16
        if first is None:
            return
        rows = []
        for begin, end, raw in records(blocks, first, stop):
            # Records have 36 bytes at least, so a block's places divided by that tell its records apart.
            order = number << 51 | begin >> 16 << 11 | (begin & 0xFFFF) // 36
            rows.append((order, *decode(raw, header.names), path, begin, end))
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_FIELDS = [(n, _TYPES[k]) for n, k in (x.split() for x in RECORD.split(", "))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


# Writing


def compressed(raw: bytes) -> bytes:
    """One block of at most 65,280 bytes of content."""
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(raw) + packed.flush()
    return MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def in_blocks(pieces: Iterator[bytes], size: int = 65_280) -> Iterator[bytes]:
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield compressed(bytes(held[:size]))
            del held[:size]
    if held:
        yield compressed(bytes(held))


def encode(row: dict, numbers: dict[str, int]) -> bytes:
    """A record's bytes from qname, flag, rname, pos1, mapq, cigar, seq, qual and, where present, nm, sa and tlen."""
    name, cigar, seq, qual = row["qname"].encode() + b"\0", row["cigar"] or "*", row["seq"] or "*", row["qual"] or "*"
    operations, count = [], 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            count = 10 * count + int(c)
        else:
            operations.append(count << 4 | OPERATIONS.index(c))
            count = 0
    seq = "" if seq == "*" else seq
    codes = [BASES.index(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
    tags = b""
    if row.get("nm") is not None:
        tags += b"NMi" + struct.pack("<i", row["nm"])
    if row.get("sa"):
        tags += b"SAZ" + row["sa"].encode() + b"\0"
    start = row["pos1"] - 1
    span = sum(v >> 4 for v in operations if v & 15 in (0, 2, 3, 7, 8))
    fields = struct.pack("<iiBBHHHiiii", numbers.get(row["rname"], -1), start, len(name), row["mapq"], bin_of(start, start + max(1, span)), len(operations), row["flag"], len(seq), -1, -1, row.get("tlen") or 0)
    body = fields + name + struct.pack(f"<{len(operations)}I", *operations) + packed + quals + tags
    return struct.pack("<i", len(body)) + body


class BamWriter(OneFileWriter):
    def __init__(self, options: dict, names: list[str], overwrite: bool):
        super().__init__(options, overwrite)
        self.contigs, self.names = json.loads(options.get("contigs", "[]")), names
        self.block = int(options.get("block_bytes", 65_280))

    def head(self) -> bytes:
        text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in self.contigs)
        refs = [struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length) for name, length in self.contigs]
        raw = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs)) + b"".join(refs)
        return b"".join(in_blocks(iter([raw])))

    def encoded(self, rows: Iterator) -> Iterator[bytes]:
        numbers = {name: i for i, (name, _) in enumerate(self.contigs)}
        yield from in_blocks((encode(dict(zip(self.names, row, strict=True)), numbers) for row in rows), self.block)

    def tail(self) -> bytes:
        return END


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def write_bam(rows: DataFrame, contigs: list[tuple[str, int]], path: str, order: list[str], block_bytes: int = 65_280) -> None:
    """rows(qname, flag, rname, pos1, mapq, cigar, seq, qual[, nm, sa, tlen]) as one BAM file in that order; contigs are the header's names and lengths, and records
    elsewhere have no place. Parts of the file are written by the tasks."""
    register(rows.sparkSession)
    rows.orderBy(*order).write.format("bam").option("contigs", json.dumps(contigs)).option("block_bytes", block_bytes).mode("overwrite").save(path)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("bam").option("split_bytes", split_bytes).load(path)


def header_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of a file's header."""
    header = read_header(bam_files(path)[0])
    return spark.createDataFrame(list(zip(header.names, header.lengths, strict=True)), "name string, length long")


# Index


def _level(k: int) -> tuple[int, int]:
    """Bits of a bin of level k (0: the whole contig), and the number of its first bin."""
    return WINDOW_BITS + 3 * (LEVELS - k), ((1 << 3 * k) - 1) // 7


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end); 4680 for no place."""
    if start < 0:
        return 4680
    for k in range(LEVELS, 0, -1):
        bits, base = _level(k)
        if start >> bits == (end - 1) >> bits:
            return base + (start >> bits)
    return 0


def smallest_bin(start: Column, end: Column) -> Column:
    """As `bin_of`, for columns."""
    out = F.lit(0).cast("long")
    for k in range(1, LEVELS + 1):
        bits, base = _level(k)
        out = F.when(F.shiftright(start, bits) == F.shiftright(end - 1, bits), F.lit(base) + F.shiftright(start, bits)).otherwise(out)
    return out


def touched_bins(start: Column, end: Column) -> Column:
    """All bins that share a base with [start, end)."""

    def of_level(k: int) -> Column:
        bits, base = _level(k)
        return F.sequence(F.shiftright(start, bits) + base, F.shiftright(end - 1, bits) + base)

    return F.flatten(F.array(*map(of_level, range(LEVELS + 1))))


def build_index(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bins, windows) of coordinate-sorted records of `read_bam`. bins(file, contig, bin, beg, end): runs of virtual offsets, a run ending where the next record
    of its bin stands in a block that does not follow; windows(file, contig, window, beg): the first record that reaches into each 16 kb.

    Records are summed up by block before they are ordered, so a bin with a large share of all records is a row for every block.
    """
    placed = found.filter("rname <> '*' and pos1 > 0").select("file", F.col("rname").alias("contig"), (F.col("pos1") - 1).alias("start0"), "end0", "voffset", "voffset_end")
    own = placed.select("file", "contig", smallest_bin(F.col("start0"), F.col("end0")).alias("bin"), "voffset", "voffset_end")
    blocks = own.groupBy("file", "contig", "bin", F.shiftright("voffset", 16).alias("block")).agg(F.min("voffset").alias("beg"), F.max("voffset_end").alias("end"))
    order = W.partitionBy("file", "contig", "bin").orderBy("beg")
    fresh = F.coalesce((F.shiftright(F.lag("end").over(order), 16) < F.col("block")).cast("long"), F.lit(1))
    runs = blocks.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    bins = runs.groupBy("file", "contig", "bin", "run").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("run")
    reached = F.explode(F.sequence(F.shiftright("start0", WINDOW_BITS), F.shiftright(F.col("end0") - 1, WINDOW_BITS))).alias("window")
    windows = placed.select("file", "contig", reached, "voffset").groupBy("file", "contig", "window").agg(F.min("voffset").alias("beg"))
    return bins, windows


def chunks_for(wanted: DataFrame, bins: DataFrame, windows: DataFrame) -> DataFrame:
    """(file, beg, end): the runs that can hold records of wanted(contig, start0, end0): those of the touched bins that do not end before the first record that
    reaches into the wanted windows."""
    asked = wanted.filter("end0 > start0").select("contig", "start0", "end0").distinct()
    near = asked.select("*", F.explode(F.sequence(F.shiftright("start0", WINDOW_BITS), F.shiftright(F.col("end0") - 1, WINDOW_BITS))).alias("window"))
    least = near.join(windows, ["contig", "window"]).groupBy("contig", "start0", "end0", "file").agg(F.min("beg").alias("least"))
    touched = asked.select("*", F.explode(touched_bins(F.col("start0"), F.col("end0"))).alias("bin")).join(bins, ["contig", "bin"])
    kept = touched.join(least, ["contig", "start0", "end0", "file"]).filter(F.col("end") > F.col("least"))
    return kept.select("file", F.greatest("beg", "least").alias("beg"), "end").distinct()


def joined_ranges(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching ranges as one."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def translated(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted(contig, start0, end0) in the names of a header, see `names.name_table`; a contig that it lacks is an error."""
    found = wanted.join(names.withColumnRenamed("name", "contig"), "contig", "left")
    own = F.when(F.col("canonical").isNull(), F.raise_error(F.concat(F.lit("contig not in the header: "), "contig"))).otherwise(F.col("canonical"))
    return found.select(own.alias("contig"), "start0", "end0")


def slice_bam(spark: SparkSession, path: str, wanted: DataFrame, bins: DataFrame, windows: DataFrame) -> DataFrame:
    """Records of `read_bam`, without secondary and supplementary ones, that overlap wanted(contig, start0, end0) in the header's names; each once. Only the chunks
    that the index gives are read. Their list, a few for every wanted window, is gathered on the driver, as a scan's file list is."""
    register(spark)
    held: dict[str, list[tuple[int, int]]] = {}
    for r in chunks_for(wanted, bins, windows).toLocalIterator():
        held.setdefault(r.file, []).append((r.beg, r.end))
    chunks = json.dumps({file: joined_ranges(ranges) for file, ranges in held.items()})
    found = spark.read.format("bam").option("chunks", chunks).load(path).filter(F.col("flag").bitwiseAND(0x900) == 0)
    placed = found.withColumns({"contig": F.col("rname"), "start0": F.col("pos1") - 1})
    return near_windows(placed, wanted).drop("contig", "start0")


def as_sequenced(found: DataFrame, paired: bool) -> DataFrame:
    """(qname, mate, seq, qual) as they came from the sequencer: reverse-strand reads turned back, primary records only; if paired, only names with both mates."""
    turned = F.col("flag").bitwiseAND(0x10) != 0
    mate = F.when(F.col("flag").bitwiseAND(0x40) != 0, 1).when(F.col("flag").bitwiseAND(0x80) != 0, 2).otherwise(0)
    reads = found.filter(F.col("flag").bitwiseAND(0x900) == 0).select(
        "qname", mate.alias("mate"), F.when(turned, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turned, F.reverse("qual")).otherwise(F.col("qual")).alias("qual")
    )
    return complete_pairs(reads) if paired else reads
