"""Array helpers used inside Arrow tasks: whole texts as byte arrays, word spans and rolling hashes.

A task walks an Arrow batch in blocks of a quarter of a megabyte (`text_blocks`), so that the temporary arrays
stay bounded whatever the batch holds; one text longer than a block forms a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..functions.lineage import trim

BLOCK_BYTES = 1 << 18
#: Rows of an Arrow batch with texts.
BATCH_ROWS = 1000
#: The white space of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bases of the two rolling hashes; where 64 bits are too few to tell all strings of a corpus apart, both are used.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a hash base and of its inverse modulo 2**64; those of a usual block are kept."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = max(n, BLOCK_BYTES + 4096)

        def table(base: int) -> np.ndarray:
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            return np.multiply.accumulate(factors)

        made = table(_BASES[which]), table(pow(_BASES[which], -1, 1 << 64))
        if size > 4 * BLOCK_BYTES:
            return made
        _tables[which] = made
    return tuple(x[:n] for x in _tables[which])


def prefix_hash(data: np.ndarray, which: int = 0) -> np.ndarray:
    """H with H[e] - H[s] a position-dependent hash of data[s:e]; see `span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data), which)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), the same wherever a string stands."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), which)[1][starts])


def unused(name: str, taken: list[str]) -> str:
    """A column name that no column has, whatever its capitals."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system, so that a reused Python worker does not keep the peak of its last task."""
    pa.default_memory_pool().release_unused()
    trim()


def small_batches(spark: SparkSession) -> None:
    """Rows with texts reach Python BATCH_ROWS at a time at most, so that no task holds thousands of texts twice, in the executor's
    Arrow buffers and in its Python worker. A session with smaller batches keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_blocks(column: pa.Array, target: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole texts with about `target` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = min(len(column), max(low + 1, int(np.searchsorted(offsets, offsets[low] + target, "right")) - 1))
        yield slice(low, high), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `solid` bytes (default: not white space) within each text,
    and the index of each text's first run (one entry more than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~WHITE[data] if solid is None else solid
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    other = np.zeros(len(data), bool)
    other[1:] = solid[:-1]
    other[edges] = False
    starts = np.flatnonzero(solid & ~other)
    other[:-1] = solid[1:]
    other[-1] = False
    other[edges - 1] = False
    ends = np.flatnonzero(solid & ~other) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the capitals of the two-byte Latin-1 letters (bytes C3 80-9E)."""
    low = fold_case(data)
    if len(low) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:] += second.astype(np.uint8) * np.uint8(32)
    return low


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def per_text(values: np.ndarray, first: np.ndarray, how=np.add, empty: float = 0.0) -> np.ndarray:
    """Reduce rows of `values` over the runs first[i]:first[i+1]; `empty` for a text without any."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = how.reduceat(values, first[:-1][full], axis=0)
    return out
