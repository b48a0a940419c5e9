"""Column functions on bases, qualities and CIGAR strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lineage import cut


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among A, C, G and T; null without any."""
    known = F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))
    return F.try_divide(F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")).cast("double"), known)


def mean_quality(qual: Column) -> Column:
    """Mean Phred quality of an ASCII quality string, averaged as probabilities; 0 for an empty one."""
    chars = F.filter(F.split(qual, ""), lambda c: c != "")
    total = F.aggregate(F.transform(chars, lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33).cast("double") / 10.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.length(qual) == 0, 0.0).otherwise(-10.0 * F.log10(F.try_divide(total, F.length(qual).cast("double"))))


def quality_unknown(qual: Column) -> Column:
    return qual.rlike("^!+$")


#: Bases that a task lays out at a time.
BLOCK_BASES = 1 << 22


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches by their rows' bases, with the code points of all their bases and the bounds of each row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + BLOCK_BASES, "right")))
            own = batch.slice(low, high - low)
            text = "".join(x or "" for x in own.column(column).to_pylist())
            yield own, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate(([0], ends[low:high] - before))
            low = high


def _runs(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal bases begin, and how long they are; a row's end ends a run."""
    fresh = np.ones(len(codes), bool)
    fresh[1:] = codes[1:] != codes[:-1]
    fresh[bounds[bounds < len(codes)]] = True
    begins = np.flatnonzero(fresh)
    return begins, np.diff(begins, append=len(codes))


def _kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different code points, and which of them each is."""
    seen = np.bincount(codes) > 0
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[codes]


def _letters(codes: np.ndarray) -> pa.Array:
    kinds, which = _kinds(codes)
    return pa.array([chr(c) for c in kinds], pa.string()).take(pa.array(which))


def homopolymer_runs(reads: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, pos, base, run_length) for every base: the length of the run of equal bases it belongs to. Runs are found where a read stands; nothing is shuffled."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, codes, bounds in _blocks(batches, "_seq"):
            _, lengths = _runs(codes, bounds)
            sizes = np.diff(bounds)
            rows = np.repeat(np.arange(own.num_rows), sizes)
            places = np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)
            yield pa.RecordBatch.from_arrays([own.column(key).take(pa.array(rows)), pa.array(places.astype(np.int32)), _letters(codes), pa.array(np.repeat(lengths, lengths))], [key, "pos", "base", "run_length"])

    held = reads.select(key, F.upper(seq).alias("_seq"))
    return held.mapInArrow(walk, StructType([held.schema[key], *StructType.fromDDL("pos int, base string, run_length long")]))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with a place and the count of each, for small numbers."""
    many = np.bincount(keys)
    place = np.zeros(len(many), np.int64)
    place[keys] = np.arange(len(keys))
    held = np.flatnonzero(many)
    return held, place[held], many[held]


def _chunk_runs(chunks: DataFrame, size: int, tallied: bool) -> DataFrame:
    """(contig, base, start0, end0, border, n): the runs inside chunks. The first and the last of a chunk are border rows; the others are one row each or, if tallied, one
    row for their n runs of one length from 0 on."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, codes, bounds in _blocks(batches, "bases"):
            begins, lengths = _runs(codes, bounds)
            firsts = np.searchsorted(begins, bounds[:-1])
            row = np.repeat(np.arange(own.num_rows), np.diff(firsts, append=len(begins)))
            border = np.zeros(len(begins), bool)
            border[firsts] = border[np.append(firsts[1:], len(begins)) - 1] = True
            base, contig = codes[begins], own.column("contig")
            kept, n = np.arange(len(begins)), np.ones(len(begins), np.int64)
            if tallied:
                coded, inner = contig.dictionary_encode(), np.flatnonzero(~border)
                name = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                kinds, which = _kinds(base)
                key = ((name[row] * len(kinds) + which) * (size + 1) + lengths)[inner]
                _, one, many = np.unique(key, return_index=True, return_counts=True) if key.max(initial=0) > 1 << 22 else _counted(key)
                kept = np.concatenate((np.flatnonzero(border), inner[one]))
                n = np.concatenate((n[border], many))
            row, base, lengths, border = row[kept], base[kept], lengths[kept], border[kept]
            low = np.where(border | (not tallied), begins[kept] - bounds[row] + own.column("at").to_numpy()[row], 0)
            yield pa.RecordBatch.from_arrays([contig.take(pa.array(row)), _letters(base), pa.array(low), pa.array(low + lengths), pa.array(border), pa.array(n)], ["contig", "base", "start0", "end0", "border", "n"])

    held = chunks.select("contig", (F.col("chunk") * size).cast("long").alias("at"), F.upper("bases").alias("bases")).filter(F.length("bases") > 0)
    return held.mapInArrow(walk, "contig string, base string, start0 long, end0 long, border boolean, n long")


def _joined_borders(rows: DataFrame) -> DataFrame:
    from ..operators.intervals import merge_intervals

    return merge_intervals(rows.filter("border").select("contig", "base", "start0", "end0"), ("contig", "base"))


def contig_runs(chunks: DataFrame, size: int = 4096) -> DataFrame:
    """(contig, base, start0, end0) of every maximal run of equal bases of chunks(contig, chunk, bases), each of `size` bases but a contig's last one.

    Runs are found inside chunks. The first and the last of a chunk may go on beyond it, so these, two rows a chunk at most, are merged where they touch, in ranges
    along the contig: a run over any number of chunks is one row, and no contig is one task.
    """
    rows = _chunk_runs(chunks, size, tallied=False)
    return rows.filter(~F.col("border")).select("contig", "base", "start0", "end0").unionByName(_joined_borders(rows))


def run_lengths(chunks: DataFrame, size: int = 4096) -> DataFrame:
    """(contig, base, length, n): how many runs of `contig_runs` have a length. Tasks count the runs inside their chunks, so what is written and shuffled is two rows a
    chunk and the counts."""
    rows = cut(_chunk_runs(chunks, size, tallied=True))
    whole = rows.filter(~F.col("border")).select("contig", "base", "start0", "end0", "n").unionByName(_joined_borders(rows).withColumn("n", F.lit(1).cast("long")))
    return whole.groupBy("contig", "base", (F.col("end0") - F.col("start0")).alias("length")).agg(F.sum("n").alias("n"))


def cigar_ops(alignments: DataFrame, key: str, cigar: str = "cigar") -> DataFrame:
    """(key, op_index, op, length, read_offset, ref_offset) for every operation of a CIGAR string."""
    parts = F.regexp_extract_all(F.col(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    ops = alignments.select(key, F.posexplode(parts).alias("op_index", "part"))
    op, length = F.substring("part", -1, 1), F.expr("cast(substring(part, 1, length(part) - 1) as bigint)")
    before = W.partitionBy(key).orderBy("op_index").rowsBetween(W.unboundedPreceding, -1)
    ops = ops.select(key, "op_index", op.alias("op"), length.alias("length"))

    def offset(kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("length")).otherwise(0)).over(before), F.lit(0)).cast("long")

    return ops.select(key, "op_index", "op", "length", offset("MIS=X").alias("read_offset"), offset("MDN=X").alias("ref_offset"))


def clipped_bases(cigar: Column) -> Column:
    """Soft- and hard-clipped bases of a CIGAR string."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+)[SH]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
