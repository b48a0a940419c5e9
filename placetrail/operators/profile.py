"""Error profiles: counts learned from alignments, rates derived from them, refinement and comparison.

A profile is one long table (kind, mate, a, b, c, n): `a`, `b` and `c` are the cell's coordinates. Tasks count the bases of
their alignments into such cells, so only cells are shuffled.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .statistics import max_gap, pearson, total_variation

# Limits of the model.
MOST_QUALITY, CYCLES, QUARTERS, RUNS, INDEL = 94, 400, 4, 10, 50
PSEUDO = 500.0
_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i

CELLS = "kind string, mate int, a int, b int, c int, n long"


#: Bases of reads and references that a task lays out at a time.
BLOCK_BASES = 1 << 20
#: Blocks whose cells are added up at a time, cells that a task holds before it sends them on, and the number of possible cells up to which each has a place.
MERGE, HELD, DENSE = 16, 1 << 20, 1 << 16


def spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of so many numbers for every run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - ends + sizes, sizes)


def sums_before(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Within rows values[bounds[i] : bounds[i + 1]], the sum of the values before each."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[:-1] - np.repeat(total[bounds[:-1]], np.diff(bounds))


def run_lengths(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every base, the length of the run of equal bases around it in its own row."""
    if not len(codes):
        return codes
    fresh = np.concatenate(([True], codes[1:] != codes[:-1]))
    fresh[bounds[bounds < len(codes)]] = True
    number = np.cumsum(fresh) - 1
    return np.bincount(number)[number]


def usable(alignments: DataFrame, least_mapq: int = 20) -> DataFrame:
    return alignments.filter((F.col("flag").bitwiseAND(0x904) == 0) & (F.col("mapq") >= least_mapq) & (F.col("seq") != "*"))


def first_of_mate(alignments: DataFrame, most: int) -> DataFrame:
    """The first `most` alignments of each mate in file order. Places are counted in ranges of the order and shifted by range
    totals, so no task orders a whole mate."""
    block = F.col("file_order").bitwiseAND(~0xFFFF)
    totals = alignments.groupBy("mate", block.alias("block_")).agg(F.count(F.lit(1)).alias("n_"))
    before = W.partitionBy("mate").orderBy("block_").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.withColumn("shift_", F.coalesce(F.sum("n_").over(before), F.lit(0))).filter(F.col("shift_") < most).drop("n_")
    place = F.row_number().over(W.partitionBy("mate", "block_").orderBy("file_order")) + F.col("shift_")
    return alignments.withColumn("block_", block).join(shifts, ["mate", "block_"]).withColumn("place_", place).filter(F.col("place_") <= most).drop("block_", "shift_", "place_")


def count_cells(alignments: DataFrame, kind: str = "short", masked: DataFrame | None = None) -> DataFrame:
    """Cells of alignments(mate, reverse, contig, start0, cigar, seq, qual, ref[, proper, tlen]); `ref` holds the reference bases of the span and
    `masked`(contig, pos) positions to leave out. Long reads with fewer than 200 columns are left out. The cells are
    written once, as a comparison reads them a dozen times."""
    rows = alignments
    if masked is not None:
        from .intervals import overlap_join

        # One place beyond the span, where a last insertion stands.
        rows = rows.withColumn("end0", F.col("start0") + F.length("ref") + 1)
        spans = rows.select("contig", "start0", "end0").distinct()
        hits = overlap_join(spans, masked.select("contig", F.col("pos").alias("r_start"), (F.col("pos") + 1).alias("r_end")))
        rows = rows.join(hits.groupBy("contig", "start0", "end0").agg(F.collect_set("r_start").alias("hidden")), ["contig", "start0", "end0"], "left")
    else:
        rows = rows.withColumn("hidden", F.lit(None).cast("array<long>"))
    absent = {"proper": F.lit(False), "tlen": F.lit(0)}
    rows = rows.select(
        F.col("mate").cast("int").alias("mate"), "reverse", F.col("start0").cast("long").alias("start0"), "seq", "qual", "ref", "hidden",
        *[(F.coalesce(F.col(c), v) if c in rows.columns else v).alias(c) for c, v in absent.items()],
        F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)).cast("array<long>").alias("sizes"),
        F.array_join(F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)), "").alias("operations"),
    )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, blocks = Counts(), 0
        for batch in batches:
            bases = np.cumsum(pc.binary_length(batch.column("seq")).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(batch.column("ref")).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(bases, (bases[low - 1] if low else 0) + BLOCK_BASES, "right")))
                _tally(batch.slice(low, high - low), kind, counts)
                blocks += 1
                if blocks % MERGE == 0 and counts.merge() > HELD:
                    yield from counts.batches()
                    counts = Counts()
                low = high
        yield from counts.batches()

    return cut(rows.mapInArrow(tally, CELLS).groupBy("kind", "mate", "a", "b", "c").agg(F.sum("n").alias("n")))


#: Cells by kind: cycle (cycle, mismatch), quality (quarter, quality, mismatch), transition (cycle, former, quality), first (quality), length (bases),
#: substitution (true, called), insertion and deletion (length), run (length of the run around a base), run_insertion, run_deletion,
#: fragment (length), error (errors, columns of a read), read (bases of a long read).
KINDS = ["cycle", "quality", "transition", "first", "length", "substitution", "insertion", "deletion", "run", "run_insertion", "run_deletion", "fragment", "error", "read"]


def grouped(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of equal rows of columns, or the sums of n."""
    # One number for a cell; its parts are small, and so is their product.
    widths = [int(x.max()) + 1 for x in columns]
    key = columns[0]
    for x, width in zip(columns[1:], widths[1:], strict=True):
        key = key * width + x
    most = math.prod(widths)
    if most <= max(DENSE, 4 * len(key)) and key.min() >= 0 and (n is None or n.sum() < 1 << 53):  # counted in place, not sorted
        sums = np.bincount(key, n, most).astype(np.int64)
        cells = np.flatnonzero(sums)
        sums = sums[cells]
    elif n is None:
        cells, sums = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) > 0)))
        cells, sums = key[order][first], np.add.reduceat(n[order], first)
    parts = []
    for width in reversed(widths[1:]):
        cells, part = np.divmod(cells, width)
        parts.append(part)
    return np.stack([cells, *reversed(parts)]), sums


class Counts:
    """Cells of the blocks of a task, kind by kind."""

    def __init__(self) -> None:
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, kind: str, mate, a, b=0, c=0) -> None:
        columns = [np.asarray(x, np.int64) for x in np.broadcast_arrays(mate, a, b, c)]
        if not columns[1].size:
            return
        self.found.setdefault(kind, []).append(grouped(columns))

    def merge(self) -> int:
        """Add up what blocks have found; the number of cells held."""
        for kind, own in self.found.items():
            if len(own) > 1:
                self.found[kind] = [grouped([np.concatenate(x) for x in zip(*(cells for cells, _ in own), strict=True)], np.concatenate([n for _, n in own]))]
        return sum(len(n) for own in self.found.values() for _, n in own)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for kind, [(cells, n)] in self.found.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), *(pa.array(x.astype(np.int32)) for x in cells), pa.array(n)], ["kind", "mate", "a", "b", "c", "n"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, and the bounds of each."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _tally(batch: pa.RecordBatch, kind: str, counts: Counts) -> None:
    """Count the cells of a block of alignments: all CIGARs are laid out at once, every aligned base with its row and its offsets."""
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    many = batch.num_rows
    mate, reverse, start0 = number("mate").astype(np.int64), number("reverse").astype(bool), number("start0")
    seq, seq_at = _bytes(batch.column("seq"))
    ref, ref_at = _bytes(batch.column("ref"))
    qual, qual_at = _bytes(batch.column("qual"))
    seq, ref = _CODE[seq], _CODE[ref]
    length, span = np.diff(seq_at), np.diff(ref_at)
    letters, op_at = _bytes(batch.column("operations"))
    sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = lambda ops: np.isin(letters, np.frombuffer(ops, np.uint8))
    row = np.repeat(np.arange(many), np.diff(op_at))
    read_off, ref_off = sums_before(sizes * of(b"MIS=X"), op_at), sums_before(sizes * of(b"MDN=X"), op_at)

    hidden = batch.column("hidden")
    wide = np.int64(span.max(initial=0) + 2)
    listed = pc.list_parent_indices(hidden).to_numpy().astype(np.int64)
    inside = hidden.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - start0[listed]
    fits = (inside >= 0) & (inside < wide)
    masked = listed[fits] * wide + inside[fits]
    shown = lambda rows, places: ~np.isin(rows * wide + places, masked)

    def events(op: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, reference offset, size) of the indels that count."""
        kept = np.flatnonzero(of(op) & (sizes <= INDEL) & (sizes > 0))
        kept = kept[shown(row[kept], ref_off[kept])]
        return row[kept], ref_off[kept], sizes[kept]

    aligned = of(b"M=X")
    owner = np.repeat(row[aligned], sizes[aligned])
    at, to = spread(read_off[aligned], sizes[aligned]), spread(ref_off[aligned], sizes[aligned])
    true, called = ref[ref_at[owner] + to], seq[seq_at[owner] + at]
    keep = shown(owner, to) & (true < 4) & (called < 4)
    owner, at, true, called = owner[keep], at[keep], true[keep], called[keep]
    wrong = true != called
    inserted, deleted = events(b"I"), events(b"D")
    if kind == "short":
        good = (length > 0) & (length <= CYCLES) & (np.diff(qual_at) == length)
    else:
        columns = np.bincount(owner, minlength=many) + sum(np.bincount(rows, size, many).astype(np.int64) for rows, _, size in (inserted, deleted))
        good = columns >= 200
    here = good[owner]
    owner, at, true, called, wrong = owner[here], at[here], true[here], called[here], wrong[here]
    inserted, deleted = (tuple(x[good[own[0]]] for x in own) for own in (inserted, deleted))
    if kind == "short":
        cycle = np.where(reverse[owner], length[owner] - 1 - at, at)
        quality = np.minimum(qual.astype(np.int64) - 33, MOST_QUALITY - 1)
        counts.add("cycle", mate[owner], cycle, wrong)
        counts.add("quality", mate[owner], cycle * QUARTERS // length[owner], quality[qual_at[owner] + at], wrong)
        rows = np.flatnonzero(good)
        size, place = length[rows], spread(np.zeros(len(rows), np.int64), length[rows])
        rows = np.repeat(rows, size)
        own = quality[qual_at[rows] + np.where(reverse[rows], length[rows] - 1 - place, place)]
        later = place > 0
        counts.add("first", mate[rows[~later]], own[~later])
        counts.add("transition", mate[rows[later]], place[later], own[np.flatnonzero(later) - 1], own[later])
        counts.add("length", mate[good], length[good])
        paired = good & number("proper").astype(bool) & (mate == 0) & (number("tlen") != 0)
        counts.add("fragment", 0, np.abs(number("tlen")[paired].astype(np.int64)))
    else:
        errors = np.bincount(owner, wrong, many).astype(np.int64) + columns - np.bincount(owner, minlength=many)
        counts.add("error", 0, errors[good], columns[good])
        counts.add("read", 0, length[good])
        runs = np.minimum(run_lengths(ref, ref_at), RUNS)
        counts.add("run", 0, runs[np.repeat(good, span)])
        near = lambda rows, places: runs[ref_at[rows] + np.clip(places, 0, span[rows] - 1)]
        counts.add("run_insertion", 0, np.maximum(near(inserted[0], inserted[1] - 1), near(inserted[0], inserted[1])))
        counts.add("run_deletion", 0, near(deleted[0], deleted[1]))
        counts.add("cycle", 0, np.zeros(len(owner), np.int64), wrong)
    turned = reverse[owner[wrong]]
    counts.add("substitution", 0, np.where(turned, 3 - true[wrong], true[wrong]), np.where(turned, 3 - called[wrong], called[wrong]))
    counts.add("insertion", 0, inserted[2])
    counts.add("deletion", 0, deleted[2])


def cycle_errors(cells: DataFrame) -> DataFrame:
    """(mate, cycle, bases, rate) of mismatches."""
    own = cells.filter("kind = 'cycle'").groupBy("mate", F.col("a").alias("cycle"))
    out = own.agg(F.sum("n").alias("bases"), F.sum(F.when(F.col("b") == 1, F.col("n")).otherwise(0)).alias("wrong"))
    return out.select("mate", "cycle", "bases", F.try_divide(F.col("wrong").cast("double"), F.col("bases")).alias("rate"))


def quality_errors(cells: DataFrame, pseudo: float = PSEUDO) -> DataFrame:
    """(mate, quarter, quality, rate): mismatch rates, drawn to the quality's own mean where a cell has few bases."""
    cell = cells.filter("kind = 'quality'").groupBy("mate", F.col("a").alias("quarter"), F.col("b").alias("quality")).agg(F.sum("n").alias("bases"), F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("wrong"))
    whole = W.partitionBy("mate", "quality")
    mean = F.sum("wrong").over(whole) / F.greatest(F.sum("bases").over(whole), F.lit(1)).cast("double")
    return cell.select("mate", "quarter", "quality", ((F.col("wrong") + pseudo * mean) / (F.col("bases") + pseudo)).alias("rate"))


def rates(cells: DataFrame, kind: str) -> DataFrame:
    """One row of scalar rates. Short reads count indel events, long reads indel bases, over aligned bases."""
    size = F.lit(1) if kind == "short" else F.col("a")
    total = lambda name, value=F.col("n"): F.coalesce(F.sum(F.when(F.col("kind") == name, value)), F.lit(0)).cast("double")
    wrong = F.coalesce(F.sum(F.when((F.col("kind") == "cycle") & (F.col("b") == 1), F.col("n"))), F.lit(0)).cast("double")
    sums = cells.agg(
        total("cycle").alias("aligned"), wrong.alias("wrong"), total("insertion", F.col("n") * size).alias("ins"), total("deletion", F.col("n") * size).alias("del"),
        total("length", F.col("n") * F.col("a")).alias("bases"), total("length").alias("reads"), total("read", F.col("n") * F.col("a")).alias("long_bases"), total("read").alias("long_reads"),
    )
    at_least = F.greatest("aligned", F.lit(1.0))
    errors = F.greatest(F.col("wrong") + F.col("ins") + F.col("del"), F.lit(1.0))
    length = F.try_divide(F.col("bases") + F.col("long_bases"), F.col("reads") + F.col("long_reads"))
    shares = [(F.col(c) / errors).alias(f"frac_{n}") for c, n in (("wrong", "sub"), ("ins", "ins"), ("del", "del"))]
    return sums.select("aligned", (F.col("wrong") / at_least).alias("mismatch_rate"), (F.col("ins") / at_least).alias("ins_rate"), (F.col("del") / at_least).alias("del_rate"), length.alias("mean_read_length"), *shares)


def run_factors(cells: DataFrame) -> DataFrame:
    """(run, ins_factor, del_factor): indel events at runs of a length, relative to all bases, smoothed by five events."""
    wide = cells.filter(F.col("kind").isin("run", "run_insertion", "run_deletion")).groupBy(F.col("a").alias("run")).pivot("kind", ["run", "run_insertion", "run_deletion"]).agg(F.sum("n"))
    wide = wide.toDF("length", "bases", "ins", "del").na.fill(0)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def factor(column: str):
        share = F.sum(column).over(every) / F.greatest(F.sum("bases").over(every), F.lit(1)).cast("double")
        return F.when(share > 0, (F.col(column) + 5.0) / (F.col("bases") * share + 5.0)).otherwise(1.0)

    return wide.select(F.col("length").alias("run"), "bases", factor("ins").alias("ins_factor"), factor("del").alias("del_factor"))


def fragments(cells: DataFrame) -> DataFrame:
    """(length, n) of fragments up to the 99.9 % quantile."""
    own = cells.filter("kind = 'fragment'").select(F.col("a").alias("length"), "n")
    limit = own.agg(F.expr("percentile(length, 0.999, n)").alias("most"))
    return own.crossJoin(F.broadcast(limit)).filter("length <= most").select("length", "n")


def refine(real: DataFrame, pilot: DataFrame, limit: float = 4.0) -> DataFrame:
    """(sub, ins, del): factors by which injected rates are multiplied, real over pilot on one-row rate tables, times the former factor
    (inject_*, where real has it), held within 1/limit and limit; 1 where a rate is 0."""
    pair = real.crossJoin(F.broadcast(pilot.select(*[F.col(c).alias(f"pilot_{c}") for c in ("mismatch_rate", "ins_rate", "del_rate")])))

    def factor(name: str, column: str):
        former = F.col(f"inject_{name}") if f"inject_{name}" in real.columns else F.lit(1.0)
        ratio = F.when((F.col(column) > 0) & (F.col(f"pilot_{column}") > 0), F.try_divide(F.col(column), F.col(f"pilot_{column}"))).otherwise(1.0)
        return F.least(F.greatest(former * ratio, F.lit(1 / limit)), F.lit(limit)).alias(name)

    return pair.select(factor("sub", "mismatch_rate"), factor("ins", "ins_rate"), factor("del", "del_rate"))


def cycle_qualities(cells: DataFrame) -> DataFrame:
    """(mate, cycle, quality): mean quality of every cycle, all bases of a read counted."""
    first = cells.filter("kind = 'first'").select("mate", F.lit(0).alias("cycle"), F.col("a").alias("q"), "n")
    later = cells.filter("kind = 'transition'").select("mate", F.col("a").alias("cycle"), F.col("c").alias("q"), "n")
    return first.unionByName(later).groupBy("mate", "cycle").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("quality"))


def fragment_median(cells: DataFrame) -> DataFrame:
    """One row: the median length of fragments up to the 99.9 % quantile; null without any."""
    return fragments(cells).agg(F.expr("percentile(length, 0.5, n)").alias("fragment_median"))


def read_rates(cells: DataFrame) -> DataFrame:
    """One row of long reads: mean_error, the mean over reads of errors by columns, and read_n50; null without reads."""
    error = cells.filter("kind = 'error'").agg(F.try_divide(F.sum(F.col("a") / F.col("b") * F.col("n")), F.sum("n")).alias("mean_error"))
    held = cells.filter("kind = 'read'").groupBy(F.col("a").alias("length")).agg(F.sum(F.col("a") * F.col("n")).alias("bases"))
    order = W.orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    half = held.withColumn("enough", F.sum("bases").over(order) * 2 >= F.sum("bases").over(every)).filter("enough")
    return error.crossJoin(half.agg(F.max("length").cast("double").alias("read_n50")))


def long_run_factors(real: DataFrame, sim: DataFrame, least: int = 4) -> DataFrame:
    """(metric, real, simulated): mean indel factors of runs of `least` or more bases, weighted by the real bases plus 1. A run length
    that a side lacks has the factor of no bases and no events."""
    every = real.sparkSession.range(least, RUNS + 1).select(F.col("id").cast("int").alias("run"))
    side = lambda cells, name: run_factors(cells).select("run", F.col("bases").alias(f"{name}_bases"), F.col("ins_factor").alias(f"{name}_ins"), F.col("del_factor").alias(f"{name}_del"))
    both = every.join(side(real, "real"), "run", "left").join(side(sim, "sim"), "run", "left").withColumn("weight", F.coalesce("real_bases", F.lit(0)) + 1)
    mean = lambda name: F.sum(F.coalesce(name, F.lit(1.0)) * F.col("weight")) / F.sum("weight")
    rows = [F.struct(F.lit(f"hp_{kind}_factor (homopolymer >= {least})").alias("metric"), mean(f"real_{kind}").alias("real"), mean(f"sim_{kind}").alias("simulated")) for kind in ("ins", "del")]
    return both.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def compare(real: DataFrame, sim: DataFrame, kind: str, tolerance: float = 0.25) -> DataFrame:
    """(metric, real, simulated, difference, ok) of two cell tables: relative differences of rates, distances of distributions (short reads: substitutions, each
    mate's qualities and fragments; long reads: lengths, errors and indel lengths), for short reads the correlation of the error curves and the gap of the
    quality curves (2 at most) of each mate, and for long reads the indel factors of long runs."""
    names = ["mismatch_rate", "ins_rate", "del_rate", "mean_read_length"] + ([] if kind == "short" else ["frac_sub", "frac_ins", "frac_del"])
    side = lambda cells, name: rates(cells, kind).unpivot([], names, "metric", name)
    gap = F.try_divide(F.col("simulated") - F.col("real"), F.col("real"))
    scalars = side(real, "real").join(side(sim, "simulated"), "metric")
    of_reads = fragment_median if kind == "short" else read_rates
    more = [of_reads(cells).unpivot([], ["fragment_median"] if kind == "short" else ["mean_error", "read_n50"], "metric", name) for cells, name in ((real, "real"), (sim, "simulated"))]
    # A figure that a side lacks makes no row: profiles of unpaired reads have no fragments.
    scalars = scalars.unionByName(more[0].join(more[1], "metric").filter("real is not null and simulated is not null"))
    if kind != "short":
        scalars = scalars.unionByName(long_run_factors(real, sim))
    rows = scalars.select("metric", "real", "simulated", gap.alias("difference"), F.coalesce(F.abs(gap) <= tolerance, F.lit(False)).alias("ok"))
    both = real.withColumn("own", F.lit(True)).unionByName(sim.withColumn("own", F.lit(False)))
    mate = (F.col("mate") + 1).cast("string")
    if kind == "short":
        named = F.when(F.col("kind") == "substitution", "substitution spectrum").when(F.col("kind") == "transition", F.concat(F.lit("quality distribution, mate "), mate))
        cell = F.when(F.col("kind") == "transition", F.struct(F.lit(0).alias("a"), F.col("c").alias("b"))).otherwise(F.struct("a", "b"))
    else:
        named = F.when(F.col("kind").isin("insertion", "deletion"), F.concat("kind", F.lit(" length distribution")))
        cell = F.struct("a", "b")
    weights = both.withColumn("metric", named).filter("metric is not null").groupBy("metric", cell.alias("cell"))
    weights = weights.agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("q"))
    distance = total_variation(weights, ["metric"], "p", "q").select("metric", F.col("tv").alias("d"))
    place = F.when(F.col("kind") == "error", F.col("a") / F.col("b")).otherwise(F.col("a").cast("double"))
    heights = both.filter(F.col("kind").isin("fragment", "read", "error")).groupBy("kind", place.alias("x")).agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("b"))
    order, whole = W.partitionBy("kind").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy("kind")
    step = F.abs(F.try_divide(F.sum("a").over(order).cast("double"), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(order).cast("double"), F.sum("b").over(whole)))
    lengths = heights.withColumn("d", step).groupBy("kind").agg(F.max("d").alias("d")).select(F.when(F.col("kind") == "error", "per-read error distribution").otherwise(F.concat("kind", F.lit(" length distribution"))).alias("metric"), "d")
    far = distance.unionByName(lengths).select("metric", F.lit(0.0).alias("real"), F.col("d").alias("simulated"), F.col("d").alias("difference"), F.coalesce(F.col("d") <= tolerance, F.lit(False)).alias("ok"))
    out = rows.unionByName(far)
    if kind == "short":
        curves = cycle_errors(real).select("mate", "cycle", F.col("rate").alias("r")).join(cycle_errors(sim).select("mate", "cycle", F.col("rate").alias("s")), ["mate", "cycle"])
        curve = pearson(curves, ["mate"], "r", "s")
        name = F.concat(F.lit("per-cycle error curve, mate "), (F.col("mate") + 1).cast("string"))
        out = out.unionByName(curve.select(name.alias("metric"), F.lit(1.0).alias("real"), F.col("r").alias("simulated"), (1 - F.col("r")).alias("difference"), F.coalesce(F.col("r") >= 1 - tolerance, F.lit(False)).alias("ok")))
        qualities = cycle_qualities(real).join(cycle_qualities(sim).withColumnRenamed("quality", "other"), ["mate", "cycle"])
        name = F.concat(F.lit("per-cycle mean quality, mate "), (F.col("mate") + 1).cast("string"))
        out = out.unionByName(max_gap(qualities, ["mate"], "quality", "other").select(name.alias("metric"), F.lit(0.0).alias("real"), F.col("gap").alias("simulated"), F.col("gap").alias("difference"), (F.col("gap") <= 2.0).alias("ok")))
    return out


def save_profile(cells: DataFrame, path: str, facts: dict | None = None) -> None:
    """Cells as a table, and beside them one JSON row of facts about the profile (its kind, its source)."""
    cells.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([(json.dumps(facts or {}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_profile(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The cells and the facts of a saved profile."""
    return spark.read.schema(CELLS).parquet(f"{path}/cells"), json.loads(spark.read.text(f"{path}/facts").first()[0])


__all__ = ["compare", "count_cells", "cycle_errors", "cycle_qualities", "first_of_mate", "fragment_median", "fragments", "load_profile", "long_run_factors", "quality_errors", "rates", "read_rates", "refine", "run_factors", "save_profile", "usable"]
