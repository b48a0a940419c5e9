"""Variants: genotypes on haplotypes, non-overlapping selection, application to reference windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.lineage import cut
from ..functions.ordered import ROWS_A_RANGE, is_small
from ..functions.scalars import hash_swap

#: Before every place; and the width of the narrowest bins of stalls, about a window of short reads.
LEAST, WINDOW = -(1 << 62), 128
#: Names of contigs that are sent to every task; more are joined.
MOST_NAMES = 1 << 17
#: What tells stalls apart.
KEYS = ["contig", "hap", "_depth", "_stall"]
#: Windows that a task gets, and bases that it lays out at a time.
WINDOWS_A_TASK, BLOCK_BASES = 1 << 17, 1 << 20


def genotype_rows(records: DataFrame, names: DataFrame) -> DataFrame:
    """records(file_order, contig, pos1, ref, alts, genotype) with canonical, status (off_reference, skipped_other, homozygous_reference,
    used) and, for used records, alleles: the allele index of both haplotypes. A haploid call counts for both; an unphased
    heterozygous call is placed by a hash of its position. Up to MOST_NAMES names go to every task, so that records are not dealt out by contigs; and each step is a
    column of its own, so that no later one works it out again."""
    named = names.withColumnRenamed("name", "contig")
    few = names.select("name").limit(MOST_NAMES + 1).count() <= MOST_NAMES
    found = records.join(F.broadcast(named) if few else named, "contig", "left").withColumn("call_", F.split_part("genotype", F.lit(":"), F.lit(1)))
    found = found.withColumn("called_", F.split(F.translate("call_", "|", "/"), "/"))
    clean = ~F.array_contains("called_", ".") & ~F.exists(F.split("alts", ","), lambda a: ~a.rlike("^[ACGTacgt]+$")) & F.col("ref").rlike("^[ACGTNacgtn]+$")
    found = found.withColumn("clean_", clean)
    numbers = F.transform("called_", lambda a: F.when(a.rlike("^[0-9]+$"), a).otherwise("0").cast("int"))
    found = found.withColumn("numbers_", F.when(F.col("canonical").isNotNull() & F.coalesce("clean_", F.lit(True)), numbers))
    both = F.when(F.size("numbers_") == 1, F.array(F.get("numbers_", F.lit(0)), F.get("numbers_", F.lit(0)))).otherwise(F.col("numbers_"))
    status = F.when(F.col("canonical").isNull(), "off_reference").when(~F.col("clean_"), "skipped_other").when(F.forall("numbers_", lambda a: a == 0), "homozygous_reference").otherwise("used")
    swap = ~F.contains("call_", F.lit("|")) & (F.get("both_", F.lit(0)) != F.get("both_", F.lit(1))) & hash_swap(F.col("canonical"), F.col("pos1") - 1)
    out = found.withColumns({"status": status, "both_": both, "start0": F.col("pos1") - 1})
    out = out.withColumn("alleles", F.when(F.col("status") == "used", F.when(swap, F.reverse("both_")).otherwise(F.col("both_"))))
    return out.drop("call_", "called_", "clean_", "numbers_", "both_")


def haplotype_variants(genotypes: DataFrame) -> DataFrame:
    """(contig, hap, start0, ref_len, alt) of every non-reference allele."""
    # Only used records have alleles. A filter, one that `posexplode` brings along too, would work everything before out a second time.
    used = genotypes.select("canonical", "start0", F.length("ref").alias("ref_len"), F.split("alts", ",").alias("alts"), F.posexplode_outer("alleles").alias("hap", "allele"))
    return used.filter("allele > 0").select(F.col("canonical").alias("contig"), "hap", "start0", "ref_len", F.upper(F.get("alts", F.col("allele") - 1)).alias("alt"))


def _following(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each place, the first one after it that starts at its end or later."""
    return np.maximum(np.searchsorted(starts, ends), np.arange(len(starts)) + 1)


def _ways_through(own: pd.DataFrame) -> pd.DataFrame:
    """One row of a range of places: whoever enters with a reach up to `upto` (the first such) leaves it with `leaves`. Only reaches up to `most`, the
    furthest end of the ranges before, can enter."""
    own = own.sort_values("start0")
    starts, ends = own["start0"].to_numpy(), own["end0"].to_numpy()
    after, leaves = _following(starts, ends).tolist(), ends.tolist()
    for i in range(len(leaves) - 1, -1, -1):
        if after[i] < len(leaves):
            leaves[i] = leaves[after[i]]
    most = own["most"].iloc[0]
    many = 1 if pd.isna(most) else min(len(leaves), int(np.searchsorted(starts, most)) + 1)
    last = [i for i in range(many) if i + 1 == many or leaves[i] != leaves[i + 1]]
    return pd.DataFrame({"group": [own["group"].iloc[0]], "range": [own["range"].iloc[0]], "upto": [[int(starts[i]) for i in last]], "leaves": [[leaves[i] for i in last]]})


def _enter(own: pd.DataFrame) -> pd.DataFrame:
    """The reach with which the selection enters every range of a group, one row a range."""
    own, reach, found = own.sort_values("range"), LEAST, []
    for upto, leaves in zip(own["upto"], own["leaves"], strict=True):
        found.append(reach)
        at = int(np.searchsorted(upto, reach))
        reach = int(leaves[at]) if at < len(leaves) else reach
    return pd.DataFrame({"group": own["group"], "range": own["range"], "reach": found})


def _open_places(own: pd.DataFrame) -> pd.DataFrame:
    """The places of a range that the selection takes."""
    own = own.sort_values("start0")
    starts = own["start0"].to_numpy()
    after, taken = _following(starts, own["end0"].to_numpy()).tolist(), []
    at = int(np.searchsorted(starts, own["reach"].iloc[0]))
    while at < len(after):
        taken.append(at)
        at = after[at]
    return own.iloc[taken][["group", "start0"]]


def keep_apart(variants: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """variants plus kept: false where a variant starts before the last kept one of its haplotype ends, in (start0, ref_len, alt) order.

    Of the variants of one place only those without reference bases and the first other one can be kept, so places are selected, and equal variants are one row until the end.
    Places are dealt out by ranges; each range tells how a reach that enters it leaves, those rows are followed through a haplotype, and
    then every range selects its own. So no run of overlapping variants is one fold. A small table is one range.
    """
    group = F.to_json(F.struct("contig", "hap"))
    columns = ["contig", "hap", F.col("start0").cast("long").alias("start0"), F.col("ref_len").cast("long").alias("ref_len"), "alt"]
    once = cut(variants.select(*columns).groupBy("contig", "hap", "start0", "ref_len", "alt").agg(F.count(F.lit(1)).alias("n")).withColumn("group", group))
    lead = F.min(F.when(F.col("ref_len") > 0, F.struct("ref_len", "alt"))).alias("lead")
    places = cut(once.filter("start0 is not null and ref_len is not null").groupBy("group", "start0").agg(lead))
    spans = places.select("group", "start0", (F.col("start0") + F.coalesce("lead.ref_len", F.lit(0))).alias("end0"))
    if is_small(spans, rows_a_range):
        entered = spans.withColumns({"range": F.lit(0), "reach": F.lit(LEAST)})
    else:
        ranges = max(1, -(-spans.count() // rows_a_range))
        ranged = cut(spans.repartitionByRange(ranges, "group", "start0").withColumn("range", F.spark_partition_id()))
        furthest = ranged.groupBy("group", "range").agg(F.max("end0").alias("end0"))
        former = furthest.select("group", "range", F.max("end0").over(W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("most"))
        ways = ranged.join(former, ["group", "range"]).groupBy("group", "range").applyInPandas(_ways_through, "group string, range int, upto array<long>, leaves array<long>")
        entered = ranged.join(ways.groupBy("group").applyInPandas(_enter, "group string, range int, reach long"), ["group", "range"])
    taken = entered.groupBy("group", "range").applyInPandas(_open_places, "group string, start0 long")
    known = places.join(taken.withColumn("open", F.lit(True)), ["group", "start0"], "left").select("group", "start0", "lead", F.coalesce("open", F.lit(False)).alias("open"))
    empty = F.col("ref_len") <= 0
    first = F.col("open") & (empty | F.struct("ref_len", "alt").eqNullSafe(F.col("lead")))
    copies = F.concat(F.array(first), F.array_repeat(F.col("open") & empty, (F.col("n") - 1).cast("int")))
    return once.join(known, ["group", "start0"], "left").select("contig", "hap", "start0", "ref_len", "alt", F.explode(copies).alias("kept"))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one byte each where they allow it, and the bounds of each text."""
    texts = pc.fill_null(texts, "")
    bounds = np.concatenate(([0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)))
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32), bounds


def _texts(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts that `_codes` gives codes and bounds of."""
    if codes.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(codes))
    text = codes.tobytes().decode("utf-32-le")
    return pa.array([text[low:high] for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


class _Near:
    """Variants of stalls, one row a stall, in the order of marks."""

    def __init__(self, rows: pa.Table):
        self.marks, self.keys = rows["_mark"].to_numpy(), [rows[k].combine_chunks() for k in KEYS]
        lists = [rows[c].combine_chunks() for c in ("_starts", "_ends", "_alts")]
        self.starts, self.ends = (x.flatten().to_numpy(zero_copy_only=False) for x in lists[:2])
        self.alts, self.bounds = _codes(lists[2].flatten())
        self.firsts = np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
        many = np.diff(self.firsts)
        self.base = self.starts[self.firsts[:-1]]
        at = self.starts - np.repeat(self.base, many)
        self.width = int(at.max(initial=0)) + 2
        self.order = np.repeat(np.arange(len(many)), many) * self.width + at
        clash = np.flatnonzero(self.starts[1:] < self.ends[:-1]) + 1
        row = np.searchsorted(self.firsts, clash, "right") - 1
        self.apart = np.ones(len(many), bool)
        self.apart[row[self.firsts[row] != clash]] = False

    def row_of(self, marks: np.ndarray, keys: list[pa.Array]) -> np.ndarray:
        """The row of every window's stall, -1 where it has no variants. Different stalls of one mark are told apart by their keys."""
        row, found = np.searchsorted(self.marks, marks, "right") - 1, np.full(len(marks), -1)
        todo = np.flatnonzero(row >= 0)
        while len(todo := todo[self.marks[row[todo]] == marks[todo]]):
            same = np.ones(len(todo), bool)
            for own, key in zip(self.keys, keys, strict=True):
                same &= pc.fill_null(pc.equal(own.take(pa.array(row[todo])), key.take(pa.array(todo))), False).to_numpy(zero_copy_only=False)
            found[todo[same]] = row[todo[same]]
            todo = todo[~same & (row[todo] > 0)]
            row[todo] -= 1
        return found

    def first_from(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first variant of each row that starts at a place or later."""
        return np.searchsorted(self.order, rows * self.width + np.clip(places - self.base[rows], 0, self.width - 1))

    def own(self, rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows and the variants that they take, in the order of both."""
        lows, many = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        there = np.flatnonzero(rows >= 0)
        lows[there] = self.first_from(rows[there], starts[there])
        many[there] = np.maximum(self.first_from(rows[there], stops[there]) - lows[there], 0)
        window = np.repeat(np.arange(len(rows)), many)
        firsts = np.cumsum(many) - many
        variant = np.arange(len(window)) + np.repeat(lows - firsts, many)
        good = self.ends[variant] <= stops[window]
        for i in there[~self.apart[rows[there]]].tolist():  # none of those that `keep_apart` keeps
            reach = starts[i]
            for k in range(firsts[i], firsts[i] + many[i]):
                good[k] &= self.starts[variant[k]] >= reach
                reach = self.ends[variant[k]] if good[k] else reach
        return window[good], variant[good]


def _laid_out(near: _Near, rows: np.ndarray, starts: np.ndarray, seqs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sample sequences of windows, the positions of their bases, the bounds of both, and how many variants each window took. A window is a row of segments: the bases
    before a variant, its own, and at last the bases behind; all are gathered at once."""
    codes, bounds = _codes(seqs)
    sizes = np.diff(bounds)
    stops = starts + sizes
    window, variant = near.own(rows, starts, stops)
    many = np.bincount(window, minlength=len(rows))
    begins, ends = near.starts[variant], near.ends[variant]
    alts, alt_at = near.alts, near.bounds[variant]
    alt_sizes = near.bounds[variant + 1] - alt_at
    lasts = np.cumsum(2 * many + 1) - 1
    firsts = lasts - 2 * many
    before = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
    fronts = np.where(before > 0, np.roll(ends, 1), starts[window])
    at = firsts[window] + 2 * before
    source, size, place = (np.empty(int(lasts[-1]) + 1 if len(lasts) else 0, np.int64) for _ in range(3))
    source[at], size[at], place[at] = bounds[window] + fronts - starts[window], begins - fronts, fronts
    source[at + 1], size[at + 1], place[at + 1] = len(codes) + alt_at, alt_sizes, begins
    tails, some = starts.copy(), np.flatnonzero(many)
    tails[some] = ends[np.cumsum(many)[some] - 1]
    source[lasts], size[lasts], place[lasts] = bounds[:-1] + tails - starts, stops - tails, tails
    until = np.cumsum(size)
    step = np.arange(int(until[-1]) if len(until) else 0)
    since = until - size
    both = np.concatenate([codes, alts]) if codes.dtype == alts.dtype else np.concatenate([codes.astype(np.uint32), alts.astype(np.uint32)])
    bases = both[np.repeat(source - since, size) + step]
    positions = np.repeat(place - since, size) + step
    furthest = begins + np.maximum(ends - begins - 1, 0)
    longer = np.flatnonzero(alt_sizes > furthest - begins + 1)
    n = alt_sizes[longer]
    inserted = np.arange(int(n.sum())) + np.repeat(since[at[longer] + 1] - (np.cumsum(n) - n), n)
    positions[inserted] = np.minimum(positions[inserted], np.repeat(furthest[longer], n))
    edges = np.concatenate(([0], until[lasts]))
    return _texts(bases, edges), positions, edges, many


def _apply(batches: Iterator[pa.RecordBatch], columns: list[str], marked: list[str]) -> Iterator[pa.RecordBatch]:
    """Windows of a task (`marked` in the order of `columns`) with what `apply_to_windows` finds; the variants of a stall come before its windows, and are held while they come."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        order = table["_order"].to_numpy()
        table = table.append_column("_mark", pa.array(order & -2))
        fresh = table.filter(pa.array(order & 1 == 0)).select(["_mark", *KEYS, "_starts", "_ends", "_alts"])
        held = fresh if held is None else pa.concat_tables([held, fresh])
        near, windows = _Near(held), table.filter(pa.array(order & 1 == 1))
        held = held.filter(pa.array(near.marks == (order[-1] & -2))) if len(order) else held
        seqs, places = (windows[marked[columns.index(c)]].combine_chunks() for c in ("seq", "start0"))
        rows = near.row_of(windows["_mark"].to_numpy(), [windows[k].combine_chunks() for k in KEYS])
        starts = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(pc.fill_null(pc.utf8_length(seqs), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(total):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + BLOCK_BASES, "right")))
            part = slice(low, high)
            texts, positions, edges, many = _laid_out(near, rows[part], starts[part], seqs[part])
            texts = pc.if_else(seqs[part].is_valid(), texts, pa.scalar(None, pa.string()))
            placed = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(positions), mask=pc.is_null(places[part]))
            own = [windows[m].combine_chunks()[part] for m in marked]
            yield pa.RecordBatch.from_arrays([*own, texts, placed, pa.array(many.astype(np.int32))], names=[*columns, "sample_seq", "positions", "n_variants"])
            low = high


def apply_to_windows(windows: DataFrame, kept: DataFrame, windows_a_task: int = WINDOWS_A_TASK) -> DataFrame:
    """windows(window_id, contig, hap, start0, seq) plus sample_seq, positions (array<long>: the reference position of every base of it) and n_variants.

    Variants are gathered once for each stall of windows (two neighbouring bins that hold them, see `intervals.with_dominant`), one row a stall, and go with its windows to a
    task, which lays out many windows at once; no row is made for a pair. A stall with more than `windows_a_task` windows is dealt out in parts, each with a copy of its row.
    Inserted bases take the position of the last base that they replace. A variant that begins before a former one ends, or leaves the window, is passed over.
    """
    from .intervals import _stall

    spark = windows.sparkSession
    level, stall = _stall(F.col("start0"), F.col("start0") + F.length("seq"), WINDOW)
    placed = windows.withColumns({"_depth": level, "_stall": stall})
    parts = F.ceil(F.count(F.lit(1)) / F.lit(windows_a_task)).cast("int").alias("_parts")
    stalls = cut(placed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_windows"), parts))
    many, most = stalls.agg(F.sum("_windows"), F.max("_parts")).first()
    depths = stalls.filter("_stall is not null").agg(F.sort_array(F.collect_set("_depth")).alias("_depths"))  # one row
    bins = F.transform("_depths", lambda k: F.struct(k.alias("_depth"), F.floor(F.col("start0") / (F.lit(WINDOW).cast("long") * F.pow(F.lit(8.0), k).cast("long"))).alias("_bin")))
    taken = kept.filter("kept and start0 is not null and ref_len is not null").select("contig", "hap", F.col("start0").cast("long").alias("start0"), F.col("ref_len").cast("long").alias("ref_len"), "alt")
    inside = taken.crossJoin(F.broadcast(depths)).select(*taken.columns, F.inline(bins))
    both = inside.withColumn("_stall", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"))))
    near = both.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("start0", "ref_len", "alt"))).alias("near_")).join(stalls.drop("_windows"), KEYS)
    ends = F.transform("near_", lambda v: v["start0"] + v["ref_len"])
    near = near.select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("near_.start0").alias("_starts"), ends.alias("_ends"), F.col("near_.alt").alias("_alts"))
    if (most or 0) > 1:
        crowded = F.broadcast(stalls.filter("_parts > 1").drop("_windows"))  # a row for `windows_a_task` windows at most
        hashed = F.xxhash64(*[c for c, kind in windows.dtypes if "map<" not in kind])
        placed = placed.join(crowded, KEYS, "left").withColumn("_part", F.pmod(hashed, F.coalesce("_parts", F.lit(1))).cast("int"))
    else:
        placed = placed.withColumn("_part", F.lit(0))
    # One number that orders rows, so that they are sorted by it alone: a hash of the stall's part, and in its last bit whether it is a window.
    order = F.xxhash64(*KEYS, "_part").bitwiseAND(F.lit(-2))
    marked = {f"_w{i}": F.col(c) for i, c in enumerate(windows.columns)}
    # Windows have empty lists, as an Arrow writer goes over all nulls before a list's row again to tell the batch's size.
    lists = [F.array().cast(kind).alias(c) for c, kind in near.dtypes if c in ("_starts", "_ends", "_alts")]
    asked = placed.select(*KEYS, "_part", *lists, *[c.alias(n) for n, c in marked.items()], (order + 1).alias("_order"))
    rows = near.select("*", order.alias("_order")).unionByName(asked, allowMissingColumns=True)
    tasks, usual = -(-(many or 0) // windows_a_task), int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("_order").bitwiseAND(F.lit(-2))
    dealt = (rows.repartition(tasks, by) if tasks > usual else rows.repartition(by)).sortWithinPartitions("_order")
    schema = StructType([*windows.schema, StructField("sample_seq", StringType()), StructField("positions", ArrayType(LongType())), StructField("n_variants", IntegerType())])
    columns, names = windows.columns, list(marked)
    return dealt.mapInArrow(lambda batches: _apply(batches, columns, names), schema)
