"""Interval algebra: merging, coverage, dominant labels, point counts, complements.

Overlap joins run on bins of several widths: every interval stands at the level of the narrowest bins of which it touches two at most, and a pair
meets at the wider level of its two intervals, so an interval makes a few rows however long it is; a pair is kept only in the bin where the later
of both starts lies, so that it counts once. What needs totals only (points in an interval, bases of long queries under labels) is a
sweep: starts, ends and points stand in one order along the genome, running sums say what lies before each, and differences of two sums answer a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ordered import ROWS_A_RANGE, is_small, running_sums
from ..functions.scalars import overlap

#: Width of the narrowest bins; each of the LEVELS levels is eight times as wide as the one before.
BIN, LEVELS = 4096, 8
#: Bases from which on a query's coverage is swept and not joined.
LONG_QUERY = 1 << 20
#: Width of the narrowest bins of stalls, see `with_dominant`, and their levels.
STALL, STALL_LEVELS = 512, 14
BEST = "array<struct<set_name: string, share: double, label: string>>"
#: Annotation sets that a plan can name.
MOST_SETS = 1000


def overlap_runs(table: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], touching: bool, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """table(keys, start0, end0, ...) plus run: the start of the run of overlapping (or touching) intervals that a row belongs to. Rows are
    dealt out by ranges of (keys, order), where `order` begins with start0; the furthest end and the last run's start of the ranges
    before are carried into each, so no contig is one task. A small table is one range, and nothing is written."""
    columns = [F.col(c) for c in (*keys, *order)]
    small = is_small(table, rows_a_range)
    ranged = table.withColumn("_range", F.lit(0)) if small else None
    if ranged is None:
        ranges = max(1, -(-table.count() // rows_a_range))
        ranged = cut(table.repartitionByRange(ranges, *columns).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range", *keys).orderBy(*order)
    former = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """(_range, keys, name): the largest value over the ranges before, one row for each range and key."""
        return rows.groupBy("_range", *keys).agg(F.max(value).alias("_most")).select("_range", *keys, F.max("_most").over(former).alias(name))

    def with_former(rows: DataFrame, of: DataFrame, value: Column, name: str) -> DataFrame:
        return rows.withColumn(name, F.lit(None).cast("long")) if small else rows.join(carried(of, value, name), ["_range", *keys])

    near = ranged.withColumn("_own", F.max("end0").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    reach = F.greatest("_own", "_before")
    apart = (F.col("start0") > reach) if touching else (F.col("start0") >= reach)
    marked = with_former(near, ranged, F.col("end0"), "_before").withColumn("_fresh", F.when(reach.isNull() | apart, F.col("start0")))
    begun = marked.withColumn("_here", F.max("_fresh").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = with_former(begun, marked, F.col("_fresh"), "_earlier")
    return runs.select(*table.columns, F.coalesce("_here", "_earlier").alias("run"))


def merge_intervals(intervals: DataFrame, keys: tuple[str, ...] = ("label", "contig"), rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(keys, start0, end0): touching and overlapping intervals of one key joined."""
    once = intervals.select(*keys, "start0", "end0").distinct()
    runs = overlap_runs(once, keys, ("start0", "end0"), touching=True, rows_a_range=rows_a_range)
    return runs.groupBy(*keys, "run").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0")).drop("run")


def _level(start: Column, end: Column, width: int) -> Column:
    """The level of the narrowest bins that are as long as an interval."""
    return reduce(lambda out, k: F.when(end - start <= width * 8**k, F.lit(k)).otherwise(out), range(LEVELS - 2, -1, -1), F.lit(LEVELS - 1))


def _bins(start: Column, end: Column, level: Column, width: int) -> Column:
    wide = F.lit(width).cast("long") * F.pow(F.lit(8.0), level).cast("long")
    return F.sequence(F.floor(start / wide), F.floor((end - 1) / wide))


def overlap_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """left(contig, start0, end0, ...) with right(contig, r_start, r_end, ...) wherever they share a base. An interval stands in two bins at most of its own
    level and of those wider levels that the other side has."""
    a = left.filter("end0 > start0").withColumn("_own", _level(F.col("start0"), F.col("end0"), width))
    b = right.filter("r_end > r_start").withColumn("_r_own", _level(F.col("r_start"), F.col("r_end"), width))

    def placed(side: DataFrame, own: str, start: str, end: str, other: DataFrame, other_own: str) -> DataFrame:
        wider = other.agg(F.sort_array(F.collect_set(other_own)).alias("_there"))  # one row
        levels = F.array_union(F.array(own), F.filter("_there", lambda k: k > F.col(own)))
        at = side.crossJoin(F.broadcast(wider)).withColumn("_level", F.explode(levels)).drop("_there")
        return at.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), F.col("_level"), width)))

    wide = F.lit(width).cast("long") * F.pow(F.lit(8.0), F.col("_level")).cast("long")
    met = (F.col("start0") < F.col("r_end")) & (F.col("r_start") < F.col("end0")) & (F.greatest("_own", "_r_own") == F.col("_level")) & (F.col("_bin") == F.floor(F.greatest("start0", "r_start") / wide))
    pairs = placed(a, "_own", "start0", "end0", b, "_r_own").join(placed(b, "_r_own", "r_start", "r_end", a, "_own"), ["contig", "_level", "_bin"])
    return pairs.filter(met).drop("_level", "_bin", "_own", "_r_own")


def _ends(queries: DataFrame, key: str) -> DataFrame:
    """(key, contig, at, sign): both ends of every query that is not empty."""
    ends = F.explode(F.array(F.struct(F.col("start0").cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end0").cast("long").alias("at"), F.lit(1).alias("sign")))).alias("e")
    return queries.filter("end0 > start0").select(key, "contig", ends).select(key, "contig", "e.at", "e.sign")


def swept_coverage(queries: DataFrame, merged: DataFrame, key: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(key, set_name, label, covered), as `coverage`, from merged(set_name, label, contig, start0, end0) and the sums before both ends of a query: with s starts
    and e ends of a label's intervals before place x, x * (s - e) minus the sum of those starts plus that of those ends is what the label covers before x. A query
    makes two rows for every label of its contig and an interval two, whatever their lengths."""
    names = ["set_name", "label", "contig"]
    edges = F.explode(F.array(F.struct(F.col("start0").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end0").alias("at"), F.lit(-1).alias("step")))).alias("e")
    walls = merged.select(*names, edges).groupBy(*names, F.col("e.at").cast("long").alias("at")).agg(F.sum("e.step").alias("step"), F.sum(F.col("e.step") * F.col("e.at")).cast("long").alias("moment"))
    asked = _ends(queries, key).join(merged.select(*names).distinct(), "contig")
    events = asked.select(*names, "at", key, "sign", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("moment"), F.lit(0).alias("kind")).unionByName(
        walls.withColumn("kind", F.lit(1)), allowMissingColumns=True
    )
    order = [*map(F.col, names), F.col("at"), F.col("kind"), F.xxhash64(key)]
    before = running_sums(events, order, {"open": F.col("step"), "moments": F.col("moment")}, rows_a_range).filter("kind = 0")
    upto = F.col("at") * F.col("open") - F.col("moments")
    return before.groupBy(key, "set_name", "label").agg(F.sum(F.col("sign") * upto).alias("covered")).filter("covered > 0")


def coverage(queries: DataFrame, intervals: DataFrame, key: str, width: int = BIN, carry: tuple[str, ...] = (), long_query: int = LONG_QUERY) -> DataFrame:
    """(key, carry, set_name, label, covered): bases of each query under the merged intervals of each label. Queries of `long_query` bases or more are
    swept, as they meet too many intervals for a join; `carry` are further columns of a query, the same for all rows of its key."""
    merged = merge_intervals(intervals, ("set_name", "label", "contig"))
    right = merged.select("set_name", "label", "contig", F.col("start0").alias("r_start"), F.col("end0").alias("r_end"))
    size = F.col("end0") - F.col("start0")
    pairs = overlap_join(queries.filter(size < long_query).select(key, "contig", "start0", "end0", *carry), right, width)
    shared = overlap(F.col("start0"), F.col("end0"), F.col("r_start"), F.col("r_end"))
    short = pairs.groupBy(key, *carry, "set_name", "label").agg(F.sum(shared).alias("covered"))
    long = queries.filter(size >= long_query)
    if long.isEmpty():
        return short
    swept = swept_coverage(long, merged, key)
    return short.unionByName(swept.join(long.select(key, *carry).distinct(), key) if carry else swept)


def set_names(intervals: DataFrame) -> list[str]:
    """The names of annotation sets, a handful."""
    names = sorted(r.set_name for r in intervals.select("set_name").distinct().limit(MOST_SETS + 1).collect())
    if len(names) > MOST_SETS:
        raise ValueError("too many annotation sets")
    return names


def _stall(start: Column, end: Column, width: int) -> tuple[Column, Column]:
    """(level, number) of the stall of a query: two neighbouring bins of the narrowest bins that are as long as it, from the bin of its start on. So the stall holds all of it."""
    level = reduce(lambda out, k: F.when(end - start <= width * 8**k, F.lit(k)).otherwise(out), range(STALL_LEVELS - 2, -1, -1), F.lit(STALL_LEVELS - 1))
    return level, F.floor(start / (F.lit(width).cast("long") * F.pow(F.lit(8.0), level).cast("long")))


def stall_labels(stalls: DataFrame, merged: DataFrame, width: int) -> DataFrame:
    """(contig, _depth, _stall, _sets) of stalls(contig, _depth, _stall) and merged(set_name, label, contig, start0, end0): for every set that it meets, `whole`, the
    smallest label that covers all of the stall, and the pieces of the labels that are smaller than that. A larger label covers no more of a query than `whole` and loses the
    tie, so it is never dominant. Stalls, not queries, are joined to intervals."""
    wide = F.lit(width).cast("long") * F.pow(F.lit(8.0), F.col("_depth")).cast("long")
    spans = stalls.withColumns({"start0": F.col("_stall") * wide, "end0": (F.col("_stall") + 2) * wide})
    pairs = overlap_join(spans, merged.select("set_name", "label", "contig", F.col("start0").alias("r_start"), F.col("end0").alias("r_end")))
    key = ["contig", "_depth", "_stall"]
    spanned = (F.col("r_start") <= F.col("start0")) & (F.col("r_end") >= F.col("end0"))
    pieces = F.array_sort(F.collect_list(F.when(~spanned, F.struct(F.col("r_start").alias("low"), F.col("r_end").alias("high")))))
    labels = pairs.groupBy(*key, "set_name", "label").agg(F.max(spanned).alias("_all"), pieces.alias("pieces"))
    own = F.struct("label", "pieces")
    whole = labels.groupBy(*key, "set_name").agg(F.min(F.when(F.col("_all"), F.col("label"))).alias("whole"), F.collect_list(F.when(~F.col("_all"), own)).alias("parts"))
    smaller = F.filter("parts", lambda x: F.col("whole").isNull() | (x["label"] < F.col("whole")))
    return whole.groupBy(*key).agg(F.collect_list(F.struct("set_name", "whole", smaller.alias("parts"))).alias("_sets"))


def with_dominant(queries: DataFrame, intervals: DataFrame, width: int = STALL, long_query: int = LONG_QUERY) -> DataFrame:
    """queries(contig, start0, end0, ...) plus best: an array of (set_name, share, label), the label of each set that covers most of a query, ties to the smaller label;
    share is the negative of the fraction covered. Sets that do not meet a query are left out.

    What a query can meet is gathered once for each stall, so a query is joined to one row, however many labels lie over it. Queries of `long_query` bases or more are
    swept instead, once for each interval."""
    size = F.col("end0") - F.col("start0")
    level, stall = _stall(F.col("start0"), F.col("end0"), width)
    placed = queries.withColumns({"_depth": level, "_stall": stall})
    stalls = cut(placed.filter("end0 > start0").groupBy("contig", "_depth", "_stall").agg(F.max(size).alias("_longest"), F.min(size).alias("_shortest")))
    merged = cut(merge_intervals(intervals, ("set_name", "label", "contig")))
    rows = stall_labels(stalls.filter(F.col("_shortest") < long_query).drop("_longest", "_shortest"), merged, width)
    length = size.cast("double")

    def of_label(label: Column, pieces: Column) -> Column:
        covered = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + overlap(F.col("start0"), F.col("end0"), p["low"], p["high"]))
        return F.struct((-(covered.cast("double") / length)).alias("share"), label.alias("label"))

    def of_set(x: Column) -> Column:
        parts = F.filter(F.transform(x["parts"], lambda p: of_label(p["label"], p["pieces"])), lambda s: s["share"] < 0)
        whole = F.filter(F.array(F.struct(F.lit(-1.0).alias("share"), x["whole"].alias("label"))), lambda s: s["label"].isNotNull())
        first = F.array_min(F.concat(parts, whole))
        return F.struct(x["set_name"].alias("set_name"), first["share"].alias("share"), first["label"].alias("label"))

    short = placed.filter((size < long_query) | size.isNull())
    found = short.join(rows, ["contig", "_depth", "_stall"], "left").withColumn("best", F.when(size > 0, F.filter(F.transform("_sets", of_set), lambda s: s["share"].isNotNull())))
    found = found.select(*queries.columns, F.coalesce("best", F.array().cast(BEST)).alias("best"))
    if stalls.filter(F.col("_longest") >= long_query).isEmpty():
        return found
    long = queries.filter(size >= long_query).select(F.struct(*queries.columns).alias("_row"), "contig", "start0", "end0").withColumn("_key", F.concat_ws(":", F.hex("contig"), "start0", "end0"))
    swept = swept_coverage(long.select("_key", "contig", "start0", "end0").distinct(), merged, "_key")
    own = swept.join(long.select("_key", size.cast("double").alias("_length")).distinct(), "_key").withColumn("_share", -(F.col("covered").cast("double") / F.col("_length")))
    own = own.groupBy("_key", "set_name").agg(F.min(F.struct(F.col("_share").alias("share"), "label")).alias("s")).groupBy("_key").agg(F.collect_list(F.struct("set_name", "s.share", "s.label")).alias("best"))
    return found.unionByName(long.join(own, "_key", "left").select("_row.*", F.coalesce("best", F.array().cast(BEST)).alias("best")))


def dominant_labels(queries: DataFrame, intervals: DataFrame, key: str, least: float = 0.5, width: int = STALL) -> DataFrame:
    """(key, set_name, label, fraction) for every query and set: the label that covers most of the query, ties to the
    smaller label; `none` below `least`, with the fraction kept. The sets' names, a handful, stand in the plan."""
    names = set_names(intervals)
    if not names:
        return queries.select(key, F.lit(None).cast("string").alias("set_name"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("fraction")).limit(0)
    marked = with_dominant(queries.select(key, "contig", "start0", "end0"), intervals, width)
    every = marked.select(key, "best", F.explode(F.array(*map(F.lit, names))).alias("set_name"))
    label, fraction = dominant_of(F.col("set_name"), least)
    return every.select(key, "set_name", label.alias("label"), fraction.alias("fraction"))


def dominant_of(name: Column, least: float = 0.5) -> tuple[Column, Column]:
    """(label, fraction) of a set in `with_dominant`'s best."""
    own = F.get(F.filter("best", lambda x: x["set_name"] == name), F.lit(0))
    fraction = F.coalesce(-own["share"], F.lit(0.0))
    return F.when(fraction >= least, own["label"]).otherwise("none"), fraction


def count_points(queries: DataFrame, points: DataFrame, key: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(key, n_points): points(contig, pos) inside each query, with multiplicity; 0 where there is none. Points and the ends of queries stand in one order along the
    genome; the points before a query's end less those before its start are its own. A query makes two rows, whatever its length."""
    once = points.groupBy("contig", F.col("pos").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(1))
    events = _ends(queries, key).withColumns({"n": F.lit(0).cast("long"), "kind": F.lit(0)}).unionByName(once, allowMissingColumns=True)
    order = [F.col("contig"), F.col("at"), F.col("kind"), F.xxhash64(key)]
    before = running_sums(events, order, {"below": F.col("n")}, rows_a_range).filter("kind = 0")
    hits = before.groupBy(key).agg(F.sum(F.col("sign") * F.col("below")).alias("n_points"))
    return queries.select(key).join(hits, key, "left").select(key, F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"))


def complement(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, start0, end0): what the union of intervals leaves of contigs(contig, length)."""
    merged = merge_intervals(intervals, ("contig",))
    walls = merged.unionByName(contigs.select("contig", F.lit(0).cast("long").alias("start0"), F.lit(0).cast("long").alias("end0")))
    walls = walls.unionByName(contigs.select("contig", F.col("length").alias("start0"), F.col("length").alias("end0"))).join(contigs.select("contig"), "contig", "left_semi")
    order = W.partitionBy("contig").orderBy("start0", "end0")
    gaps = walls.select("contig", F.col("end0").alias("start0"), F.lead("start0").over(order).alias("end0"))
    return gaps.filter("end0 > start0")


def expand_mask(variants: DataFrame, pad: int = 2) -> DataFrame:
    """(contig, pos): the distinct positions within `pad` bases of variants(contig, start0, ref_len)."""
    run = F.sequence(F.col("start0") - pad, F.col("start0") + F.col("ref_len") + pad - 1)
    return variants.select("contig", F.explode(run).alias("pos")).distinct()


def outside_mask(places: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows of places(contig, pos, ...) whose position is not in mask(contig, pos)."""
    return places.join(mask.select("contig", "pos").distinct(), ["contig", "pos"], "left_anti")


def near_windows(alignments: DataFrame, windows: DataFrame, width: int = BIN) -> DataFrame:
    """Alignments that overlap any of the windows (a semi join on overlap)."""
    columns = alignments.columns
    right = merge_intervals(windows, ("contig",)).select("contig", F.col("start0").alias("r_start"), F.col("end0").alias("r_end"))
    keyed = alignments.withColumn("row_", F.struct(*columns))
    return overlap_join(keyed.select("row_", "contig", "start0", "end0"), right, width).select("row_").distinct().select("row_.*")


def complete_pairs(reads: DataFrame) -> DataFrame:
    """Reads whose name occurs with both mates."""
    both = reads.groupBy("qname").agg(F.countDistinct("mate").alias("mates")).filter("mates = 2")
    return reads.join(both, "qname", "left_semi")
