"""Scoring placements against known origins, counts, rates, calibration and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import iou, misplaced_kind, outcome, phred, unphred, wilson

CONFIDENT = 30
#: Names that a grid can have on its short side.
MOST_NAMES = 5000
KEY = ["qname", "mate"]
COUNTS = ["n", "n_correct", "n_misplaced", "n_unmapped", "n_confident", "n_confident_wrong"]
#: The MAPQ bands of the report and of the calibration curve.
REPORT_BANDS = ((0, 0), (1, 9), (10, 19), (20, 29), (30, 39), (40, 59), (60, 60))
CURVE_BANDS = ((0, 0), (1, 9), (10, 19), (20, 29), (30, 39), (40, 49), (50, 59), (60, 60))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time where a key occurs twice."""
    seen = F.count(F.lit(1)).over(W.partitionBy(*keys))
    good = F.when(seen == 1, True).otherwise(F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws("/", *keys))))
    return df.withColumn("once_", good).filter("once_").drop("once_")


def evaluate(truth: DataFrame, alignments: DataFrame, least: float = 0.1, validate: bool = False) -> DataFrame:
    """One outcome row for every read of truth; a read that a tool leaves out counts as unmapped."""
    placed = alignments.select(*KEY, "mapped", F.col("contig").alias("aln_contig"), F.col("start0").alias("aln_start"), F.col("end0").alias("aln_end"), F.col("strand").alias("aln_strand"), "mapq", "nm", "clipped", "split")
    if validate:
        truth, placed = assert_unique(truth, KEY), assert_unique(placed, KEY)
    return _scored(truth.join(placed, KEY, "left"), [], least)


def _scored(both: DataFrame, also: list[str], least: float) -> DataFrame:
    """Outcome rows of reads with one placement each, or none."""
    mapped = F.coalesce("mapped", F.lit(False))
    same = mapped & (F.col("contig") == F.col("aln_contig"))
    share = F.when(same, iou(F.col("start0"), F.col("end0"), F.col("aln_start"), F.col("aln_end"))).otherwise(0.0)
    scored = both.withColumns({"mapped": mapped, "same_": F.coalesce(same, F.lit(False)), "share_": F.coalesce(share, F.lit(0.0))})
    result = outcome(F.col("mapped"), F.col("same_"), F.col("share_"), least)
    kept = lambda name, absent: F.when(F.col("mapped"), F.col(name)).otherwise(F.lit(absent))
    return scored.select(
        *also,
        *KEY,
        result.alias("outcome"),
        F.coalesce("mapq", F.lit(0)).cast("short").alias("mapq"),
        F.col("share_").cast("float").alias("iou"),
        (F.col("mapped") & F.coalesce(F.col("strand") == F.col("aln_strand"), F.lit(False))).alias("strand_ok"),
        misplaced_kind(result, F.col("same_"), F.col("share_")).alias("misplaced_kind"),
        F.coalesce("nm", F.lit(-1)).cast("int").alias("nm"),
        F.coalesce("clipped", F.lit(0)).cast("int").alias("clipped"),
        F.coalesce("split", F.lit(False)).alias("split"),
        kept("aln_contig", "").alias("aln_contig"),
        kept("aln_start", -1).cast("long").alias("aln_start"),
        kept("aln_end", -1).cast("long").alias("aln_end"),
    )


def evaluate_all(truth: DataFrame, tools: dict[str, DataFrame], least: float = 0.1) -> DataFrame:
    """The outcome rows of every tool, with an `aligner` column. Placements of all tools are gathered by read, a few rows each, and joined to truth once."""
    fields = ["mapped", F.col("contig").alias("aln_contig"), F.col("start0").alias("aln_start"), F.col("end0").alias("aln_end"), F.col("strand").alias("aln_strand"), "mapq", "nm", "clipped", "split"]
    long = reduce(DataFrame.unionByName, [t.select(*KEY, F.struct(F.lit(name).alias("aligner"), *fields).alias("hit")) for name, t in tools.items()])
    own = long.groupBy(*KEY).agg(F.collect_list("hit").alias("hits"))
    each = truth.join(own, KEY, "left").withColumn("aligner", F.explode(F.array(*map(F.lit, tools))))
    hits = F.filter("hits", lambda x: x["aligner"] == F.col("aligner"))
    both = each.withColumn("hit", F.explode_outer(hits)).select("*", *[F.col("hit")[f].alias(f) for f in ("mapped", "aln_contig", "aln_start", "aln_end", "aln_strand", "mapq", "nm", "clipped", "split")])
    return _scored(both, ["aligner"], least)


def outcome_counts() -> list[Column]:
    mapped, wrong = F.col("outcome") != "unmapped", F.col("outcome") == "misplaced"
    confident = mapped & (F.col("mapq") >= CONFIDENT)
    tests = {"n_correct": F.col("outcome") == "correct", "n_misplaced": wrong, "n_unmapped": ~mapped, "n_confident": confident, "n_confident_wrong": confident & wrong}
    return [F.count(F.lit(1)).alias("n"), *[F.count_if(test).alias(name) for name, test in tests.items()]]


def accuracy(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of outcomes, how they shift with the overlap asked for, and correct placements on the wrong strand."""
    more = [F.count_if(F.col("iou") > F.lit(t)).alias(f"n_correct_iou{int(t * 100)}") for t in (0.5, 0.9)]
    wrong_strand = F.count_if((F.col("outcome") == "correct") & ~F.col("strand_ok")).alias("n_wrong_strand")
    return outcomes.groupBy(*by).agg(*outcome_counts(), *more, wrong_strand)


def mapq_counts(outcomes: DataFrame, by: list[str]) -> DataFrame:
    placed = outcomes.filter("outcome <> 'unmapped'")
    return placed.groupBy(*by, "mapq").agg(F.count(F.lit(1)).alias("n_mapped"), F.count_if(F.col("outcome") == "misplaced").alias("n_wrong"))


def misplaced_kinds(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.filter("outcome = 'misplaced'").groupBy(*by, "misplaced_kind").agg(F.count(F.lit(1)).alias("n"))


def strata_counts(labelled: DataFrame, by: list[str], strata: list[str]) -> DataFrame:
    """Counts for every label of every stratum column, null labels left out. Reads are counted by all labels and outcomes at once; then only those counts
    are stacked."""
    confident = (F.col("outcome") != "unmapped") & (F.col("mapq") >= CONFIDENT)
    counted = labelled.groupBy(*by, *strata, "outcome", F.coalesce(confident, F.lit(False)).alias("confident")).agg(F.count(F.lit(1)).alias("rows"))
    stacked = counted.unpivot([*by, "outcome", "confident", "rows"], strata, "stratum_set", "stratum").filter("stratum is not null")
    wrong = F.col("outcome") == "misplaced"
    tests = {"n": F.lit(True), "n_correct": F.col("outcome") == "correct", "n_misplaced": wrong, "n_unmapped": F.col("outcome") == "unmapped", "n_confident": F.col("confident"), "n_confident_wrong": F.col("confident") & wrong}
    return stacked.groupBy(*by, "stratum_set", "stratum").agg(*[F.sum(F.when(test, F.col("rows")).otherwise(0)).alias(name) for name, test in tests.items()])


def with_strata(outcomes: DataFrame, annotated: DataFrame, strata: list[str]) -> DataFrame:
    """outcomes plus the stratum columns of annotated(qname, mate, strata); a read that is not annotated keeps nulls."""
    return outcomes.join(annotated.select(*KEY, *strata), KEY, "left")


def side_by_side(counts: DataFrame, by: list[str], tools: list[str], value: str) -> DataFrame:
    """(by, tools...): one value of every tool, null where a tool has none."""
    return counts.groupBy(*by).pivot("aligner", tools).agg(F.first(value))


def add_rates(counts: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    low, high = wilson(F.col("n_misplaced"), F.col("n"))
    c_low, c_high = wilson(F.col("n_confident_wrong"), F.col("n_confident"))
    rates = {f"rate_{x}": F.col(f"n_{x}") / n for x in ("correct", "misplaced", "unmapped")}
    rates |= {"rate_misplaced_lo": low, "rate_misplaced_hi": high}
    rates |= {"rate_confident_wrong": F.try_divide(F.col("n_confident_wrong").cast("double"), F.col("n_confident")), "rate_confident_wrong_lo": c_low, "rate_confident_wrong_hi": c_high}
    return counts.withColumns(rates)


def calibration(counts: DataFrame, by: list[str]) -> DataFrame:
    """Reported MAPQ against observed errors for counts(by, mapq, n_mapped, n_wrong), one value at a time and for all
    reads from that value up."""
    pooled = counts.groupBy(*by, "mapq").agg(F.sum("n_mapped").alias("n_mapped"), F.sum("n_wrong").alias("n_wrong"))
    down = W.partitionBy(*by).orderBy(F.col("mapq").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = pooled.withColumns({"cum_mapped": F.sum("n_mapped").over(down), "cum_wrong": F.sum("n_wrong").over(down)})
    low, high = wilson(F.col("n_wrong"), F.col("n_mapped"))
    cum_low, cum_high = wilson(F.col("cum_wrong"), F.col("cum_mapped"))
    seen = F.try_divide(F.col("n_wrong").cast("double"), F.col("n_mapped"))
    return summed.withColumns(
        {
            "claimed_error": unphred(F.col("mapq")),
            "observed_error": seen,
            "observed_error_lo": low,
            "observed_error_hi": high,
            "no_errors_seen": F.col("n_wrong") == 0,
            "empirical_mapq": phred(F.when(F.col("n_wrong") == 0, high).otherwise(seen)),
            "cum_error": F.try_divide(F.col("cum_wrong").cast("double"), F.col("cum_mapped")),
            "cum_error_lo": cum_low,
            "cum_error_hi": cum_high,
        }
    )


def headline(counts: DataFrame, by: list[str]) -> DataFrame:
    """Pooled counts with rates, and how many times the claim of MAPQ 30 the confident error rate is."""
    pooled = add_rates(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]))
    return pooled.withColumns({"claimed_error_at_mapq30": F.lit(1e-3), "excess_over_claim": F.col("rate_confident_wrong") / 1e-3})


def undiverged(counts: DataFrame) -> DataFrame:
    """Rows of datasets simulated without divergence."""
    return counts.filter(F.try_to_number("divergence", F.lit("999.9999")).cast("double") == 0)


def band_of(mapq: Column, bands: tuple) -> Column:
    out = F.lit(None).cast("string")
    for low, high in bands:
        name = str(low) if low == high else f"{low}-{high}"
        out = F.when((mapq >= low) & (mapq <= high), F.lit(name)).otherwise(out)
    return out


def report_bands(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mapped and wrong reads in the report's MAPQ bands."""
    return counts.groupBy(*by, band_of(F.col("mapq"), REPORT_BANDS).alias("band")).agg(F.sum("n_mapped").alias("n_mapped"), F.sum("n_wrong").alias("n_wrong"))


def calibration_curve(counts: DataFrame, by: list[str], least_reads: int = 100) -> DataFrame:
    """Points of the calibration curve: mean MAPQ of a band, observed quality and its limits on the Phred scale."""
    grouped = counts.groupBy(*by, band_of(F.col("mapq"), CURVE_BANDS).alias("band")).agg(
        F.sum("n_mapped").alias("n_mapped"), F.sum("n_wrong").alias("n_wrong"), F.sum(F.col("mapq") * F.col("n_mapped")).alias("weighted")
    )
    low, high = wilson(F.col("n_wrong"), F.col("n_mapped"))
    seen = F.col("n_wrong") > 0
    return grouped.filter((F.col("n_mapped") >= least_reads) & F.col("band").isNotNull()).select(
        *by,
        "band",
        (F.col("weighted").cast("double") / F.col("n_mapped")).alias("x"),
        seen.alias("seen"),
        F.when(seen, phred(F.col("n_wrong").cast("double") / F.col("n_mapped"))).otherwise(phred(high)).alias("y"),
        phred(high).alias("y_lo"),
        phred(F.greatest(low, F.lit(1e-7))).alias("y_hi"),
    )


def ideal_curve(counts: DataFrame, least_reads: int = 100) -> DataFrame:
    pooled = counts.groupBy("mapq").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_wrong").alias("n_wrong"))
    return pooled.filter((F.col("n_wrong") > 0) & (F.col("n_reads") >= least_reads))


def hardest_contexts(rates: DataFrame, by: list[str], tools: list[str], top: int = 10, least_reads: int = 200) -> DataFrame:
    """The contexts with the largest misplacement rate of any tool: percent of every tool side by side, ranked."""
    wide = rates.filter(F.col("n") >= least_reads).groupBy(*by, "stratum_set", "stratum").pivot("aligner", tools).agg(F.first(F.round(F.col("rate_misplaced") * 100, 3)))
    worst = F.greatest(*[F.col(f"`{t}`") for t in tools]) if len(tools) > 1 else F.col(f"`{tools[0]}`")
    order = W.partitionBy(*by).orderBy(F.col("worst").desc_nulls_last(), "stratum_set", "stratum")
    return wide.withColumn("worst", worst).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def failure_map(rates: DataFrame, tools: list[str], least_reads: int = 100) -> DataFrame:
    """Rows of the failure map: labels other than `none`, with the baseline and the fully covered reads of repeat and
    duplication sets, and the rates of every tool."""
    cover = F.col("stratum_set").endswith("_cover")
    base = F.regexp_replace("stratum_set", "_cover$", "")
    keep = (~cover & (F.col("stratum") != "none")) | (~cover & base.isin("repeat_class", "segdup")) | (cover & (F.col("stratum") == "entire_>=95%") & base.isin("repeat_class", "segdup", "feature"))
    chosen = rates.filter(keep & (F.col("n") >= least_reads))
    return chosen.groupBy("stratum_set", "stratum").pivot("aligner", tools).agg(F.first("rate_misplaced"))


def runtimes(benchmarks: DataFrame) -> DataFrame:
    """Runs, median seconds, CPU seconds and largest memory by step and tool."""
    return benchmarks.groupBy("step", "tool").agg(F.count(F.lit(1)).alias("runs"), F.median("seconds").alias("median_seconds"), F.sum("cpu_seconds").alias("cpu_seconds"), F.max("max_rss").alias("max_rss"))


def divergence_series(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of groups that were run at more than one divergence."""
    several = counts.groupBy(*by).agg(F.countDistinct("divergence").alias("levels")).filter("levels > 1")
    return counts.join(several.drop("levels"), by, "left_semi")


def resources(benchmarks: DataFrame, platforms: DataFrame) -> DataFrame:
    """Median seconds and largest memory by platform and group of the mapping steps whose target is a dataset of platforms(target, platform)."""
    mapped = benchmarks.filter("step = 'map'").join(platforms, "target").filter("platform is not null")
    return mapped.groupBy("platform", "group").agg(F.median("seconds").alias("seconds"), F.max("max_rss").alias("max_rss"))


def dataset_pairs(simulated: DataFrame, real: DataFrame, on: list[str]) -> DataFrame:
    """(sim_id, real_id) of simulated and real datasets that agree in `on`, a genome and a platform."""
    return simulated.join(real, on).select("sim_id", "real_id")


def full_grid(counted: DataFrame, rows: DataFrame, columns: DataFrame, value: str) -> DataFrame:
    """Every row of `rows` with every row of `columns`, a name list of MOST_NAMES rows at most, and `value` of counted, 0 where nothing was counted."""
    names = [*rows.columns, *columns.columns]
    return with_names(rows, columns).join(counted, names, "left").select(*names, F.coalesce(value, F.lit(0)).alias(value))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows once for every row of a short list of names, which stands in the plan."""
    held = names.limit(MOST_NAMES + 1).collect()
    if len(held) > MOST_NAMES:
        raise ValueError("too many names for a grid")
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in held])
    return rows.withColumn("_each", F.explode(each)).select(*rows.columns, "_each.*") if held else rows.join(names, F.lit(False))
