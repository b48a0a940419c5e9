"""Read quality control: filters with their accounting, and splits into calibration and held-out halves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import mean_quality, quality_unknown
from .statistics import describe


def judge_reads(reads: DataFrame, min_length: int = 1000, min_quality: float = 7.0, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """reads plus length, quality, unknown and reason (too_short before low_quality; null: kept). Reads whose qualities are all
    `!` have none, so quality cannot fail them."""
    sized = reads.withColumns({"length": F.length(seq).cast("long"), "quality": mean_quality(F.col(qual)), "unknown": F.coalesce(quality_unknown(F.col(qual)), F.lit(False))})
    reason = F.when(F.col("length") < min_length, "too_short").when((F.col("quality") < min_quality) & ~F.col("unknown"), "low_quality")
    return sized.withColumn("reason", reason)


def filter_accounting(judged: DataFrame) -> DataFrame:
    """(step, metric, value): what the reads are before and after the filters, and what each filter removed."""
    names = ["reads", "bases", "mean_length", "median_length", "n50", "median_q"]

    def stage(df: DataFrame, step: str) -> DataFrame:
        one = describe(df.withColumn("step", F.lit(step)), ["step"], "length", "quality")
        return one.select("step", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["step"], names, "metric", "value")

    total = F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")
    bases = F.greatest(F.sum("length"), F.lit(1)).cast("double")
    removed = judged.agg(
        *[(F.count_if(F.col("reason") == r) / total).alias(f"filter:{r}/reads_removed_fraction") for r in ("too_short", "low_quality")],
        *[(F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("length"))), F.lit(0)) / bases).alias(f"filter:{r}/bases_removed_fraction") for r in ("too_short", "low_quality")],
        F.nullif(F.count_if("unknown") / total, F.lit(0.0)).alias("filter:low_quality/reads_without_quality_fraction"),
    )
    tidy = removed.unpivot([], removed.columns, "name", "value").filter("value is not null")
    tidy = tidy.select(F.split_part("name", F.lit("/"), F.lit(1)).alias("step"), F.split_part("name", F.lit("/"), F.lit(2)).alias("metric"), "value")
    return reduce(DataFrame.unionByName, [stage(judged, "raw"), stage(judged.filter("reason is null"), "after_filters"), tidy])


def split_alternating(reads: DataFrame, order: str, block_rows: int = 100_000) -> DataFrame:
    """reads plus half: `calibration` for every other read in file order, `held_out` for the rest. Ranks are counted within
    ranges of the order and shifted by the ranges' totals, so no task orders all reads."""
    block = F.floor(F.col(order) / block_rows)
    totals = reads.groupBy(block.alias("block_")).agg(F.count(F.lit(1)).alias("n_"))
    shift = totals.select("block_", F.coalesce(F.sum("n_").over(W.orderBy("block_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift_"))
    rank = F.row_number().over(W.partitionBy("block_").orderBy(order)) - 1 + F.col("shift_")
    ranked = reads.withColumn("block_", block).join(shift, "block_").withColumn("half", F.when(rank % 2 == 0, "calibration").otherwise("held_out"))
    return ranked.drop("block_", "shift_")


def filter_rows(accounting: DataFrame) -> DataFrame:
    """The rows of an accounting table that are about filters."""
    return accounting.filter(F.col("step").startswith("filter"))


def inside_tolerance(checks: DataFrame, by: list[str], passed: str = "ok") -> DataFrame:
    """(by, k, n): how many of n checks are inside their tolerance; an unknown one is not."""
    return checks.groupBy(*by).agg(F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("k"), F.count(F.lit(1)).alias("n"))


#: How the report words the thresholds of each filter.
THRESHOLDS = {
    "adapter": "adapter sequence at the 3' end",
    "low_quality": "more than 40 % of bases below Q15",
    "too_many_N": "more than 5 N bases",
    "too_short": "shorter than {} bp after trimming",
    "poly_g": "poly-G tail >= 10 bp",
}


def trimming_report(report: DataFrame, min_length: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(keys, step, metric, value, threshold) rows of a cleaning tool's JSON reports, one parsed report a row."""
    total = F.greatest(F.col("summary.before_filtering.total_reads"), F.lit(1)).cast("double")
    rows = []
    for step, stage in (("raw", "before_filtering"), ("after_filters", "after_filtering")):
        for metric in ("total_reads", "total_bases", "q20_rate", "q30_rate", "read1_mean_length", "read2_mean_length", "gc_content"):
            rows.append((step, metric, F.col(f"summary.{stage}.{metric}").cast("double"), ""))
    rows.append(("raw", "duplication_rate", F.col("duplication.rate").cast("double"), ""))
    rows.append(("raw", "insert_size_peak", F.col("insert_size.peak").cast("double"), ""))
    affected = {
        "adapter": "adapter_cutting.adapter_trimmed_reads",
        "low_quality": "filtering_result.low_quality_reads",
        "too_many_N": "filtering_result.too_many_N_reads",
        "too_short": "filtering_result.too_short_reads",
    }
    for step, field in affected.items():
        rows.append((f"filter:{step}", "reads_affected_fraction", F.coalesce(F.col(field), F.lit(0)).cast("double") / total, THRESHOLDS[step].format(min_length)))
    poly_g = F.col("polyg_trimming.total_polyg_trimmed_reads").cast("double") / total
    rows.append(("filter:poly_g", "reads_affected_fraction", poly_g, THRESHOLDS["poly_g"]))
    structs = [F.struct(F.lit(s).alias("step"), F.lit(m).alias("metric"), v.alias("value"), F.lit(t).alias("threshold")) for s, m, v, t in rows]
    return report.select(*(keys or []), F.explode(F.array(*structs)).alias("x")).select(*(keys or []), "x.*").filter("value is not null")


REPORT_SCHEMA = """
summary struct<before_filtering: struct<total_reads: long, total_bases: long, q20_rate: double, q30_rate: double, read1_mean_length: double,
read2_mean_length: double, gc_content: double>, after_filtering: struct<total_reads: long, total_bases: long, q20_rate: double,
q30_rate: double, read1_mean_length: double, read2_mean_length: double, gc_content: double>>,
filtering_result struct<low_quality_reads: long, too_many_N_reads: long, too_short_reads: long>,
adapter_cutting struct<adapter_trimmed_reads: long>, duplication struct<rate: double>, insert_size struct<peak: long>,
polyg_trimming struct<total_polyg_trimmed_reads: long>
"""
