"""Majority placements, truth-free observables and their transfer from simulated to real reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.scalars import iou
from .scoring import CONFIDENT, KEY
from .statistics import spearman, total_variation

#: The shares compared between simulated and real reads; the last is judged relative to its size.
SHARES = ("mapped_fraction", "confident_fraction", "mapq0_fraction", "clipped_reads_fraction", "split_fraction")
RATE = "edit_distance_per_base"


def long_table(tools: dict[str, DataFrame]) -> DataFrame:
    """All tools' placements in one table, with their name and place in the order."""
    columns = [*KEY, "mapped", "contig", "start0", "end0", "mapq", "nm", "read_len", "clipped", "split"]
    parts = [t.select(F.lit(name).alias("aligner"), F.lit(i).alias("place"), *columns) for i, (name, t) in enumerate(tools.items())]
    return reduce(DataFrame.unionByName, parts)


def _at(place: int):
    return lambda a: a["place"] == place


def consensus(placements: DataFrame, tools: list[str], least: float = 0.1) -> DataFrame:
    """Majority placement of every read of a long table: the placement that most tools support (ties to the earlier tool) if a
    strict majority of all tools does, with every tool's status and MAPQ.

    A read's placements are gathered once (a handful of rows: one for each tool), so pairs of tools are compared
    inside a row and nothing is joined.
    """
    one = F.struct("place", "aligner", F.coalesce("mapped", F.lit(False)).alias("mapped"), "contig", "start0", "end0", "mapq")
    # Dealt out as they are: lists begun in every task before that would be as many, and longer to write.
    rows = placements.repartition(*KEY).groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("all"))

    def agrees(a, b):
        share = iou(a["start0"], a["end0"], b["start0"], b["end0"])
        return F.coalesce(a["mapped"] & b["mapped"] & (a["contig"] == b["contig"]) & (share > least), F.lit(False))

    support = F.transform("all", lambda a: F.struct(F.size(F.filter("all", lambda b: agrees(a, b))).alias("n"), (-a["place"]).alias("first"), a.alias("own")))
    best = rows.withColumn("best", F.array_max(F.transform(support, lambda s: F.struct(s["n"].alias("n"), s["first"].alias("first"), s["own"].alias("own")))))
    found = F.col("best.n") >= len(tools) // 2 + 1
    out = [
        *KEY,
        found.alias("has_consensus"),
        F.col("best.n").cast("long").alias("support"),
        F.when(found, F.col("best.own.contig")).otherwise("").alias("contig"),
        F.when(found, F.col("best.own.start0")).otherwise(0).cast("long").alias("start0"),
        F.when(found, F.col("best.own.end0")).otherwise(0).cast("long").alias("end0"),
    ]
    for i, name in enumerate(tools):
        mine = F.get(F.filter("all", _at(i)), F.lit(0))
        status = F.when(~F.coalesce(mine["mapped"], F.lit(False)), "unmapped").when(agrees(mine, F.col("best.own")), "agree").otherwise("disagree")
        out += [status.alias(f"status_{name}"), F.coalesce(mine["mapq"], F.lit(0)).alias(f"mapq_{name}")]
    return best.select(*out)


def with_truth(majority: DataFrame, truth: DataFrame, least: float = 0.1) -> DataFrame:
    """majority plus consensus_correct, where a read has a consensus and a known origin."""
    known = truth.select(*KEY, F.col("contig").alias("t_contig"), F.col("start0").alias("t_start"), F.col("end0").alias("t_end"))
    right = (F.col("contig") == F.col("t_contig")) & (iou(F.col("start0"), F.col("end0"), F.col("t_start"), F.col("t_end")) > least)
    return majority.join(known, KEY, "left").withColumn("consensus_correct", F.col("has_consensus") & F.coalesce(right, F.lit(False))).drop("t_contig", "t_start", "t_end")


def consensus_summary(majority: DataFrame, tools: list[str], strata: list[str]) -> DataFrame:
    """Disagreement with the consensus for every tool, over all reads and by the labels of every stratum column.

    Reads that are alike in all that is counted are one row with their number before they are stacked by tool and label.
    """
    correct = F.col("consensus_correct") if "consensus_correct" in majority.columns else F.lit(False)
    sure = {f"sure_{t}": (F.col(f"mapq_{t}") >= CONFIDENT) for t in tools}
    counted = [F.col("has_consensus"), correct.alias("right"), *[F.col(f"status_{t}") for t in tools], *[c.alias(n) for n, c in sure.items()], *[F.col(c).cast("string").alias(f"stratum_{i}") for i, c in enumerate(strata)]]
    alike = majority.select(*counted).groupBy("has_consensus", "right", *[f"status_{t}" for t in tools], *sure, *[f"stratum_{i}" for i in range(len(strata))]).agg(F.count(F.lit(1)).alias("reads"))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("aligner"), F.col(f"status_{t}").alias("status"), F.col(f"sure_{t}").alias("sure")) for t in tools]))
    labels = [F.struct(F.lit("all").alias("stratum_set"), F.lit("all").alias("stratum"))] + [F.struct(F.lit(c).alias("stratum_set"), F.col(f"stratum_{i}").alias("stratum")) for i, c in enumerate(strata)]
    long = alike.select("has_consensus", "right", "reads", pairs.alias("t"), F.array(*labels).alias("labels"))
    flat = long.select("has_consensus", "right", "reads", "t.*", F.explode("labels").alias("l")).select("*", "l.*").drop("l", "labels")
    kept = flat.filter((F.col("stratum_set") == "all") | (F.col("has_consensus") & F.col("stratum").isNotNull()))
    has, off = F.col("has_consensus"), F.col("status") == "disagree"
    reads = lambda which: F.sum(F.when(which, F.col("reads")).otherwise(0))
    out = kept.groupBy("aligner", "stratum_set", "stratum").agg(
        F.sum("reads").alias("n_reads"),
        reads(~has).alias("n_no_consensus"),
        reads(F.col("status") == "unmapped").alias("n_unmapped_total"),
        reads(has).alias("n_consensus"),
        reads(has & (F.col("status") == "agree")).alias("n_agree"),
        reads(has & off).alias("n_disagree"),
        reads(has & off & F.col("sure")).alias("n_disagree_confident"),
        reads(has & (F.col("status") == "unmapped")).alias("n_unmapped"),
        reads(has & F.col("right")).alias("n_consensus_correct"),
    )
    return out if "consensus_correct" in majority.columns else out.drop("n_consensus_correct")


def observables(placements: DataFrame, by: list[str]) -> DataFrame:
    """Tidy rows (by, metric, key, value): what a tool reports whatever the truth, and its MAPQ histogram."""
    span = F.greatest((F.col("end0") - F.col("start0")).cast("double"), F.lit(1.0))
    placed = F.col("mapped")
    clip = F.col("clipped").cast("double") / F.greatest(F.col("read_len").cast("double"), F.lit(1.0))
    n = F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double")
    metrics = {
        "reads": F.count(F.lit(1)).cast("double"),
        "mapped_fraction": F.count_if(placed) / n,
        "confident_fraction": F.count_if(placed & (F.col("mapq") >= CONFIDENT)) / n,
        "mapq0_fraction": F.count_if(placed & (F.col("mapq") == 0)) / n,
        RATE: F.avg(F.when(placed & (F.col("nm") >= 0), F.col("nm").cast("double") / span)),
        "clipped_fraction_mean": F.avg(F.when(placed, clip)),
        "clipped_reads_fraction": F.avg(F.when(placed, (clip > 0.05).cast("double"))),
        "split_fraction": F.avg(F.when(placed, F.col("split").cast("double"))),
    }
    wide = placements.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])
    tidy = wide.unpivot(by, list(metrics), "metric", "value").select(*by, "metric", F.lit("").alias("key"), "value")
    bins = F.least(F.greatest(F.col("mapq").cast("int"), F.lit(0)), F.lit(60))
    histogram = placements.filter("mapped").groupBy(*by, bins.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return tidy.unionByName(histogram.select(*by, F.lit("mapq_count").alias("metric"), F.col("bin").cast("string").alias("key"), "value"))


def provider_agreement(placements: DataFrame, provider: DataFrame, least: float = 0.1) -> DataFrame:
    """How often each tool repeats the provider's placement. A read that the provider lists twice counts once, with its first
    placement by contig and start."""
    own = provider.groupBy(*KEY).agg(F.min(F.struct("contig", "start0", "end0")).alias("p"))
    both = placements.join(own, KEY)
    share = iou(F.col("start0"), F.col("end0"), F.col("p.start0"), F.col("p.end0"))
    agree = F.col("mapped") & (F.col("contig") == F.col("p.contig")) & (share > least)
    sure = F.col("mapped") & (F.col("mapq") >= CONFIDENT)
    return both.groupBy("aligner").agg(
        F.count(F.lit(1)).alias("n_compared"), F.count_if("mapped").alias("n_mapped"), F.count_if(agree).alias("n_agree_provider"), F.count_if(sure).alias("n_confident"), F.count_if(sure & ~agree).alias("n_confident_disagree_provider")
    )


def transfer_observables(tidy: DataFrame, pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Observables of pairs(simulated, real) of datasets side by side, and the distance of their MAPQ histograms."""
    paired = lambda side: tidy.join(pairs, F.col("dataset") == F.col(side)).select("simulated", "real", "aligner", "metric", "key", "value")
    sim, real = paired("simulated").withColumnRenamed("value", "s"), paired("real").withColumnRenamed("value", "r")
    by = ["simulated", "real", "aligner"]
    scalar = sim.filter(F.col("metric").isin(*SHARES, RATE)).join(real, [*by, "metric", "key"])
    gap = F.col("r") - F.col("s")
    good = F.when(F.col("metric") == RATE, F.abs(gap) <= 0.25 * F.greatest(F.col("s"), F.lit(1e-9))).otherwise(F.abs(gap) <= tolerance)
    rows = scalar.select(*by, "metric", F.col("s").alias("simulated_value"), F.col("r").alias("real_value"), gap.alias("difference"), F.coalesce(good, F.lit(False)).alias("transfers"))
    shared = sim.select(*by).distinct().join(real.select(*by).distinct(), by)
    bars = sim.filter("metric = 'mapq_count'").join(real.filter("metric = 'mapq_count'"), [*by, "metric", "key"], "full").join(shared, by, "left_semi")
    tv = total_variation(bars.select(*by, F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("r", F.lit(0.0)).alias("r")), by, "s", "r")
    far = tv.select(*by, F.lit("mapq_distribution_distance").alias("metric"), F.lit(0.0).alias("simulated_value"), F.col("tv").alias("real_value"), F.col("tv").alias("difference"), F.coalesce(F.col("tv") <= 2 * tolerance, F.lit(False)).alias("transfers"))
    return rows.unionByName(far)


def transfer_strata(truth_strata: DataFrame, summary: DataFrame, pairs: DataFrame, least_reads: int = 100) -> tuple[DataFrame, DataFrame]:
    """(joined, ranked): error and disagreement rates of matching strata in simulation and on real reads, and for each pair
    and tool their rank correlations and the median ratio of disagreement."""
    key = ["aligner", "stratum_set", "stratum"]
    side = lambda name: summary.select(F.col("dataset").alias(name), *key, F.col("n_consensus").alias(f"{name}_n"), F.col("n_disagree").alias(f"{name}_off"))
    truth = truth_strata.select(F.col("dataset").alias("simulated"), *key, "n", "n_misplaced")
    three = truth.join(pairs, "simulated").join(side("simulated"), ["simulated", *key]).join(side("real"), ["real", *key])
    enough = three.filter((F.col("n") >= least_reads) & (F.col("simulated_n") >= least_reads) & (F.col("real_n") >= least_reads))
    rates = enough.select(
        "simulated",
        "real",
        *key,
        F.try_divide(F.col("n_misplaced").cast("double"), F.col("n")).alias("sim_error"),
        F.try_divide(F.col("simulated_off").cast("double"), F.col("simulated_n")).alias("sim_disagreement"),
        F.try_divide(F.col("real_off").cast("double"), F.col("real_n")).alias("real_disagreement"),
    )
    joined = cut(rates)  # a row a stratum, read by every statistic below
    by = ["simulated", "real", "aligner"]
    proxy = spearman(joined, by, "sim_error", "sim_disagreement").select(*by, F.col("rho").alias("proxy_validity_spearman"))
    moved = spearman(joined, by, "sim_disagreement", "real_disagreement").select(*by, F.col("rho").alias("transfer_spearman"))
    ratio = (F.col("real_disagreement") + 1e-6) / (F.col("sim_disagreement") + 1e-6)
    ranked = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("strata_compared"), F.median(ratio).alias("median_ratio_real_over_sim"))
    return joined, ranked.join(proxy, by, "left").join(moved, by, "left")


def truth_free(placements: DataFrame, tools: list[str], annotations: DataFrame, sets: list[str], points: DataFrame | None = None, long_reads: bool = False, truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, observables) of one dataset, without need of an origin: majority placements, the strata of placed reads, disagreement over all
    reads and by stratum, and what the tools report. Reads without a consensus count in the whole only. With truth, the consensus is
    held against it too."""
    from . import strata

    majority = consensus(placements, tools).withColumn("read_key", F.concat_ws(":", *KEY))
    if truth is not None:
        majority = with_truth(majority, truth)
    majority = cut(majority)  # read by every step below
    marked = strata.annotate(majority.filter("has_consensus"), annotations, sets, "read_key", points, long_reads)
    columns = strata.stratum_columns(marked.columns, sets)
    whole = marked.unionByName(majority.filter(~F.col("has_consensus")), allowMissingColumns=True)
    return consensus_summary(whole, tools, columns), observables(placements, ["aligner"])
