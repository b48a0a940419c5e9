"""Registered queries: every operator applied to projections of the base tables, with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.lineage import cut, shared_folder
from ..functions import sequence as sq
from ..operators import consensus as co
from ..operators import intervals as iv
from ..operators import names as nm
from ..operators import profile as pf
from ..operators import qc, scoring, strata
from ..operators import statistics as st
from ..operators import variants as va
from ..sources import annotations as an
from ..sources import reads as rd
from ..sources import tables as tb
from . import config
from . import fixtures as fx
from .fixtures import TOOLS, oracle, table
from .registry import ORACLES, QUERIES, query

WILSON = """
  round(CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 THEN 0 ELSE greatest(0, ({k}::DOUBLE/{n} + 3.841458820694124/2/{n} - 1.959963984540054*sqrt({k}::DOUBLE/{n}*(1-{k}::DOUBLE/{n})/{n} + 3.841458820694124/4/{n}/{n})) / (1 + 3.841458820694124/{n})) END, 6) AS {out}_lo,
  round(CASE WHEN {n} = 0 THEN NULL WHEN {k} = {n} THEN 1 ELSE least(1, ({k}::DOUBLE/{n} + 3.841458820694124/2/{n} + 1.959963984540054*sqrt({k}::DOUBLE/{n}*(1-{k}::DOUBLE/{n})/{n} + 3.841458820694124/4/{n}/{n})) / (1 + 3.841458820694124/{n})) END, 6) AS {out}_hi"""
WILSON = WILSON.replace("3.841458820694124", "(1.959963984540054*1.959963984540054)").replace("1.959963984540054", "1.959963984540054::DOUBLE")
COUNTED = """count(*) AS n, count(*) FILTER (outcome = 'correct') AS n_correct, count(*) FILTER (outcome = 'misplaced') AS n_misplaced,
  count(*) FILTER (outcome = 'unmapped') AS n_unmapped, count(*) FILTER (outcome <> 'unmapped' AND mapq >= 30) AS n_confident, count(*) FILTER (outcome = 'misplaced' AND mapq >= 30) AS n_confident_wrong"""
RATES = f"""round(n_correct::DOUBLE / greatest(n, 1), 6) AS rate_correct, round(n_misplaced::DOUBLE / greatest(n, 1), 6) AS rate_misplaced, round(n_unmapped::DOUBLE / greatest(n, 1), 6) AS rate_unmapped,
  {WILSON.format(k="n_misplaced", n="n", out="rate_misplaced")}, round(n_confident_wrong::DOUBLE / nullif(n_confident, 0), 6) AS rate_confident_wrong, {WILSON.format(k="n_confident_wrong", n="n_confident", out="rate_confident_wrong")}"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.evaluate_all(fx.truth(spark, sf_dir), fx.tools(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with the stratum labels of their reads."""
    truth = fx.truth(spark, sf_dir)
    marked = strata.annotate(truth, fx.annotations(spark, sf_dir), ["ptype", "conf"], "rid")
    return scoring.with_strata(_outcomes(spark, sf_dir), marked, STRATA)


def _placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.long_table(fx.tools(spark, sf_dir))


STRATA = ["ptype", "ptype_cover", "conf", "conf_cover"]

# Scoring and report tables ------------------------------------------------------------------------------------------


@query("headline", oracle(f"SELECT aligner, {', '.join(scoring.COUNTS)}, {RATES}, 0.001::DOUBLE AS claimed_error_at_mapq30, round(n_confident_wrong::DOUBLE / nullif(n_confident, 0) / 0.001::DOUBLE, 6) AS excess_over_claim FROM (SELECT aligner, {COUNTED} FROM scored GROUP BY aligner)", "scored"))
def headline(spark, sf_dir):
    """JOI-01, SCA-31, AGG-01, AGG-06, AGG-08: the flagship, from truth and placements to pooled rates."""
    return scoring.headline(scoring.accuracy(_outcomes(spark, sf_dir), ["aligner"]), ["aligner"])


@query(
    "joi01_evaluate",
    oracle(
        "SELECT aligner, qname, mate, outcome, mapq, iou, strand_ok, misplaced_kind, nm, clipped, split, CASE WHEN mapped THEN a_contig ELSE '' END AS aln_contig, CASE WHEN mapped THEN a_start ELSE -1 END AS aln_start, CASE WHEN mapped THEN a_end ELSE -1 END AS aln_end FROM kinds WHERE aligner = 't0'",
        "kinds",
    ),
)
def evaluate(spark, sf_dir):
    """JOI-01, SCA-06, SCA-31..33: outcome rows of one tool, keys checked."""
    return scoring.evaluate(fx.truth(spark, sf_dir), fx.aln(spark, sf_dir, 0), validate=True).withColumn("aligner", F.lit("t0"))


@query("agg01_02_accuracy", oracle(f"SELECT aligner, {COUNTED}, count(*) FILTER (iou > 0.5) AS n_correct_iou50, count(*) FILTER (iou::DOUBLE > 0.9::DOUBLE) AS n_correct_iou90, count(*) FILTER (outcome = 'correct' AND NOT strand_ok) AS n_wrong_strand FROM scored GROUP BY aligner", "scored"))
def accuracy(spark, sf_dir):
    return scoring.accuracy(_outcomes(spark, sf_dir), ["aligner"])


@query("agg03_mapq_counts", oracle("SELECT * FROM per_mapq", "per_mapq"))
def mapq_counts(spark, sf_dir):
    return scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"])


@query("agg04_misplaced_kinds", oracle("SELECT aligner, misplaced_kind, count(*) AS n FROM kinds WHERE outcome = 'misplaced' GROUP BY ALL", "kinds"))
def misplaced_kinds(spark, sf_dir):
    return scoring.misplaced_kinds(_outcomes(spark, sf_dir), ["aligner"])


@query("agg05_strata_counts", oracle("SELECT * FROM strata", "strata"))
def strata_counts(spark, sf_dir):
    """JOI-02, AGG-05: counts for every label of every stratum column in one pass."""
    return scoring.strata_counts(_labelled(spark, sf_dir), ["aligner"], STRATA)


@query("agg06_rates", oracle(f"SELECT *, {RATES} FROM strata", "strata"))
def strata_rates(spark, sf_dir):
    return scoring.add_rates(scoring.strata_counts(_labelled(spark, sf_dir), ["aligner"], STRATA))


CALIBRATION = oracle(
    f"""SELECT aligner, mapq, n_mapped, n_wrong, cum_mapped, cum_wrong, round(power(10, -mapq / 10::DOUBLE), 6) AS claimed_error, round(n_wrong::DOUBLE / n_mapped, 6) AS observed_error,
    {WILSON.format(k="n_wrong", n="n_mapped", out="observed_error")}, n_wrong = 0 AS no_errors_seen,
    round(-10 * log10(greatest(least(CASE WHEN n_wrong = 0 THEN (1.959963984540054*1.959963984540054)/n_mapped/(1 + (1.959963984540054*1.959963984540054)/n_mapped) ELSE n_wrong::DOUBLE / n_mapped END, 1), 1e-10)), 6) AS empirical_mapq,
    round(cum_wrong::DOUBLE / cum_mapped, 6) AS cum_error, {WILSON.format(k="cum_wrong", n="cum_mapped", out="cum_error")}
    FROM (SELECT *, sum(n_mapped) OVER w::BIGINT AS cum_mapped, sum(n_wrong) OVER w::BIGINT AS cum_wrong FROM per_mapq WINDOW w AS (PARTITION BY aligner ORDER BY mapq DESC ROWS UNBOUNDED PRECEDING))""",
    "per_mapq",
).replace("sum(n_mapped) OVER w::BIGINT", "CAST(sum(n_mapped) OVER w AS BIGINT)").replace("sum(n_wrong) OVER w::BIGINT", "CAST(sum(n_wrong) OVER w AS BIGINT)").replace("(1.959963984540054*1.959963984540054)/n_mapped", "(1.959963984540054::DOUBLE*1.959963984540054::DOUBLE)/n_mapped")


@query("agg07_calibration", CALIBRATION)
def calibration(spark, sf_dir):
    return scoring.calibration(scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"]), ["aligner"])


@query("agg09_undiverged", "SELECT '0' AS divergence, o_custkey % 7 AS x, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL")
def undiverged(spark, sf_dir):
    """AGG-09: only the datasets without divergence are pooled."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 3 == 0, "0").otherwise("0.05").alias("divergence"), (F.col("o_custkey") % 7).alias("x"))
    return scoring.undiverged(rows.groupBy("divergence", "x").agg(F.count(F.lit(1)).alias("n")))


BAND = "CASE WHEN mapq = 0 THEN '0' WHEN mapq <= 9 THEN '1-9' WHEN mapq <= 19 THEN '10-19' WHEN mapq <= 29 THEN '20-29' WHEN mapq <= 39 THEN '30-39' WHEN mapq <= {a} THEN '40-{a}' {b} WHEN mapq = 60 THEN '60' END"


@query("agg14_report_bands", oracle(f"SELECT aligner, {BAND.format(a=59, b='')} AS band, sum(n_mapped)::BIGINT AS n_mapped, sum(n_wrong)::BIGINT AS n_wrong FROM per_mapq GROUP BY ALL", "per_mapq"))
def report_bands(spark, sf_dir):
    return scoring.report_bands(scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"]), ["aligner"])


@query(
    "agg14_calibration_curve",
    oracle(
        f"""SELECT aligner, band, round(weighted / n_mapped, 6) AS x, n_wrong > 0 AS seen, round(-10 * log10(CASE WHEN n_wrong > 0 THEN n_wrong::DOUBLE / n_mapped ELSE hi END), 6) AS y,
    round(-10 * log10(greatest(hi, 1e-10)), 6) AS y_lo, round(-10 * log10(greatest(lo, 1e-7)), 6) AS y_hi FROM (
      SELECT *, {WILSON.format(k="n_wrong", n="n_mapped", out="w").replace("AS w_lo", "AS lo").replace("AS w_hi", "AS hi").replace(", 6)", ", 15)")} FROM (
        SELECT aligner, {BAND.format(a=49, b="WHEN mapq <= 59 THEN '50-59'")} AS band, sum(n_mapped)::BIGINT AS n_mapped, sum(n_wrong)::BIGINT AS n_wrong, sum(mapq * n_mapped)::DOUBLE AS weighted FROM per_mapq GROUP BY ALL)
      WHERE n_mapped >= 100 AND band IS NOT NULL)""",
        "per_mapq",
    ),
)
def calibration_curve(spark, sf_dir):
    return scoring.calibration_curve(scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"]), ["aligner"])


@query(
    "agg15_hardest_contexts",
    oracle(
        """SELECT stratum_set, stratum, t0, t1, t2, t3, worst, place, 'g' AS genome FROM (
    SELECT *, greatest(t0, t1, t2, t3) AS worst, row_number() OVER (ORDER BY greatest(t0, t1, t2, t3) DESC NULLS LAST, stratum_set, stratum) AS place FROM (
      SELECT stratum_set, stratum, """
        + ", ".join(f"max(CASE WHEN aligner = 't{k}' THEN round(n_misplaced::DOUBLE / n * 100, 3) END) AS t{k}" for k in range(4))
        + " FROM strata WHERE n >= 200 GROUP BY ALL)) WHERE place <= 10",
        "strata",
    ),
)
def hardest_contexts(spark, sf_dir):
    rates = scoring.add_rates(scoring.strata_counts(_labelled(spark, sf_dir), ["aligner"], STRATA)).withColumn("genome", F.lit("g"))
    return scoring.hardest_contexts(rates, ["genome"], TOOLS)


@query(
    "agg32_failure_map",
    oracle(
        "SELECT stratum_set, stratum, " + ", ".join(f"max(CASE WHEN aligner = 't{k}' THEN round(n_misplaced::DOUBLE / n, 6) END) AS t{k}" for k in range(4)) + " FROM (SELECT CASE WHEN stratum_set LIKE 'ptype%' THEN replace(stratum_set, 'ptype', 'repeat_class') ELSE stratum_set END AS stratum_set, stratum, aligner, n, n_misplaced FROM strata) WHERE n >= 100 AND ((stratum_set NOT LIKE '%\\_cover' ESCAPE '\\' AND (stratum <> 'none' OR stratum_set = 'repeat_class')) OR (stratum_set = 'repeat_class_cover' AND stratum = 'entire_>=95%')) GROUP BY ALL",
        "strata",
    ),
)
def failure_map(spark, sf_dir):
    """AGG-32, PIV-01: rows of the failure map, tools side by side."""
    counts = scoring.strata_counts(_labelled(spark, sf_dir), ["aligner"], STRATA)
    renamed = counts.withColumn("stratum_set", F.regexp_replace("stratum_set", "^ptype", "repeat_class"))
    return scoring.failure_map(scoring.add_rates(renamed), TOOLS)


@query("agg16_runtimes", "SELECT l_returnflag AS step, l_linestatus AS tool, count(*) AS runs, round(median(l_quantity), 6) AS median_seconds, round(sum(l_tax), 4) AS cpu_seconds, round(max(l_discount), 6) AS max_rss FROM lineitem GROUP BY ALL")
def runtimes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("tool"), F.col("l_quantity").alias("seconds"), F.col("l_tax").alias("cpu_seconds"), F.col("l_discount").alias("max_rss"))
    return scoring.runtimes(rows).withColumn("cpu_seconds", F.round("cpu_seconds", 4))


@query("agg17_divergence_series", "SELECT * FROM (SELECT o_custkey % 50 AS g, o_orderpriority AS divergence, count(*) AS n FROM orders GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY g) > 1")
def divergence_series(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("divergence")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.divergence_series(rows, ["g"])


@query("agg18_ideal_curve", oracle("SELECT mapq, sum(n_mapped)::BIGINT AS n_reads, sum(n_wrong)::BIGINT AS n_wrong FROM per_mapq GROUP BY mapq HAVING sum(n_wrong) > 0 AND sum(n_mapped) >= 100", "per_mapq"))
def ideal_curve(spark, sf_dir):
    return scoring.ideal_curve(scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"]).withColumnRenamed("n_mapped", "n_reads"))


# Intervals and strata ------------------------------------------------------------------------------------------------


@query("int01_merge", oracle("SELECT * FROM merged", "merged"))
def merge(spark, sf_dir):
    return iv.merge_intervals(fx.annotations(spark, sf_dir), ("set_name", "label", "contig"))


@query("int02_joi08_coverage", oracle("SELECT rid, set_name, label, covered FROM covered", "covered"))
def coverage(spark, sf_dir):
    return iv.coverage(fx.truth(spark, sf_dir), fx.annotations(spark, sf_dir), "rid")


@query("int02_swept_coverage", oracle("SELECT rid, set_name, label, covered FROM covered", "covered"))
def swept_coverage(spark, sf_dir):
    """INT-02: the same from running sums along the genome, as for queries of any length."""
    return iv.coverage(fx.truth(spark, sf_dir), fx.annotations(spark, sf_dir), "rid", long_query=1)


@query("int03_dominant_label", oracle("SELECT rid, set_name, label, round(fraction, 6) AS fraction FROM dominant", "dominant"))
def dominant(spark, sf_dir):
    return iv.dominant_labels(fx.truth(spark, sf_dir), fx.annotations(spark, sf_dir), "rid")


@query("int04_joi09_count_points", oracle("SELECT t.rid, count(p.pos) AS n_points FROM truth t LEFT JOIN points p ON p.contig = t.contig AND p.pos >= t.start0 AND p.pos < t.end0 GROUP BY t.rid", "truth", "points"))
def count_points(spark, sf_dir):
    return iv.count_points(fx.truth(spark, sf_dir), fx.points(spark, sf_dir), "rid")


@query("int05_build_strata", oracle("SELECT set_name, count(*) AS records_in, count(*) FILTER (contig <> 'chr4') AS records_kept, count(*) FILTER (contig = 'chr4') AS off_reference, sum(CASE WHEN contig <> 'chr4' THEN end0 - start0 ELSE 0 END)::BIGINT AS bases FROM annot GROUP BY set_name", "annot"))
def build_strata(spark, sf_dir):
    """INT-05: resolved against a reference without chr4; names come without their prefix."""
    parsed = fx.annotations(spark, sf_dir).withColumn("contig", F.regexp_replace("contig", "^chr", ""))
    reference = spark.createDataFrame([(f"chr{i}",) for i in range(4)], "name string")
    return strata.build_strata(parsed, nm.name_table(reference), reference.select(F.col("name").alias("contig"), F.lit(1_000_000).cast("long").alias("length")))[1]


@query(
    "int06_complement",
    oracle(
        """SELECT contig, start0, end0 FROM (
    SELECT contig, e AS start0, lead(s) OVER (PARTITION BY contig ORDER BY s, e) AS end0 FROM (
      SELECT contig, min(start0) AS s, max(end0) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS block FROM (
        SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY contig ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM annot)) GROUP BY contig, block
      UNION ALL SELECT DISTINCT contig, 0, 0 FROM annot UNION ALL SELECT DISTINCT contig, 200000, 200000 FROM annot)) WHERE end0 > start0""",
        "annot",
    ),
)
def complement(spark, sf_dir):
    annot = fx.annotations(spark, sf_dir)
    return iv.complement(annot, annot.select("contig").distinct().withColumn("length", F.lit(200_000).cast("long")))


@query("int07_expand_mask", oracle("SELECT DISTINCT contig, unnest(range(pos - 2, pos + pos % 4 + 3)) AS pos FROM points", "points"))
def expand_mask(spark, sf_dir):
    return iv.expand_mask(fx.points(spark, sf_dir).select("contig", F.col("pos").alias("start0"), (F.col("pos") % 4 + 1).alias("ref_len")))


@query(
    "int08_annotate",
    oracle(
        """SELECT t.rid, p.label AS ptype, p.cover AS ptype_cover, c.label AS conf, c.cover AS conf_cover, n.var_count,
    CASE WHEN d <= 0 THEN '0' WHEN d < 2 THEN '0-2/kb' WHEN d < 5 THEN '2-5/kb' WHEN d < 10 THEN '5-10/kb' ELSE '>=10/kb' END AS variant_density,
    CASE WHEN gc < 0.3::DOUBLE THEN '<30%' WHEN gc < 0.4::DOUBLE THEN '30-40%' WHEN gc < 0.5::DOUBLE THEN '40-50%' WHEN gc < 0.6::DOUBLE THEN '50-60%' WHEN gc < 0.7::DOUBLE THEN '60-70%' ELSE '>=70%' END AS gc_content,
    '<500' AS read_length, '0.05' AS divergence
    FROM (SELECT *, (rid % 100)::DOUBLE / 100 AS gc FROM truth) t JOIN labels2 p ON p.rid = t.rid AND p.set_name = 'ptype' JOIN labels2 c ON c.rid = t.rid AND c.set_name = 'conf'
    JOIN (SELECT t.rid, count(p.pos) AS var_count, count(p.pos)::DOUBLE / any_value(t.end0 - t.start0) * 1000 AS d FROM truth t LEFT JOIN points p ON p.contig = t.contig AND p.pos >= t.start0 AND p.pos < t.end0 GROUP BY t.rid) n ON n.rid = t.rid""",
        "truth",
        "labels2",
        "points",
    ),
)
def annotate(spark, sf_dir):
    """INT-08, SCA-13..16, SCA-34: every stratum column of every read."""
    truth = fx.truth(spark, sf_dir).withColumn("gc", (F.col("rid") % 100).cast("double") / 100)
    out = strata.annotate(truth, fx.annotations(spark, sf_dir), ["ptype", "conf"], "rid", fx.points(spark, sf_dir), long_reads=True, divergence="0.05")
    return out.select("rid", *strata.stratum_columns(out.columns, ["ptype", "conf"]), "var_count", "divergence")


@query("joi12_masked_positions", oracle("SELECT DISTINCT contig, start0 AS pos FROM truth WHERE (contig, start0) NOT IN (SELECT contig, pos FROM points)", "truth", "points"))
def masked(spark, sf_dir):
    """JOI-12: positions outside a mask."""
    return iv.outside_mask(fx.truth(spark, sf_dir).select("contig", F.col("start0").alias("pos")).distinct(), fx.points(spark, sf_dir))


@query("src21_near_windows", oracle("SELECT qname, mate, contig, start0, end0 FROM aln0 a WHERE EXISTS (SELECT 1 FROM annot w WHERE w.set_name = 'conf' AND w.contig = a.contig AND w.start0 < a.end0 AND a.start0 < w.end0)", "aln0", "annot"))
def near_windows(spark, sf_dir):
    """SRC-21: alignments inside chosen windows."""
    reads = fx.aln(spark, sf_dir, 0).select("qname", "mate", "contig", "start0", "end0")
    return iv.near_windows(reads, fx.annotations(spark, sf_dir).filter("set_name = 'conf'"))


@query("src21_complete_pairs", "SELECT qname, mate FROM (SELECT DISTINCT (l_orderkey)::VARCHAR AS qname, l_linenumber % 2 + 1 AS mate FROM lineitem) QUALIFY count(*) OVER (PARTITION BY qname) = 2")
def complete_pairs(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("qname"), (F.col("l_linenumber") % 2 + 1).alias("mate")).distinct()
    return iv.complete_pairs(reads)


# Consensus and transfer ----------------------------------------------------------------------------------------------


@query("maj01_consensus", oracle("SELECT * FROM majority", "majority"))
def majority(spark, sf_dir):
    """MAJ-01, JOI-03, JOI-10: majority placements and every tool's status."""
    return co.consensus(_placements(spark, sf_dir), TOOLS)


SUMMARY = """count(*) AS n_reads, count(*) FILTER (NOT has_consensus) AS n_no_consensus, count(*) FILTER (status = 'unmapped') AS n_unmapped_total, count(*) FILTER (has_consensus) AS n_consensus,
  count(*) FILTER (has_consensus AND status = 'agree') AS n_agree, count(*) FILTER (has_consensus AND status = 'disagree') AS n_disagree, count(*) FILTER (has_consensus AND status = 'disagree' AND mapq >= 30) AS n_disagree_confident,
  count(*) FILTER (has_consensus AND status = 'unmapped') AS n_unmapped"""
STATUSES = " UNION ALL ".join(f"SELECT 't{k}' AS aligner, status_t{k} AS status, mapq_t{k} AS mapq, * FROM majority" for k in range(4))


@query(
    "agg10_maj02_consensus_summary",
    oracle(
        f"""SELECT aligner, 'all' AS stratum_set, 'all' AS stratum, {SUMMARY}, count(*) FILTER (right_) AS n_consensus_correct FROM x GROUP BY aligner
    UNION ALL SELECT aligner, 'contig', contig, {SUMMARY}, count(*) FILTER (right_) FROM x WHERE has_consensus GROUP BY aligner, contig""".replace(
            "FROM x", f"FROM (SELECT m.*, has_consensus AND m.contig = t.contig AND greatest(0, least(m.end0, t.end0) - greatest(m.start0, t.start0))::DOUBLE / (greatest(m.end0, t.end0) - least(m.start0, t.start0)) > 0.1::DOUBLE AS right_ FROM ({STATUSES}) m JOIN truth t ON t.qname = m.qname AND t.mate = m.mate)"
        ),
        "majority",
        "truth",
    ),
)
def consensus_summary(spark, sf_dir):
    """MAJ-02, JOI-04, AGG-10: disagreement with the consensus, over all reads and by contig, with the consensus held against truth."""
    return co.consensus_summary(co.with_truth(co.consensus(_placements(spark, sf_dir), TOOLS), fx.truth(spark, sf_dir)), TOOLS, ["contig"])


OBSERVED = """SELECT aligner, unnest(['reads', 'mapped_fraction', 'confident_fraction', 'mapq0_fraction', 'edit_distance_per_base', 'clipped_fraction_mean', 'clipped_reads_fraction', 'split_fraction']) AS metric, '' AS key,
  round(unnest([count(*)::DOUBLE, count(*) FILTER (mapped)::DOUBLE / count(*), count(*) FILTER (mapped AND mapq >= 30)::DOUBLE / count(*), count(*) FILTER (mapped AND mapq = 0)::DOUBLE / count(*),
    avg(nm::DOUBLE / (end0 - start0)) FILTER (mapped AND nm >= 0), avg(clipped::DOUBLE / read_len) FILTER (mapped), avg((clipped::DOUBLE / read_len > 0.05::DOUBLE)::INT) FILTER (mapped), avg(split::INT) FILTER (mapped)]), 6) AS value FROM placements GROUP BY aligner
  UNION ALL SELECT aligner, 'mapq_count', least(greatest(mapq, 0), 60)::VARCHAR, count(*)::DOUBLE FROM placements WHERE mapped GROUP BY ALL"""


@query("agg11_12_observables", oracle(OBSERVED, "placements"))
def observables(spark, sf_dir):
    return co.observables(_placements(spark, sf_dir), ["aligner"])


@query(
    "agg13_joi05_provider",
    oracle(
        """SELECT aligner, count(*) AS n_compared, count(*) FILTER (mapped) AS n_mapped, count(*) FILTER (ok) AS n_agree_provider, count(*) FILTER (mapped AND mapq >= 30) AS n_confident, count(*) FILTER (mapped AND mapq >= 30 AND NOT ok) AS n_confident_disagree_provider
    FROM (SELECT a.*, a.mapped AND a.contig = p.contig AND greatest(0, least(a.end0, p.end0) - greatest(a.start0, p.start0))::DOUBLE / (greatest(a.end0, p.end0) - least(a.start0, p.start0)) > 0.1::DOUBLE AS ok FROM placements a JOIN provider p USING (qname, mate)) GROUP BY aligner""",
        "placements",
        "provider",
    ),
)
def provider(spark, sf_dir):
    return co.provider_agreement(_placements(spark, sf_dir), fx.provider(spark, sf_dir))


def _tidy(spark, sf_dir):
    """Observables of a simulated and a real dataset: reads with even and odd names."""
    halves = _placements(spark, sf_dir).withColumn("dataset", F.when(F.col("qname").cast("long") % 2 == 0, "sim").otherwise("real"))
    return co.observables(halves, ["dataset", "aligner"])


PAIRS = "simulated string, real string"
HALVES = OBSERVED.replace("SELECT aligner,", "SELECT CASE WHEN qname::BIGINT % 2 = 0 THEN 'sim' ELSE 'real' END AS dataset, aligner,").replace("GROUP BY aligner", "GROUP BY 1, aligner").replace(", 6) AS value", ", 15) AS value")


@query(
    "agg30_joi07_transfer_observables",
    oracle(
        f"""SELECT 'sim' AS simulated, 'real' AS real, aligner, metric, round(s, 6) AS simulated_value, round(r, 6) AS real_value, round(r - s, 6) AS difference,
      CASE WHEN metric = 'edit_distance_per_base' THEN abs(r - s) <= 0.25 * greatest(s, 1e-9) ELSE abs(r - s) <= 0.05::DOUBLE END AS transfers
      FROM (SELECT aligner, metric, max(CASE WHEN dataset = 'sim' THEN value END) AS s, max(CASE WHEN dataset = 'real' THEN value END) AS r FROM ({HALVES})
        WHERE metric IN ('mapped_fraction', 'confident_fraction', 'mapq0_fraction', 'edit_distance_per_base', 'clipped_reads_fraction', 'split_fraction') GROUP BY ALL)
    UNION ALL SELECT 'sim', 'real', aligner, 'mapq_distribution_distance', 0, round(tv, 6), round(tv, 6), tv <= 0.1::DOUBLE FROM (SELECT aligner, sum(abs(s / ss - r / rr)) / 2 AS tv FROM (
      SELECT *, sum(s) OVER (PARTITION BY aligner) AS ss, sum(r) OVER (PARTITION BY aligner) AS rr FROM (SELECT aligner, key, coalesce(max(CASE WHEN dataset = 'sim' THEN value END), 0) AS s, coalesce(max(CASE WHEN dataset = 'real' THEN value END), 0) AS r FROM ({HALVES}) WHERE metric = 'mapq_count' GROUP BY ALL)) GROUP BY aligner)""",
        "placements",
    ),
)
def transfer_observables(spark, sf_dir):
    return co.transfer_observables(_tidy(spark, sf_dir), spark.createDataFrame([("sim", "real")], PAIRS))


def _transfer(spark, sf_dir):
    truth = fx.truth(spark, sf_dir)
    marked = cut(strata.annotate(truth, fx.annotations(spark, sf_dir), ["ptype"], "rid").select("qname", "mate", "ptype"))
    labelled = scoring.with_strata(_outcomes(spark, sf_dir), marked, ["ptype"])
    known = scoring.strata_counts(labelled.withColumn("dataset", F.lit("sim")), ["dataset", "aligner"], ["ptype"])
    majority = cut(co.consensus(_placements(spark, sf_dir), TOOLS).join(marked, ["qname", "mate"], "left"))
    halves = [co.consensus_summary(majority.filter(F.col("qname").cast("long") % 2 == k), TOOLS, ["ptype"]).withColumn("dataset", F.lit(name)) for k, name in enumerate(("sim", "real"))]
    return co.transfer_strata(known, halves[0].unionByName(halves[1]), spark.createDataFrame([("sim", "real")], PAIRS), least_reads=20)


TRANSFER = f"""SELECT 'sim' AS simulated, 'real' AS real, t.aligner, 'ptype' AS stratum_set, t.stratum, t.n_misplaced::DOUBLE / t.n AS sim_error, s.n_disagree::DOUBLE / s.n_consensus AS sim_disagreement, r.n_disagree::DOUBLE / r.n_consensus AS real_disagreement
  FROM (SELECT * FROM strata WHERE stratum_set = 'ptype') t JOIN h s ON s.aligner = t.aligner AND s.stratum = t.stratum AND s.half = 0 JOIN h r ON r.aligner = t.aligner AND r.stratum = t.stratum AND r.half = 1
  WHERE t.n >= 20 AND s.n_consensus >= 20 AND r.n_consensus >= 20""".replace(
    " h ", f" (SELECT aligner, p.label AS stratum, m.qname::BIGINT % 2 AS half, count(*) AS n_consensus, count(*) FILTER (status = 'disagree') AS n_disagree FROM ({STATUSES}) m JOIN truth t ON t.qname = m.qname JOIN labels2 p ON p.rid = t.rid AND p.set_name = 'ptype' WHERE has_consensus GROUP BY ALL) "
)


@query("joi06_transfer_rates", oracle(f"SELECT simulated, real, aligner, stratum_set, stratum, round(sim_error, 6) AS sim_error, round(sim_disagreement, 6) AS sim_disagreement, round(real_disagreement, 6) AS real_disagreement FROM ({TRANSFER})", "strata", "majority", "truth", "labels2"))
def transfer_rates(spark, sf_dir):
    return _transfer(spark, sf_dir)[0]


RHO = "CASE WHEN count(*) >= 3 THEN round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) END"
RANKED = ", ".join(f"(rank() OVER (PARTITION BY aligner ORDER BY {c}) + (count(*) OVER (PARTITION BY aligner, {c}) - 1) / 2.0)::DOUBLE AS {n}" for c, n in (("sim_error", "a"), ("sim_disagreement", "b"), ("real_disagreement", "c")))


@query(
    "agg26_29_31_transfer_strata",
    oracle(
        f"""SELECT simulated, real, aligner, count(*) AS strata_compared, round(median((real_disagreement + 1e-6) / (sim_disagreement + 1e-6)), 6) AS median_ratio_real_over_sim,
    {RHO.format(a="a", b="b")} AS proxy_validity_spearman, {RHO.format(a="b", b="c")} AS transfer_spearman FROM (SELECT *, {RANKED} FROM ({TRANSFER})) GROUP BY simulated, real, aligner""",
        "strata",
        "majority",
        "truth",
        "labels2",
    ),
)
def transfer_strata(spark, sf_dir):
    return _transfer(spark, sf_dir)[1]


@query("joi13_dataset_pairs", "SELECT s.o_orderkey AS sim_id, r.o_orderkey AS real_id FROM orders s JOIN orders r ON s.o_custkey = r.o_custkey AND s.o_orderpriority = r.o_orderpriority AND s.o_orderstatus = 'O' AND r.o_orderstatus = 'F'")
def dataset_pairs(spark, sf_dir):
    """JOI-13: simulated and real datasets of one genome and platform."""
    orders = table(spark, sf_dir, "orders")
    sim = orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("sim_id"), "o_custkey", "o_orderpriority")
    real = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("real_id"), "o_custkey", "o_orderpriority")
    return scoring.dataset_pairs(sim, real, ["o_custkey", "o_orderpriority"])


@query("joi15_grid", oracle("SELECT a.aligner, c.contig, count(s.qname) AS n FROM (SELECT unnest(['t0', 't1', 't2', 't3', 't9']) AS aligner) a CROSS JOIN (SELECT DISTINCT contig FROM truth) c LEFT JOIN scored s ON s.aligner = a.aligner AND s.contig = c.contig AND s.outcome = 'misplaced' GROUP BY ALL", "scored", "truth"))
def grid(spark, sf_dir):
    """JOI-15: every tool with every genome (here contig), 0 where nothing was counted."""
    tools = spark.createDataFrame([(t,) for t in [*TOOLS, "t9"]], "aligner string")
    origin = fx.truth(spark, sf_dir).select("qname", "mate", "contig")
    counted = _outcomes(spark, sf_dir).filter("outcome = 'misplaced'").join(origin, ["qname", "mate"]).groupBy("aligner", "contig").agg(F.count(F.lit(1)).alias("k"))
    return scoring.full_grid(counted.withColumnRenamed("k", "n"), tools, origin.select("contig").distinct(), "n")


# Statistics ----------------------------------------------------------------------------------------------------------


@query(
    "agg24_ks",
    "SELECT l_returnflag AS g, round(max(abs(a::DOUBLE / aa - b::DOUBLE / bb)), 6) AS ks FROM (SELECT l_returnflag, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a) OVER (PARTITION BY l_returnflag) AS aa, sum(b) OVER (PARTITION BY l_returnflag) AS bb FROM (SELECT l_returnflag, l_extendedprice AS x, count(*) FILTER (l_linenumber % 2 = 0) AS a, count(*) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)) GROUP BY ALL",
)
def ks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), (F.col("l_linenumber") % 2 == 0).alias("side"))
    return st.ks_distance(rows, ["g"], "x", "side")


@query("agg25_total_variation", "SELECT l_linestatus AS g, round(sum(abs(p / pp - q / qq)) / 2, 6) AS tv FROM (SELECT *, sum(p) OVER (PARTITION BY l_linestatus) AS pp, sum(q) OVER (PARTITION BY l_linestatus) AS qq FROM (SELECT l_linestatus, l_quantity, count(*) FILTER (l_linenumber < 4)::DOUBLE AS p, count(*) FILTER (l_linenumber >= 4)::DOUBLE AS q FROM lineitem GROUP BY ALL)) GROUP BY ALL")
def total_variation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g"), "l_quantity").agg(F.count_if(F.col("l_linenumber") < 4).alias("p"), F.count_if(F.col("l_linenumber") >= 4).alias("q"))
    return st.total_variation(rows, ["g"], "p", "q")


@query("agg26_spearman", "SELECT p_brand AS g, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) END AS rho FROM (SELECT p_brand, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0)::DOUBLE AS b FROM part) GROUP BY ALL")
def spearman(spark, sf_dir):
    return st.spearman(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "g"), ["g"], "p_size", "p_retailprice")


@query("agg27_normalise", "SELECT l_returnflag, l_linestatus, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def normalise(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return st.normalise(counts, ["l_returnflag"], "n")


@query("agg28_pearson_gap", "SELECT l_returnflag AS g, count(*) AS n, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r, round(max(abs(l_discount - l_tax)), 6) AS gap FROM lineitem GROUP BY ALL")
def pearson_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g")
    return st.pearson(rows, ["g"], "l_quantity", "l_extendedprice").join(st.max_gap(rows, ["g"], "l_discount", "l_tax"), "g")


@query("agg19_n50", "SELECT lang AS g, max(n_chars) AS n50 FROM (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS c, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents) WHERE c >= t / 2.0 GROUP BY ALL")
def n50(spark, sf_dir):
    return st.n50(table(spark, sf_dir, "documents").select(F.col("lang").alias("g"), "n_chars"), ["g"], "n_chars")


@query("agg20_describe", "SELECT g, count(*) AS reads, sum(n_chars)::BIGINT AS bases, round(avg(n_chars), 6) AS mean_length, round(median(n_chars), 6) AS median_length, round(median(n_chars % 97), 6) AS median_q, max(n_chars) FILTER (c >= t / 2.0) AS n50 FROM (SELECT source AS g, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC) AS c, sum(n_chars) OVER (PARTITION BY source) AS t FROM documents) GROUP BY g")
def describe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("g"), "n_chars", (F.col("n_chars") % 97).alias("q"))
    return st.describe(rows, ["g"], "n_chars", "q")


# Scalar functions ----------------------------------------------------------------------------------------------------


@query("sca01_05_coordinates", oracle("SELECT rid, start0 - 1 + 1 AS b_start, end0 AS b_end, start0 + 1 AS c_start, end0 AS c_end, start0 - 1 AS v_start, start0 - 1 + length(contig) AS v_end, concat(contig, ':', start0 + 1, '-', end0) AS region, greatest(0, least(end0, start0 + 500) - greatest(start0, start0 + o_custkey % 150)) AS shared FROM truth WHERE start0 > 0", "truth"))
def coordinates(spark, sf_dir):
    """SCA-01..05."""
    t = fx.truth(spark, sf_dir).filter("start0 > 0")
    closed = sc.closed_to_bed(F.col("start0") + 1, F.col("end0"))
    one, vcf = sc.bed_to_closed(F.col("start0"), F.col("end0")), sc.vcf_to_bed(F.col("start0"), F.col("contig"))
    shared = sc.overlap(F.col("start0"), F.col("end0"), F.col("start0") + F.col("o_custkey") % 150, F.col("start0") + 500)
    return t.select(
        "rid", closed["start0"].alias("b_start"), closed["end0"].alias("b_end"), one["start1"].alias("c_start"), one["end1"].alias("c_end"), vcf["start0"].alias("v_start"), vcf["end0"].alias("v_end"),
        sc.region_string(F.col("contig"), F.col("start0"), F.col("end0")).alias("region"), shared.alias("shared"),
    )


@query("sca06_iou", oracle("SELECT t.qname, round(greatest(0, least(t.end0, a.end0) - greatest(t.start0, a.start0))::DOUBLE / (greatest(t.end0, a.end0) - least(t.start0, a.start0)), 6) AS iou FROM truth t JOIN aln1 a USING (qname, mate)", "truth", "aln1"))
def iou(spark, sf_dir):
    a = fx.aln(spark, sf_dir, 1).select("qname", "mate", F.col("start0").alias("s"), F.col("end0").alias("e"))
    return fx.truth(spark, sf_dir).join(a, ["qname", "mate"]).select("qname", sc.iou(F.col("start0"), F.col("end0"), F.col("s"), F.col("e")).alias("iou"))


SPELLED = "CASE WHEN {0} = 'chrM' THEN 'MT' WHEN {0} LIKE 'chr%' THEN substr({0}, 4) WHEN {0} = 'MT' THEN 'chrM' ELSE concat('chr', {0}) END"
NAMES = "CASE l_linenumber WHEN 1 THEN 'chr1' WHEN 2 THEN '2' WHEN 3 THEN 'MT' WHEN 4 THEN 'chrX9' WHEN 5 THEN 'chrM' ELSE 'NC_7' END"


def _contig_names(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(f"{NAMES} AS contig", "l_returnflag")


def _reference(spark):
    return spark.createDataFrame([("chr1",), ("chr2",), ("chrM",), ("chr7",)], "name string")


@query("sca07_spellings", f"SELECT DISTINCT contig, {SPELLED.format('contig')} AS other FROM (SELECT {NAMES} AS contig FROM lineitem)")
def spellings(spark, sf_dir):
    names = _contig_names(spark, sf_dir).select("contig").distinct()
    return names.select("contig", F.get(sc.name_spellings(F.col("contig")), F.lit(1)).alias("other"))


def _alias_rows(spark, sf_dir):
    """Alias groups from nations: a sequence's name, an accession, and now and then a second sequence."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.array(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")), F.concat(F.lit("NC_"), F.col("n_nationkey").cast("string")), F.when(F.col("n_nationkey") % 5 == 0, "chr7").otherwise("na")).alias("f"))
    return rows.select("group_id", F.explode("f").alias("name")).filter("name <> 'na'").distinct()


@query(
    "sca09_aliases",
    """WITH g AS (SELECT DISTINCT n_nationkey::BIGINT AS group_id, unnest(['chr' || n_nationkey, 'NC_' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'chr7' ELSE 'na' END]) AS name FROM nation),
    h AS (SELECT group_id, min(name) AS canonical FROM g WHERE name IN ('chr1', 'chr2', 'chrM', 'chr7') GROUP BY group_id HAVING count(DISTINCT name) = 1)
    SELECT name AS alias, min_by(canonical, group_id) AS canonical FROM g JOIN h USING (group_id) WHERE name <> 'na' GROUP BY name""",
)
def alias_table(spark, sf_dir):
    return nm.aliases(_alias_rows(spark, sf_dir), _reference(spark))


@query("sca08_joi11_resolve", f"SELECT contig, CASE contig WHEN 'chr1' THEN 'chr1' WHEN '2' THEN 'chr2' WHEN 'MT' THEN 'chrM' WHEN 'chrM' THEN 'chrM' WHEN 'NC_7' THEN 'chr7' END AS canonical, count(*) AS n FROM (SELECT {NAMES} AS contig FROM lineitem) GROUP BY ALL")
def resolve(spark, sf_dir):
    names = nm.name_table(_reference(spark), nm.aliases(_alias_rows(spark, sf_dir), _reference(spark)))
    return nm.resolve(_contig_names(spark, sf_dir), names).groupBy("contig", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query("srt02_unresolved", f"SELECT contig, count(*) AS n FROM (SELECT {NAMES} AS contig FROM lineitem) WHERE contig IN ('chrX9', 'NC_7') GROUP BY ALL ORDER BY n DESC, contig LIMIT 8")
def unresolved(spark, sf_dir):
    """SCA-08, SRT-02: the most frequent unknown names."""
    return nm.unresolved(_contig_names(spark, sf_dir), nm.name_table(_reference(spark)))


FAMILY = "CASE p_size % 9 WHEN 0 THEN 'LINE/L1' WHEN 1 THEN 'DNA?' WHEN 2 THEN 'Satellite/centr' WHEN 3 THEN 'tRNA' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'SINE?/Alu' WHEN 6 THEN 'srpRNA' WHEN 7 THEN 'LTR' ELSE 'Simple_repeat' END"


@query(
    "sca10_16_bins",
    f"""SELECT p_partkey, CASE WHEN f IN ('SINE', 'LINE', 'LTR', 'DNA', 'Satellite', 'Simple_repeat', 'Low_complexity', 'Retroposon') THEN f WHEN f IN ('rRNA', 'tRNA', 'snRNA', 'scRNA', 'srpRNA', 'RNA') THEN 'RNA' ELSE 'Other_repeat' END AS class,
    CASE WHEN d < 5 THEN 'young_<5%' WHEN d < 15 THEN 'middle_5-15%' ELSE 'old_>15%' END AS age, CASE WHEN i IS NULL THEN 'SD' WHEN i >= 0.99::DOUBLE THEN 'SD_>=99%' WHEN i >= 0.95::DOUBLE THEN 'SD_95-99%' ELSE 'SD_<95%' END AS dup,
    CASE WHEN g < 0.3::DOUBLE THEN '<30%' WHEN g < 0.4::DOUBLE THEN '30-40%' WHEN g < 0.5::DOUBLE THEN '40-50%' WHEN g < 0.6::DOUBLE THEN '50-60%' WHEN g < 0.7::DOUBLE THEN '60-70%' ELSE '>=70%' END AS gc,
    CASE WHEN v <= 0 THEN '0' WHEN v < 2 THEN '0-2/kb' WHEN v < 5 THEN '2-5/kb' WHEN v < 10 THEN '5-10/kb' ELSE '>=10/kb' END AS density,
    CASE WHEN l < 500 THEN '<500' WHEN l < 1000 THEN '0.5-1k' WHEN l < 2000 THEN '1-2k' WHEN l < 5000 THEN '2-5k' WHEN l < 10000 THEN '5-10k' WHEN l < 20000 THEN '10-20k' WHEN l < 50000 THEN '20-50k' ELSE '>=50k' END AS len,
    CASE WHEN c <= 0 THEN 'none' WHEN c < 0.5 THEN 'partial_<50%' WHEN c < 0.95::DOUBLE THEN 'mostly_50-95%' ELSE 'entire_>=95%' END AS cover
    FROM (SELECT p_partkey, rtrim(split_part({FAMILY}, '/', 1), '?') AS f, (p_partkey % 40)::DOUBLE / 2 AS d, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (900 + p_partkey % 100)::DOUBLE / 1000 END AS i,
      (p_partkey % 100)::DOUBLE / 100 AS g, (p_partkey % 12)::DOUBLE / (p_size * 100) * 1000 AS v, (p_partkey * 37) % 60000 AS l, (p_partkey % 21)::DOUBLE / 20 AS c FROM part)""",
)
def bins(spark, sf_dir):
    """SCA-10..16."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        sc.repeat_class(F.expr(FAMILY)).alias("class"),
        sc.repeat_age((k % 40).cast("double") / 2).alias("age"),
        sc.segdup_label(F.when(k % 7 != 0, (900 + k % 100).cast("double") / 1000)).alias("dup"),
        sc.gc_bin((k % 100).cast("double") / 100).alias("gc"),
        sc.variant_density_bin(k % 12, F.col("p_size") * 100).alias("density"),
        sc.length_bin((k * 37) % 60000).alias("len"),
        sc.cover_bin((k % 21).cast("double") / 20).alias("cover"),
    )


@query("sca17_phred", "SELECT event_id, 0.0::DOUBLE + round(-10 * log10(greatest(least(p, 1), 1e-10)), 6) AS q, round(power(10, -(event_id % 61) / 10::DOUBLE), 6) AS p FROM (SELECT event_id, (event_id % 1000)::DOUBLE / 999 AS p FROM events)")
def phred(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.phred((F.col("event_id") % 1000).cast("double") / 999).alias("q"), sc.unphred(F.col("event_id") % 61).alias("p"))


@query("sca18_wilson", f"SELECT p_partkey, {WILSON.format(k='k', n='n', out='w')} FROM (SELECT p_partkey, p_partkey % 50 AS n, (p_partkey * 7) % (p_partkey % 50 + 1) AS k FROM part)")
def wilson(spark, sf_dir):
    n = F.col("p_partkey") % 50
    low, high = sc.wilson((F.col("p_partkey") * 7) % (n + 1), n)
    return table(spark, sf_dir, "part").select("p_partkey", low.alias("w_lo"), high.alias("w_hi"))


IDEAL = "-10 * log10(greatest(least(m * power((e / 3) / (1 - e), d) / (1 + m * power((e / 3) / (1 - e), d)), 1), 1e-10))"


@query("sca19_20_ideal_mapq", f"SELECT p_partkey, round({IDEAL}, 6) AS q FROM (SELECT p_partkey, (p_partkey % 5)::DOUBLE AS d, (1 + p_partkey % 9)::DOUBLE / 100 AS e, (1 + p_partkey % 4)::DOUBLE AS m FROM part)")
def ideal_mapq(spark, sf_dir):
    """SCA-19, SCA-20: exact MAPQ over a grid of mismatches, error rates and copies."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", sc.ideal_mapq((k % 5).cast("double"), (1 + k % 9).cast("double") / 100, (1 + k % 4).cast("double")).alias("q"))


@query("sca21_22_sequence", oracle("SELECT rid, reverse(translate(upper(seq), 'ACGTN', 'TGCAN')) AS rc, round((length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / nullif(length(seq), 0), 6) AS gc FROM bases", "bases"))
def sequence(spark, sf_dir):
    return fx.bases(spark, sf_dir).select("rid", sq.reverse_complement(F.col("seq")).alias("rc"), sq.gc_fraction(F.col("seq")).alias("gc"))


@query(
    "sca23_homopolymers",
    oracle("SELECT rid, pos, base, count(*) OVER (PARTITION BY rid, island) AS run_length FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT rid, pos, substr(seq, pos + 1, 1) AS base, CASE WHEN pos > 0 AND substr(seq, pos, 1) = substr(seq, pos + 1, 1) THEN 0 ELSE 1 END AS fresh FROM (SELECT rid, seq, unnest(range(length(seq))) AS pos FROM bases)))", "bases"),
)
def homopolymers(spark, sf_dir):
    return sq.homopolymer_runs(fx.bases(spark, sf_dir), "rid", "seq")


@query("sca24_25_quality", "SELECT page_id, round(-10 * log10(list_avg([power(10, -(ascii(c) - 33)::DOUBLE / 10) for c in string_split(url, '')])), 6) AS q, page_id % 7 = 0 AS unknown FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '!!!!' ELSE url END AS url FROM pages WHERE length(url) > 0)")
def quality(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter(F.length("url") > 0).withColumn("url", F.when(F.col("page_id") % 7 == 0, "!!!!").otherwise(F.col("url")))
    return pages.select("page_id", sq.mean_quality(F.col("url")).alias("q"), sq.quality_unknown(F.col("url")).alias("unknown"))


@query("sca26_cigar", oracle("SELECT rid, i - 1 AS op_index, op, len AS length, CASE i WHEN 1 THEN 0 WHEN 2 THEN s WHEN 3 THEN s + m ELSE s + m + x END AS read_offset, CASE WHEN i <= 2 THEN 0 ELSE m END AS ref_offset FROM (SELECT rid, o_custkey % 9 + 1 AS s, rid % 50 + 1 AS m, rid % 3 + 1 AS x, unnest([1, 2, 3, 4]) AS i, unnest(['S', 'M', 'I', 'M']) AS op, unnest([o_custkey % 9 + 1, rid % 50 + 1, rid % 3 + 1, o_custkey % 30 + 1]) AS len FROM truth)", "truth"))
def cigar(spark, sf_dir):
    return sq.cigar_ops(fx.cigars(spark, sf_dir), "rid")


@query("sca27_usable", oracle("SELECT aligner, qname, mate FROM placements WHERE mapped AND mapq >= 20 AND clipped <> 3 AND NOT split", "placements"))
def usable(spark, sf_dir):
    """SCA-27: primary mapped alignments with bases and a MAPQ of 20 or more."""
    flag = F.when(~F.col("mapped"), 4).when(F.col("split"), 0x800).otherwise(0)
    rows = _placements(spark, sf_dir).withColumns({"flag": flag, "seq": F.when(F.col("clipped") == 3, "*").otherwise("ACGT")})
    return pf.usable(rows).select("aligner", "qname", "mate")


@query("sca28_30_text", f"SELECT p_partkey, CASE WHEN w_lo > 0.3::DOUBLE THEN 'above' WHEN w_hi <= 0.3::DOUBLE THEN 'within' ELSE 'open' END AS verdict, CASE WHEN n > 0 THEN format('{{:.2f}} [{{:.2f}}, {{:.2f}}]', k::DOUBLE / n * 1000, w_lo * 1000, w_hi * 1000) ELSE 'n/a' END AS per_thousand, CASE WHEN n > 0 THEN round(round(k::DOUBLE / n * 1000, 2), 6) END AS parsed, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_matches(p_brand, '^-?\\d+(\\.\\d+)?%?$') AS number FROM (SELECT p_partkey, p_name, p_brand, k, n, {WILSON.format(k='k', n='n', out='w').replace(', 6)', ', 15)')} FROM (SELECT *, p_partkey % 40 AS n, (p_partkey * 7) % (p_partkey % 40 + 1) AS k FROM part))")
def text_scalars(spark, sf_dir):
    """SCA-28, SCA-29, SCA-30."""
    n = F.col("p_partkey") % 40
    k = (F.col("p_partkey") * 7) % (n + 1)
    low, high = sc.wilson(k, n)
    shown = sc.per_thousand(k, n)
    return table(spark, sf_dir, "part").select("p_partkey", sc.verdict(low, high, F.lit(0.3)).alias("verdict"), shown.alias("per_thousand"), sc.parse_rate(shown)["value"].alias("parsed"), sc.slug(F.col("p_name")).alias("slug"), sc.is_number(F.col("p_brand")).alias("number"))


CRC = """SELECT contig, pos, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 2 = 1 AS swapped
FROM (SELECT DISTINCT contig, pos, concat(contig, ':', pos) AS s FROM points) p, (
  WITH RECURSIVE steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8)
  SELECT list(c ORDER BY i) AS l FROM steps WHERE k = 8) bytes"""


@query("sca35_hash_swap", oracle(CRC, "points"))
def hash_swap(spark, sf_dir):
    """SCA-35: the parity of a place's crc32."""
    return fx.points(spark, sf_dir).select("contig", "pos", sc.hash_swap(F.col("contig"), F.col("pos")).alias("swapped")).distinct()


@query("sca37_key_values", "SELECT event_id, event_type AS a, (user_id % 7)::VARCHAR AS b FROM events")
def key_values(spark, sf_dir):
    text = F.concat(F.lit("a="), "event_type", F.lit(",b="), (F.col("user_id") % 7).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", sc.key_values(text).alias("m")).select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("sca38_ena_checks", "SELECT o_orderkey, (o_orderstatus <> 'O')::INT::BIGINT + (o_orderpriority <> 'PAIRED')::INT + (o_custkey % 3 < 2)::INT AS problems FROM orders")
def ena_checks(spark, sf_dir):
    found = sc.ena_problems(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 3, "O", True)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(found).cast("long").alias("problems"))


# Set operations, sorts, pivots ---------------------------------------------------------------------------------------


@query("set01_03", oracle("SELECT * FROM (SELECT qname, 'both' AS kind FROM aln0 WHERE mapped INTERSECT SELECT qname, 'both' FROM aln1 WHERE mapped) UNION ALL SELECT * FROM (SELECT DISTINCT qname, 'lost' AS kind FROM truth EXCEPT SELECT qname, 'lost' FROM aln0)", "aln0", "aln1", "truth"))
def set_operations(spark, sf_dir):
    """SET-01..03: union, distinct, intersect and except of read names."""
    placed = [fx.aln(spark, sf_dir, k).select("qname", "mapped") for k in (0, 1)]
    both = placed[0].filter("mapped").select("qname").intersect(placed[1].filter("mapped").select("qname"))
    lost = fx.truth(spark, sf_dir).select("qname").distinct().join(placed[0].select("qname"), "qname", "left_anti")
    return tb.gather([both.withColumn("kind", F.lit("both")), lost.withColumn("kind", F.lit("lost"))])


@query("srt01_first_reads", oracle("SELECT rid, seq FROM bases ORDER BY rid LIMIT 100 OFFSET 50", "bases"))
def first_reads(spark, sf_dir):
    """SRT-01, SRT-02, SRC-20, SRC-22: the first reads in file order after some are skipped."""
    return rd.first_reads(fx.bases(spark, sf_dir).select("rid", "seq"), 100, 50, "rid")


@query("piv01_pivot", oracle("SELECT mapq, " + ", ".join(f"max(CASE WHEN aligner = 't{k}' THEN n_mapped END) AS t{k}" for k in range(4)) + " FROM per_mapq GROUP BY mapq", "per_mapq"))
def pivot(spark, sf_dir):
    counts = scoring.mapq_counts(_outcomes(spark, sf_dir), ["aligner"])
    return scoring.side_by_side(counts, ["mapq"], TOOLS, "n_mapped")


# Quality control -----------------------------------------------------------------------------------------------------

QUAL = "list_avg([power(10, -(ascii(c) - 33)::DOUBLE / 10) for c in string_split(url, '')])"


def _fastq(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_order"), F.col("url").alias("seq"), F.col("url").alias("qual")).filter(F.length("qual") > 0)


@query("agg21_filter_long", f"SELECT reason, count(*) AS reads, sum(length)::BIGINT AS bases FROM (SELECT length, CASE WHEN length < 36 THEN 'too_short' WHEN q < 18.5::DOUBLE THEN 'low_quality' END AS reason FROM (SELECT length(url) AS length, -10 * log10({QUAL}) AS q FROM pages WHERE length(url) > 0)) GROUP BY reason")
def filter_long(spark, sf_dir):
    judged = qc.judge_reads(_fastq(spark, sf_dir), 36, 18.5)
    return judged.groupBy("reason").agg(F.count(F.lit(1)).alias("reads"), F.sum("length").alias("bases"))


@query(
    "agg21_filter_accounting",
    f"""WITH r AS (SELECT length(url) AS length, -10 * log10({QUAL}) AS q FROM pages WHERE length(url) > 0), j AS (SELECT *, CASE WHEN length < 36 THEN 'too_short' WHEN q < 18.5::DOUBLE THEN 'low_quality' END AS reason FROM r),
    d AS (SELECT 'raw' AS step, * FROM j UNION ALL SELECT 'after_filters', * FROM j WHERE reason IS NULL), n AS (SELECT step, length, sum(length) OVER (PARTITION BY step ORDER BY length DESC) AS c, sum(length) OVER (PARTITION BY step) AS t FROM d)
    SELECT step, unnest(['reads', 'bases', 'mean_length', 'median_length', 'median_q']) AS metric, round(unnest([count(*)::DOUBLE, sum(length)::DOUBLE, avg(length), median(length), median(q)]), 6) AS value FROM d GROUP BY step
    UNION ALL SELECT step, 'n50', max(length)::DOUBLE FROM n WHERE c >= t / 2.0 GROUP BY step
    UNION ALL SELECT 'filter:' || k, 'reads_removed_fraction', round((SELECT count(*) FILTER (reason = k)::DOUBLE / count(*) FROM j), 6) FROM (SELECT unnest(['too_short', 'low_quality']) AS k)
    UNION ALL SELECT 'filter:' || k, 'bases_removed_fraction', round((SELECT coalesce(sum(length) FILTER (reason = k), 0)::DOUBLE / sum(length) FROM j), 6) FROM (SELECT unnest(['too_short', 'low_quality']) AS k)""",
)
def filter_accounting(spark, sf_dir):
    return qc.filter_accounting(qc.judge_reads(_fastq(spark, sf_dir), 36, 18.5))


@query("agg23_split", "SELECT page_id AS file_order, CASE WHEN (row_number() OVER (ORDER BY page_id) - 1) % 2 = 0 THEN 'calibration' ELSE 'held_out' END AS half FROM pages WHERE length(url) > 0")
def split_halves(spark, sf_dir):
    return qc.split_alternating(_fastq(spark, sf_dir), "file_order", block_rows=100).select("file_order", "half")


REPORT_JSON = """concat('{"summary": {"before_filtering": {"total_reads": ', {0}, ', "total_bases": ', {0} * 150, '}, "after_filtering": {"total_reads": ', {0} - 3, '}}, "filtering_result": {"low_quality_reads": ', {0} % 7, '}, "insert_size": {"peak": ', {0} % 400, '}}')"""


@query(
    "src17_agg22_trimming_report",
    """SELECT o_orderkey, unnest(['raw', 'raw', 'after_filters', 'raw', 'filter:adapter', 'filter:low_quality', 'filter:too_many_N', 'filter:too_short']) AS step,
    unnest(['total_reads', 'total_bases', 'total_reads', 'insert_size_peak', 'reads_affected_fraction', 'reads_affected_fraction', 'reads_affected_fraction', 'reads_affected_fraction']) AS metric,
    round(unnest([n::DOUBLE, n * 150::DOUBLE, n - 3::DOUBLE, n % 400::DOUBLE, 0, (n % 7)::DOUBLE / n, 0, 0]), 6) AS value FROM (SELECT o_orderkey, o_orderkey % 1000 + 10 AS n FROM orders)""",
)
def trimming_report(spark, sf_dir):
    """SRC-17, AGG-22: decision rows of JSON reports."""
    n = F.expr(REPORT_JSON.replace("{0}", "(o_orderkey % 1000 + 10)"))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(n, qc.REPORT_SCHEMA).alias("r")).select("o_orderkey", "r.*")
    return qc.trimming_report(parsed, keys=["o_orderkey"]).drop("threshold")


@query("agg33_inside_tolerance", "SELECT l_shipmode AS dataset, count(*) FILTER (l_discount <= 0.05) AS k, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode, l_discount FROM lineitem) GROUP BY ALL")
def inside_tolerance(spark, sf_dir):
    """AGG-33: checks inside the tolerance, k of n."""
    return qc.inside_tolerance(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_discount") <= 0.05).alias("ok")), ["dataset"])


# Sources over derived lines ------------------------------------------------------------------------------------------


def _lines(df: DataFrame, *parts, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[p if not isinstance(p, str) else F.lit(p) for p in parts]).alias("value"))


RMSK = f"SELECT 'repeat_class' AS set_name, concat('chr', p_partkey % 5) AS contig, (p_partkey * 613) % 100000 AS start0, (p_partkey * 613) % 100000 + p_size * 40 AS end0, c AS label FROM x UNION ALL SELECT 'repeat_age', concat('chr', p_partkey % 5), (p_partkey * 613) % 100000, (p_partkey * 613) % 100000 + p_size * 40, CASE WHEN d < 5 THEN 'young_<5%' WHEN d < 15 THEN 'middle_5-15%' ELSE 'old_>15%' END FROM x WHERE c IN ('SINE', 'LINE', 'LTR', 'DNA', 'Retroposon')"
RMSK = f"WITH x AS (SELECT *, CASE WHEN f IN ('SINE', 'LINE', 'LTR', 'DNA', 'Satellite', 'Simple_repeat') THEN f WHEN f IN ('tRNA', 'srpRNA') THEN 'RNA' ELSE 'Other_repeat' END AS c FROM (SELECT *, rtrim(split_part({FAMILY}, '/', 1), '?') AS f, (p_partkey % 200)::DOUBLE / 10 AS d FROM part)) " + RMSK


def _part(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("*", F.concat(F.lit("chr"), (k % 5).cast("string")).alias("contig"), ((k * 613) % 100000).alias("s"), ((k * 613) % 100000 + F.col("p_size") * 40).alias("e"), F.expr(FAMILY).alias("family"))


@query("src04_repeatmasker", RMSK)
def repeatmasker(spark, sf_dir):
    p = _part(spark, sf_dir)
    tenth = F.format_string("%d.%d", F.expr("(p_partkey % 200) div 10"), F.col("p_partkey") % 10)
    body = _lines(p, "  100", tenth, "0", "0", F.col("contig"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), "(0)", "+", "name", F.col("family"), sep="  ")
    header = spark.createDataFrame([("   SW  perc perc",), ("",)], "value string")
    return an.parse(header.unionByName(body), "rmsk_out")


@query("src05_ucsc_rmsk", RMSK)
def ucsc_rmsk(spark, sf_dir):
    p = _part(spark, sf_dir)
    return an.parse(_lines(p, "0", "1", (F.col("p_partkey") % 200).cast("string"), "0", "0", F.col("contig"), F.col("s").cast("string"), F.col("e").cast("string"), "0", "+", "n", F.col("family"), "x"), "ucsc_rmsk")


@query("src06_superdups", "SELECT 'segdup' AS set_name, concat('chr', p_partkey % 5) AS contig, (p_partkey * 613) % 100000 AS start0, (p_partkey * 613) % 100000 + p_size * 40 AS end0, CASE WHEN p_partkey % 7 = 0 THEN 'SD' WHEN (900 + p_partkey % 100) >= 990 THEN 'SD_>=99%' WHEN (900 + p_partkey % 100) >= 950 THEN 'SD_95-99%' ELSE 'SD_<95%' END AS label FROM part")
def superdups(spark, sf_dir):
    p = _part(spark, sf_dir)
    identity = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("0."), (900 + F.col("p_partkey") % 100).cast("string")))
    return an.parse(_lines(p, "0", F.col("contig"), F.col("s").cast("string"), F.col("e").cast("string"), *["x"] * 22, identity), "ucsc_superdups")


@query("src07_bed", "SELECT 'mine' AS set_name, concat('chr', p_partkey % 5) AS contig, (p_partkey * 613) % 100000 AS start0, (p_partkey * 613) % 100000 + p_size * 40 AS end0, CASE WHEN p_partkey % 7 = 0 THEN 'mine' WHEN 90 + p_partkey % 10 >= 99 THEN 'SD_>=99%' WHEN 90 + p_partkey % 10 >= 95 THEN 'SD_95-99%' ELSE 'SD_<95%' END AS label FROM part")
def bed(spark, sf_dir):
    p = _part(spark, sf_dir)
    percent = F.when(F.col("p_partkey") % 7 == 0, "?").otherwise((90 + F.col("p_partkey") % 10).cast("string"))
    body = _lines(p, F.col("contig"), F.col("s").cast("string"), F.col("e").cast("string"), percent)
    skipped = spark.createDataFrame([("track name=x",), ("# note",), ("",), ("chr1\tx\t5",), ("chr1\t5",)], "value string")
    return an.parse(skipped.unionByName(body), "bed", set_name="mine", identity_col=3)


@query("src08_gff", "SELECT 'feature' AS set_name, concat('chr', p_partkey % 5) AS contig, (p_partkey * 613) % 100000 AS start0, (p_partkey * 613) % 100000 + p_size * 40 AS end0, 'LTR' AS label FROM part WHERE p_size % 9 = 7")
def gff(spark, sf_dir):
    p = _part(spark, sf_dir)
    return an.parse(_lines(p, F.col("contig"), "x", F.col("family"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), ".", "+", ".", "ID=1"), "gff", types=["LTR"])


@query("src13_alias_groups", "SELECT count(*) AS n, count(DISTINCT name) AS names FROM (SELECT DISTINCT n_nationkey, unnest([n_name, 'GB_' || n_nationkey, 'NC_' || n_nationkey, 'chr' || n_nationkey]) AS name FROM nation)")
def alias_groups(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    text = _lines(n, F.col("n_name"), "a", "b", "c", F.concat(F.lit("GB_"), key), "=", F.concat(F.lit("NC_"), key), "d", "e", F.concat(F.lit("chr"), key))
    return an.alias_groups(text, ncbi=True).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


@query("src15_gather", "SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def gather(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    return tb.gather([nation, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))])


@query("src16_benchmark_paths", "SELECT p_partkey, 'map' AS step, p_brand AS tool, p_partkey::VARCHAR AS target FROM part")
def benchmark_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/x/benchmarks/map/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tsv")).alias("path"))
    return tb.benchmark_parts(paths).drop("path")


@query("snk06_provenance", "SELECT n_name AS label, '' AS url, concat('a; ', n_nationkey) AS path, n_regionkey::VARCHAR AS bytes, '' AS md5, '' AS retrieved, '' AS note FROM nation")
def provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return tb.provenance(n.select(F.col("n_name").alias("label"), F.array(F.lit("a"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_regionkey").alias("bytes")))


SAM_FLAGS = "CASE rid % 6 WHEN 0 THEN 256 WHEN 1 THEN 4 WHEN 2 THEN 16 WHEN 3 THEN 2048 ELSE 0 END"


def _sam(spark, sf_dir):
    t = fx.truth(spark, sf_dir).withColumn("flag", F.expr(SAM_FLAGS))
    t = t.join(fx.cigars(spark, sf_dir), "rid")
    fields = F.concat_ws("\t", (F.col("rid") % 997).cast("string"), F.col("flag").cast("string"), "contig", (F.col("start0") + 1).cast("string"), (F.col("rid") % 61).cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), (F.col("rid") % 5).cast("string")))
    return rd.sam(t.select("rid", fields.alias("value")), "rid")


@query(
    "src02_alignment_table",
    oracle(
        f"""SELECT qname, 0 AS mate, flag <> 4 AS mapped, CASE WHEN flag <> 4 THEN contig ELSE '' END AS contig, CASE WHEN flag <> 4 THEN start0 ELSE -1 END AS start0, CASE WHEN flag <> 4 THEN start0 + m + m2 ELSE -1 END AS end0,
    CASE WHEN flag = 4 THEN '' WHEN flag = 16 THEN '-' ELSE '+' END AS strand, CASE WHEN flag <> 4 THEN mapq ELSE 0 END AS mapq, CASE WHEN flag <> 4 THEN nm ELSE -1 END AS nm, s + m + x + m2 AS read_len, CASE WHEN flag <> 4 THEN s ELSE 0 END AS clipped, false AS proper, false AS split
    FROM (SELECT (rid % 997)::VARCHAR AS qname, contig, start0, rid % 61 AS mapq, rid % 5 AS nm, o_custkey % 9 + 1 AS s, rid % 50 + 1 AS m, rid % 3 + 1 AS x, o_custkey % 30 + 1 AS m2, {SAM_FLAGS} AS flag, rid FROM truth)
    WHERE flag NOT IN (256, 2048) QUALIFY row_number() OVER (PARTITION BY qname ORDER BY rid) = 1""",
        "truth",
    ),
)
def alignment_table(spark, sf_dir):
    """SRC-02: SAM lines to one row a read: secondary and supplementary lines dropped, the first primary kept."""
    return rd.alignment_table(_sam(spark, sf_dir))


@query("src02_duplicate_primaries", oracle(f"SELECT (count(*) - count(DISTINCT rid % 997))::BIGINT AS duplicate_primaries FROM truth WHERE {SAM_FLAGS} NOT IN (256, 2048)", "truth"))
def duplicate_primaries(spark, sf_dir):
    return rd.duplicate_primaries(_sam(spark, sf_dir))


@query("src03_provider_placements", oracle(f"SELECT (rid % 997)::VARCHAR AS qname, 0 AS mate, contig, start0, start0 + rid % 50 + 1 + o_custkey % 30 + 1 AS end0, rid % 61 AS mapq FROM truth WHERE {SAM_FLAGS} IN (0, 16)", "truth"))
def provider_placements(spark, sf_dir):
    return rd.provider_placements(_sam(spark, sf_dir))


@query("src11_12_reference", "SELECT 'chr' || lang AS contig, sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g')))::BIGINT AS length FROM documents WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 GROUP BY lang")
def reference(spark, sf_dir):
    """SRC-11, SRC-12: FASTA lines to chunks, and their contigs' lengths."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[A-Za-z]")).select("lang", "doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("bases"))
    heads = docs.select("lang").distinct().select(F.concat(F.lit("a"), "lang", F.lit("0")).alias("at"), F.concat(F.lit(">chr"), "lang", F.lit(" x")).alias("value"))
    body = docs.select(F.concat(F.lit("a"), "lang", F.lit("1"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("at"), F.col("bases").alias("value"))
    return rd.contig_lengths(rd.fasta_chunks(heads.unionByName(body), "at"))


# Variants ------------------------------------------------------------------------------------------------------------

GT = "CASE event_id % 5 WHEN 0 THEN '1|0' WHEN 1 THEN '1/1' WHEN 2 THEN '0|1:9' WHEN 3 THEN '1' ELSE './.' END"


def _records(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id AS file_order", "CAST(user_id % 6 AS STRING) AS contig", "(event_id * 1237) % 100000 + 1 AS pos1", "CASE WHEN event_id % 3 = 0 THEN 'ACG' ELSE 'A' END AS ref", "CASE WHEN event_id % 11 = 0 THEN '<DEL>' ELSE 'T,GG' END AS alts", f"{GT} AS genotype")
    names = nm.name_table(spark.createDataFrame([(f"chr{i}",) for i in range(5)], "name string"))
    return va.genotype_rows(e, names)


@query("src10_var01_genotypes", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN user_id % 6 = 5 THEN 'off_reference' WHEN event_id % 5 = 4 OR event_id % 11 = 0 THEN 'skipped_other' ELSE 'used' END AS status FROM events) GROUP BY ALL")
def genotypes(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


HAPS = "SELECT concat('chr', user_id % 6) AS contig, hap, (event_id * 1237) % 100000 AS start0, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 1 END AS ref_len, 'T' AS alt FROM events, (SELECT unnest([0, 1]) AS hap) WHERE user_id % 6 <> 5 AND event_id % 11 <> 0 AND (event_id % 5 IN (1, 3) OR (event_id % 5 = 0 AND hap = 0) OR (event_id % 5 = 2 AND hap = 1))"


@query("var01_haplotypes", HAPS)
def haplotypes(spark, sf_dir):
    return va.haplotype_variants(_records(spark, sf_dir))


KEPT = f"""v AS (SELECT *, row_number() OVER (PARTITION BY contig, hap ORDER BY start0, ref_len, alt) AS i FROM ({HAPS})),
    r AS (SELECT contig, hap, start0, ref_len, alt, true AS kept, start0 + ref_len AS reach, i FROM v WHERE i = 1
      UNION ALL SELECT v.contig, v.hap, v.start0, v.ref_len, v.alt, v.start0 >= r.reach, CASE WHEN v.start0 >= r.reach THEN v.start0 + v.ref_len ELSE r.reach END, v.i FROM r JOIN v ON v.contig = r.contig AND v.hap = r.hap AND v.i = r.i + 1)"""


@query("var02_keep_apart", f"WITH RECURSIVE {KEPT} SELECT contig, hap, start0, ref_len, alt, kept FROM r")
def keep_apart(spark, sf_dir):
    """VAR-02: greedy selection of variants that do not overlap."""
    return va.keep_apart(va.haplotype_variants(_records(spark, sf_dir)))


@query(
    "var03_apply",
    f"""WITH RECURSIVE {oracle("", "truth").removeprefix("WITH ").strip()}, {KEPT},
    w AS (SELECT rid AS window_id, contig, (rid % 2)::INT AS hap, start0, rpad(translate(rid::VARCHAR, '0123456789', 'ACGTACGTAC') || repeat('ACGT', 30), 120, 'A') AS seq FROM truth),
    h AS (SELECT window_id, r.start0 - w.start0 AS off, ref_len, alt FROM w JOIN r ON r.kept AND r.contig = w.contig AND r.hap = w.hap AND r.start0 >= w.start0 AND r.start0 + r.ref_len <= w.start0 + 120),
    f AS (SELECT *, coalesce(lag(off + ref_len) OVER (PARTITION BY window_id ORDER BY off), 0) AS front FROM h),
    g AS (SELECT window_id, count(*) AS n_variants, max(off + ref_len) AS last_end, string_agg(substr(seq, front + 1, off - front) || alt, '' ORDER BY off) AS bases,
      flatten(list(list_concat(range(start0 + front, start0 + off), list_transform(range(len(alt)), lambda i: start0 + off + least(i, ref_len - 1))) ORDER BY off)) AS places FROM f JOIN w USING (window_id) GROUP BY window_id)
    SELECT window_id, coalesce(n_variants, 0) AS n_variants, coalesce(bases, '') || substr(seq, coalesce(last_end, 0) + 1) AS sample_seq,
      array_to_string(list_concat(coalesce(places, []::BIGINT[]), range(start0 + coalesce(last_end, 0), start0 + 120)), ',') AS positions FROM w LEFT JOIN g USING (window_id)""",
)
def apply_variants(spark, sf_dir):
    """VAR-03: sample sequences of reference windows, and the reference position of every base."""
    windows = fx.truth(spark, sf_dir).select(F.col("rid").alias("window_id"), "contig", (F.col("rid") % 2).cast("int").alias("hap"), "start0", F.rpad(F.translate(F.col("rid").cast("string"), "0123456789", "ACGTACGTAC"), 120, "ACGT").alias("seq"))
    out = va.apply_to_windows(windows, va.keep_apart(va.haplotype_variants(_records(spark, sf_dir))))
    listed = out.withColumn("listed", F.to_json("positions").cast("binary"))  # [1,2,3], without a text for every number
    return listed.select("window_id", "n_variants", "sample_seq", F.substring("listed", 2, F.octet_length("listed") - 2).cast("string").alias("positions"))


# Profiles and simulation ---------------------------------------------------------------------------------------------


def _aligned(spark, sf_dir, wrong: int = 40, keep: bool = False):
    """Alignments derived from orders: 100 bases, every `wrong`-th read with one base changed, and an indel now and then."""
    ref = F.rpad(F.translate((F.col("rid") * 7919 + F.col("o_custkey") * 104729).cast("string"), "0123456789", "ACGTACGTAC"), 100, "ACGGTCA")
    at = (F.col("rid") % 90 + 1).cast("int")
    changed = F.concat(F.substring(ref, F.lit(1), at), F.translate(F.substring(ref, at + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(ref, at + 2, F.lit(100)))
    seq = F.when(F.col("rid") % wrong == 0, changed).when(F.col("rid") % 50 == 1, F.concat(F.substring(ref, 1, 50), F.lit("T"), F.substring(ref, 51, 50))).otherwise(ref)
    cigar = F.when((F.col("rid") % wrong != 0) & (F.col("rid") % 50 == 1), "50M1I50M").otherwise("100M")
    rows = fx.truth(spark, sf_dir).select("rid", F.lit(0).alias("mate"), (F.col("strand") == "-").alias("reverse"), "contig", "start0", cigar.alias("cigar"), seq.alias("seq"), ref.alias("ref"))
    rows = rows.withColumn("qual", F.rpad(F.translate(F.col("rid").cast("string"), "0123456789", "56789:;<=>"), 101, "I")).withColumn("qual", F.substring("qual", F.lit(1), F.length("seq")))
    return rows if keep else rows.drop("rid")


@query("pro01_mismatches", "SELECT (count(*) * 100)::BIGINT AS aligned, round(count(*) FILTER (o_orderkey % 40 = 0)::DOUBLE / (count(*) * 100), 6) AS mismatch_rate, round(count(*) FILTER (o_orderkey % 40 <> 0 AND o_orderkey % 50 = 1)::DOUBLE / (count(*) * 100), 6) AS ins_rate, 0 AS del_rate FROM orders")
def learn_short(spark, sf_dir):
    """PRO-01: rates learned from cells of short alignments."""
    out = pf.rates(pf.count_cells(_aligned(spark, sf_dir), "short"), "short")
    return out.select(F.col("aligned").cast("long").alias("aligned"), "mismatch_rate", "ins_rate", "del_rate")


def short_reads(wrong: int) -> str:
    """The reads of `_aligned` for SQL: kind 1 has one base changed, kind 2 one base inserted at place 50."""
    return f"""SELECT o_orderkey, o_custkey, o_orderkey % 2 <> 0 AS rev, CASE WHEN o_orderkey % {wrong} = 0 THEN 1 WHEN o_orderkey % 50 = 1 THEN 2 ELSE 0 END AS kind,
      CASE WHEN o_orderkey % {wrong} <> 0 AND o_orderkey % 50 = 1 THEN 101 ELSE 100 END AS size, rpad(translate(o_orderkey::VARCHAR, '0123456789', '56789:;<=>'), 101, 'I') AS qual,
      rpad(translate((o_orderkey * 7919 + o_custkey * 104729)::VARCHAR, '0123456789', 'ACGTACGTAC') || repeat('ACGGTCA', 15), 100, 'A') AS ref FROM orders"""


def all_bases(wrong: int) -> str:
    return f"""SELECT o_orderkey, rev, kind, size, p, ref, CASE WHEN rev THEN size - 1 - p ELSE p END AS cycle, ascii(substr(qual, p::INT + 1, 1)) - 33 AS q, kind = 1 AND p = o_orderkey % 90 + 1 AS bad
      FROM (SELECT *, unnest(range(size)) AS p FROM ({short_reads(wrong)}))"""


SHORT_BASES = f"SELECT *, 0 AS qualities, 0 AS wrong FROM ({all_bases(40)}) WHERE kind <> 2 OR p <> 50"


@query("pro01_cycles", f"SELECT 0 AS mate, cycle, count(*) AS bases, round(count(*) FILTER (bad)::DOUBLE / count(*), 6) AS rate FROM ({SHORT_BASES}) GROUP BY cycle")
def cycle_errors(spark, sf_dir):
    """PRO-01: error rate of every cycle."""
    return pf.cycle_errors(pf.count_cells(_aligned(spark, sf_dir), "short"))


@query("pro01_quality_errors", f"SELECT 0 AS mate, quarter, q AS quality, round((wrong + 500 * sum(wrong) OVER (PARTITION BY q)::DOUBLE / greatest(sum(bases) OVER (PARTITION BY q), 1)) / (bases + 500), 6) AS rate FROM (SELECT cycle * 4 // size AS quarter, q, count(*) AS bases, count(*) FILTER (bad) AS wrong FROM ({SHORT_BASES}) GROUP BY ALL)")
def quality_errors(spark, sf_dir):
    """PRO-01: smoothed error rates by quarter of the read and quality."""
    return pf.quality_errors(pf.count_cells(_aligned(spark, sf_dir), "short"))


def _long_reads(spark, sf_dir):
    """Longer alignments: a read's bases, a run of 1 to 9 T, and its reference twice. The longer the run, the more often one or two of its bases are
    inserted or deleted."""
    x = (F.col("rid") * 7919 + 13) % (1 << 30)
    run = (x % 9 + 1).cast("int")
    size = F.least(run, (F.floor(x / 9) % 2 + 1).cast("int"))
    event = F.when(F.floor(x / 18) % 20 >= run, "M").when(F.floor(x / 360) % 2 == 0, "I").otherwise("D")
    rows = _aligned(spark, sf_dir, keep=True).withColumns({"run": run, "size": size, "event": event})
    left = F.when(F.col("event") == "D", F.col("run") - F.col("size")).otherwise(F.col("run"))
    seen = F.when(F.col("event") == "I", F.col("run") + F.col("size")).otherwise(left)
    cigar = F.concat("cigar", F.when(F.col("event") == "M", "").otherwise(F.concat(F.col("size").cast("string"), "event")), (left + 200).cast("string"), F.lit("M"))
    seq = F.concat("seq", F.repeat(F.lit("T"), seen), F.repeat("ref", F.lit(2)))
    ref = F.concat("ref", F.repeat(F.lit("T"), F.col("run")), F.repeat("ref", F.lit(2)))
    return rows.select("mate", "reverse", "contig", "start0", cigar.alias("cigar"), seq.alias("seq"), ref.alias("ref"), F.repeat(F.lit("I"), F.length(seq)).alias("qual"))


RUN_AT = "least(10, len(regexp_extract(substr(whole, 1, {p} + 1), '(A+|C+|G+|T+)$')) + len(regexp_extract(substr(whole, {p} + 1), '^(A+|C+|G+|T+)')) - 1)"
LONG = f"""l AS MATERIALIZED (SELECT *, least(run, x // 9 % 2 + 1) AS size_, CASE WHEN x // 18 % 20 >= run THEN 'M' WHEN x // 360 % 2 = 0 THEN 'I' ELSE 'D' END AS event, ref || repeat('T', run::INT) || ref || ref AS whole
    FROM (SELECT *, (o_orderkey * 7919 + 13) % 1073741824 AS x, x % 9 + 1 AS run FROM ({short_reads(40)}))),
  e AS (SELECT greatest({RUN_AT.format(p=99)}, {RUN_AT.format(p=100)}) AS run, 1 AS ins, 0 AS del FROM l WHERE event = 'I' UNION ALL SELECT greatest({RUN_AT.format(p=49)}, {RUN_AT.format(p=50)}), 1, 0 FROM l WHERE kind = 2
    UNION ALL SELECT {RUN_AT.format(p=100)}, 0, 1 FROM l WHERE event = 'D'),
  r AS (SELECT least(10, len(r)) AS run, sum(len(r)) AS bases FROM (SELECT unnest(regexp_extract_all(whole, 'A+|C+|G+|T+')) AS r FROM l) GROUP BY 1),
  f AS (SELECT r.run, bases, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del FROM r LEFT JOIN (SELECT run, sum(ins) AS ins, sum(del) AS del FROM e GROUP BY run) USING (run)),
  s AS (SELECT sum(ins)::DOUBLE / sum(bases) AS i, sum(del)::DOUBLE / sum(bases) AS d FROM f)"""


@query(
    "pro02_run_factors",
    f"WITH {LONG} SELECT run, bases::BIGINT AS bases, round(CASE WHEN i > 0 THEN (ins + 5) / (bases * i + 5) ELSE 1 END, 6) AS ins_factor, round(CASE WHEN d > 0 THEN (del + 5) / (bases * d + 5) ELSE 1 END, 6) AS del_factor FROM f, s",
)
def run_factors(spark, sf_dir):
    """PRO-02: indel factors by homopolymer length, from long alignments."""
    return pf.run_factors(pf.count_cells(_long_reads(spark, sf_dir), "long"))


@query(
    "pro02_long_rates",
    f"""WITH {LONG}, c AS (SELECT count(*) AS reads, sum(300 + run - CASE WHEN event = 'D' THEN size_ ELSE 0 END) AS aligned, count(*) FILTER (kind = 1) AS wrong, sum(CASE WHEN event = 'I' THEN size_ ELSE 0 END + CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS ins,
      sum(CASE WHEN event = 'D' THEN size_ ELSE 0 END) AS del, sum(size + 200 + run + CASE event WHEN 'I' THEN size_ WHEN 'D' THEN -size_ ELSE 0 END) AS bases FROM l)
    SELECT aligned::DOUBLE AS aligned, round(wrong / aligned, 6) AS mismatch_rate, round(ins / aligned, 6) AS ins_rate, round(del / aligned, 6) AS del_rate, round(bases / reads, 6) AS mean_read_length,
      round(wrong / (wrong + ins + del), 6) AS frac_sub, round(ins / (wrong + ins + del), 6) AS frac_ins, round(del / (wrong + ins + del), 6) AS frac_del FROM c""",
)
def long_rates(spark, sf_dir):
    """PRO-02: rates of long reads, in bases."""
    return pf.rates(pf.count_cells(_long_reads(spark, sf_dir), "long"), "long")


@query("pro01_transitions", f"SELECT cycle::BIGINT AS cycle, former, q, count(*) AS n FROM (SELECT cycle, q, lag(q) OVER (PARTITION BY o_orderkey ORDER BY cycle) AS former FROM ({all_bases(40)})) WHERE former IS NOT NULL GROUP BY ALL")
def transitions(spark, sf_dir):
    """PRO-01: how the quality of a base follows that of the base before, by cycle."""
    cells = pf.count_cells(_aligned(spark, sf_dir), "short").filter("kind = 'transition'")
    return cells.groupBy(F.col("a").alias("cycle"), F.col("b").alias("former"), F.col("c").alias("q")).agg(F.sum("n").alias("n"))


@query("pro03_refine", "SELECT round(least(greatest(r / p, 0.25), 4), 6) AS sub, 1::DOUBLE AS ins, 1::DOUBLE AS del FROM (SELECT count(*) FILTER (o_orderkey % 40 = 0)::DOUBLE AS r, count(*) FILTER (o_orderkey % 25 = 0)::DOUBLE AS p FROM orders)")
def refine(spark, sf_dir):
    """PRO-03: injected rates corrected by a pilot with other mismatches and as many indels."""
    real, pilot = (pf.rates(pf.count_cells(_aligned(spark, sf_dir, w), "short"), "short") for w in (40, 25))
    return pf.refine(real, pilot)


def compared(real: int, sim: int) -> str:
    """SQL of the comparison of two short profiles."""
    rates = lambda w: f"SELECT count(*) FILTER (kind <> 2 OR p <> 50)::DOUBLE AS aligned, count(*) FILTER (bad) / aligned AS mismatch_rate, count(*) FILTER (kind = 2 AND p = 50) / aligned AS ins_rate, 0::DOUBLE AS del_rate, count(*)::DOUBLE / count(DISTINCT o_orderkey) AS mean_read_length FROM b{w}"
    pair = " UNION ALL ".join(f"SELECT '{m}' AS metric, r.{m} AS real, s.{m} AS simulated FROM r{real} r, r{sim} s" for m in ("mismatch_rate", "ins_rate", "del_rate", "mean_read_length"))
    changed = lambda w: f"SELECT substr(ref, (o_orderkey % 90 + 2)::INT, 1) AS t, rev FROM b{w} WHERE bad"
    # A changed base is the next letter; on the other strand both are complements, so (letter, strand) stands for the pair.
    cell = "CASE WHEN rev THEN translate(t, 'ACGT', 'TGCA') || translate(translate(t, 'ACGT', 'CGTA'), 'ACGT', 'TGCA') ELSE t || translate(t, 'ACGT', 'CGTA') END"
    shares = lambda rows, value: f"SELECT {value} AS v, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ({rows}) GROUP BY 1"
    apart = lambda name, rows, value: f"SELECT '{name}' AS metric, (SELECT sum(abs(coalesce(x.share, 0) - coalesce(y.share, 0))) / 2 FROM ({shares(rows(real), value)}) x FULL JOIN ({shares(rows(sim), value)}) y USING (v)) AS d"
    curve = lambda w: f"SELECT cycle, count(*) FILTER (bad)::DOUBLE / count(*) AS rate FROM b{w} WHERE kind <> 2 OR p <> 50 GROUP BY cycle"
    quality = lambda w: f"SELECT cycle, avg(q) AS quality FROM b{w} GROUP BY cycle"
    tables = ", ".join(f"b{w} AS MATERIALIZED ({all_bases(w)}), r{w} AS ({rates(w)})" for w in (real, sim))
    far = " UNION ALL ".join(
        (apart("substitution spectrum", changed, cell), apart("quality distribution, mate 1", lambda w: f"SELECT q FROM b{w} WHERE cycle > 0", "q"))
    )
    return f"""WITH {tables}, rows_ AS (SELECT metric, real, simulated, CASE WHEN real <> 0 THEN (simulated - real) / real END AS difference FROM ({pair}))
    SELECT metric, round(real, 6) AS real, round(simulated, 6) AS simulated, round(difference, 6) AS difference, coalesce(abs(difference) <= 0.25, false) AS ok FROM rows_
    UNION ALL SELECT metric, 0, round(d, 6), round(d, 6), d <= 0.25 FROM ({far})
    UNION ALL SELECT 'per-cycle error curve, mate 1', 1, round(r, 6), round(1 - r, 6), coalesce(r >= 0.75, false) FROM (SELECT corr(x.rate, y.rate) AS r FROM ({curve(real)}) x JOIN ({curve(sim)}) y USING (cycle))
    UNION ALL SELECT 'per-cycle mean quality, mate 1', 0, round(g, 6), round(g, 6), g <= 2 FROM (SELECT max(abs(x.quality - y.quality)) AS g FROM ({quality(real)}) x JOIN ({quality(sim)}) y USING (cycle))"""


@query("pro04_compare", compared(40, 36))
def compare_profiles(spark, sf_dir):
    """PRO-04: two profiles side by side."""
    real, sim = (pf.count_cells(_aligned(spark, sf_dir, w), "short") for w in (40, 36))
    return pf.compare(real, sim, "short")


def _genome(spark, sf_dir):
    """Chunks of a reference whose contigs are the documents of a language, letters turned to bases."""
    docs = table(spark, sf_dir, "documents")
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    body = docs.filter(F.lower("text").rlike("[a-z]")).select("lang", F.concat(F.lit("a"), "lang", F.lit("1"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("at"), letters.alias("value"))
    heads = docs.select("lang").distinct().select(F.concat(F.lit("a"), "lang", F.lit("0")).alias("at"), F.concat(F.lit(">"), "lang").alias("value"))
    return rd.fasta_chunks(heads.unionByName(body.select("at", "value")), "at")


# Configuration -------------------------------------------------------------------------------------------------------


@query("cfg01_dataset_grid", "SELECT concat('sim-', n_name, '-', r_name, '-d', d) AS dataset, n_name AS genome, r_name AS platform, d AS divergence FROM nation, region, (SELECT unnest(['0', '0.01', '0.05']) AS d)")
def dataset_grid(spark, sf_dir):
    """CFG-01: genomes x platforms x divergence levels."""
    genomes = table(spark, sf_dir, "nation").select(F.col("n_name").alias("genome"))
    platforms = table(spark, sf_dir, "region").select(F.col("r_name").alias("platform"))
    return config.dataset_grid(genomes, platforms, ["0", "0.01", "0.05"])


# Sinks and stores, written and read again ---------------------------------------------------------------------------


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("snk01_02_tables", "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, k FROM orders, (SELECT unnest(['parquet', 'tsv']) AS k)")
def written_tables(spark, sf_dir):
    """SNK-01, SNK-02, SRC-15: a table written as Parquet and as TSV, both read again and gathered."""
    rows, at = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), _folder(spark)
    tb.write_table(rows, f"{at}/p")
    tb.write_tsv(rows, f"{at}/t")
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    return tb.gather([spark.read.parquet(f"{at}/p").withColumn("k", F.lit("parquet")), tb.read_tsv(spark, [f"{at}/t"], schema).withColumn("k", F.lit("tsv"))])


@query("snk03_src14_strata_folder", oracle("SELECT set_name, contig, start0, end0, label FROM annot", "annot"))
def strata_folder(spark, sf_dir):
    """SNK-03, SRC-14: every set written as BED4 and the folder read again."""
    rows, at = fx.annotations(spark, sf_dir), _folder(spark)
    for name in ("ptype", "conf"):
        an.write_bed(rows.filter(F.col("set_name") == name), f"{at}/{name}.bed")
    return an.strata_folder(spark, at)


@query("snk04_src01_fastq", oracle("SELECT qname, seq, repeat('I', length(seq)) AS qual FROM bases", "bases"))
def fastq(spark, sf_dir):
    """SNK-04, SRC-01: reads written as gzipped FASTQ and read again."""
    rows, at = fx.bases(spark, sf_dir).withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), _folder(spark)
    rd.write_fastq(rows, at)
    return rd.fastq(spark, at).select("qname", "seq", "qual")


VCF_LINE = "concat_ws('\t', CAST(user_id % 6 AS STRING), CAST((event_id * 1237) % 100000 + 1 AS STRING), '.', CASE WHEN event_id % 3 = 0 THEN 'ACG' ELSE 'A' END, 'T,GG', '.', '.', '.', 'GT', CASE WHEN event_id % 2 = 0 THEN '0|1' ELSE '1/1' END)"


def _vcf(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS at", f"CASE WHEN event_id % 50 = 0 THEN '#comment' WHEN event_id % 50 = 1 THEN '##contig=<ID=1>' ELSE {VCF_LINE} END AS value")


@query("src10_vcf", "SELECT (user_id % 6)::VARCHAR AS contig, (event_id * 1237) % 100000 + 1 AS pos1, CASE WHEN event_id % 3 = 0 THEN 'ACG' ELSE 'A' END AS ref, 'T,GG' AS alts, CASE WHEN event_id % 2 = 0 THEN '0|1' ELSE '1/1' END AS genotype FROM events WHERE event_id % 50 > 1")
def vcf(spark, sf_dir):
    """SRC-10: fields of VCF lines."""
    return an.vcf(_vcf(spark, sf_dir).select("value"))


@query("snk05_prepared_vcf", "SELECT event_id AS at, CASE WHEN event_id % 50 = 0 THEN '#comment' WHEN user_id % 6 = 5 THEN NULL ELSE concat('chr', user_id % 6, chr(9), (event_id * 1237) % 100000 + 1, chr(9), '.') END AS front FROM events WHERE event_id % 50 <> 1")
def prepared_vcf(spark, sf_dir):
    """SNK-05: VCF lines with the names of our contigs."""
    names = nm.name_table(spark.createDataFrame([(f"chr{i}",) for i in range(5)], "name string"))
    lengths = spark.createDataFrame([(f"chr{i}", 100_000) for i in range(5)], "contig string, length long")
    return an.prepare_vcf(_vcf(spark, sf_dir), "at", names, lengths).select("at", F.array_join(F.slice(F.split("value", "\t"), 1, 3), "\t").alias("front"))


@query("snk05_vcf_stats", "SELECT count(*) FILTER (user_id % 6 <> 5) AS variants_kept, count(*) FILTER (user_id % 6 = 5) AS variants_on_other_contigs FROM events WHERE event_id % 50 > 1")
def vcf_stats(spark, sf_dir):
    """SNK-05: how many variants were kept."""
    names = nm.name_table(spark.createDataFrame([(f"chr{i}",) for i in range(5)], "name string"))
    lengths = spark.createDataFrame([(f"chr{i}", 100_000) for i in range(5)], "contig string, length long")
    return an.vcf_stats(an.prepare_vcf(_vcf(spark, sf_dir), "at", names, lengths))


LETTERS = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query("src11_12_bases", f"SELECT lang, o_orderkey AS rid, substr(own, (o_orderkey * 31) % 9000 + 1, 60) AS ref FROM (SELECT lang, string_agg({LETTERS}, '' ORDER BY doc_id) AS own FROM documents WHERE lang IN ('de', 'en') GROUP BY lang) g JOIN orders ON lang = CASE WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'en' END")
def reference_bases(spark, sf_dir):
    """SRC-11, SRC-12: the bases of intervals, from the chunks of chosen contigs."""
    wanted = spark.createDataFrame([("de",), ("en",)], "name string")
    chunks = rd.select_contigs(_genome(spark, sf_dir), wanted, wanted.select("name", F.col("name").alias("canonical")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), F.when(F.col("o_orderkey") % 2 == 0, "de").otherwise("en").alias("contig"), ((F.col("o_orderkey") * 31) % 9000).alias("start0"))
    return rd.attach_reference(rows.withColumn("end0", F.col("start0") + 60), chunks, "rid").select(F.col("contig").alias("lang"), "rid", "ref")


@query("src18_profile_store", ORACLES["pro01_mismatches"])
def stored_profile(spark, sf_dir):
    """SRC-18: a profile saved, loaded and turned into rates."""
    at = _folder(spark)
    pf.save_profile(pf.count_cells(_aligned(spark, sf_dir), "short"), at, {"kind": "short"})
    cells, facts = pf.load_profile(spark, at)
    out = pf.rates(cells, facts["kind"])
    return out.select(F.col("aligned").cast("long").alias("aligned"), "mismatch_rate", "ins_rate", "del_rate")


# Text, resources and the truth-free bundle --------------------------------------------------------------------------


@query("sca36_general", "SELECT l_orderkey, l_linenumber, printf('%g', sqrt(l_extendedprice) / power(10, l_linenumber * 2 - 3)) AS shown FROM lineitem")
def general(spark, sf_dir):
    """SCA-36: numbers in six significant digits."""
    value = F.sqrt("l_extendedprice") / F.pow(F.lit(10.0), F.col("l_linenumber") * 2 - 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sc.general(value).alias("shown"))


@query("sca30_words", "SELECT p_partkey, trim(replace(replace(replace(replace(concat(p_name, '_of >=', p_size, ' <5'), '>=', '≥ '), '<', '< '), '_', ' '), '  ', ' ')) AS shown FROM part")
def shown_words(spark, sf_dir):
    """SCA-30: table cells for readers."""
    return table(spark, sf_dir, "part").select("p_partkey", sc.words(F.concat("p_name", F.lit("_of >="), "p_size", F.lit(" <5"))).alias("shown"))


@query("joi14_resources", "SELECT n_nationkey AS platform, l_linestatus AS \"group\", median(l_quantity) AS seconds, max(l_extendedprice) AS max_rss FROM lineitem JOIN (SELECT s_suppkey AS target, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS n_nationkey FROM supplier) ON target = l_suppkey WHERE l_returnflag = 'A' AND n_nationkey IS NOT NULL GROUP BY ALL")
def resources(spark, sf_dir):
    """JOI-14: time and memory of the mapping steps of known datasets."""
    bench = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "map").otherwise("sort").alias("step"), F.col("l_suppkey").alias("target"), F.col("l_linestatus").alias("group"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("max_rss"))
    platforms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("platform"))
    return scoring.resources(bench, platforms)


PLACED = f"""SELECT s.*, c.label, CASE WHEN coalesce(share, 0) <= 0 THEN 'none' WHEN share < 0.5 THEN 'partial_<50%' WHEN share < 0.95 THEN 'mostly_50-95%' ELSE 'entire_>=95%' END AS cover,
    CASE WHEN coalesce(share, 0) >= 0.5 THEN 'confident' ELSE 'outside_confident' END AS conf
  FROM ({STATUSES}) s LEFT JOIN (SELECT m.qname, m.mate, 'confident' AS label, sum(least(m.end0, w.end0) - greatest(m.start0, w.start0))::DOUBLE / any_value(m.end0 - m.start0) AS share
    FROM majority m JOIN merged w ON w.set_name = 'conf' AND w.contig = m.contig AND w.start0 < m.end0 AND m.start0 < w.end0 WHERE m.has_consensus GROUP BY m.qname, m.mate) c ON c.qname = s.qname AND c.mate = s.mate"""


@query(
    "maj02_truth_free",
    oracle(
        " UNION ALL ".join(f"SELECT aligner, '{n}' AS stratum_set, {e} AS stratum, {SUMMARY} FROM ({PLACED}) WHERE {w} GROUP BY ALL" for n, e, w in (("all", "'all'", "true"), ("conf", "conf", "has_consensus"), ("conf_cover", "cover", "has_consensus"))),
        "majority",
        "merged",
    ),
)
def truth_free(spark, sf_dir):
    """MAJ-02: disagreement with the majority over all reads and by the strata of its placements."""
    return co.truth_free(_placements(spark, sf_dir), TOOLS, fx.annotations(spark, sf_dir).filter("set_name = 'conf'"), ["conf"])[0]


@query("maj02_observables", ORACLES["agg11_12_observables"])
def truth_free_observables(spark, sf_dir):
    """MAJ-02: what the tools report, as the other half of the truth-free bundle."""
    return co.truth_free(_placements(spark, sf_dir), TOOLS, fx.annotations(spark, sf_dir).filter("set_name = 'conf'"), ["conf"])[1]


# Queries of files in parts register with these.
from . import files  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "files"]
