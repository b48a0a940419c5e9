"""Edge cases of single operators with known results."""

import copy
import gzip
import itertools
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placetrail.functions import scalars
from placetrail.functions import scalars as sc
from placetrail.functions import sequence as sq
from placetrail.operators import consensus, intervals, names, profile, qc, scoring, statistics, strata, variants
from placetrail.plans import catalog, config, digest
from placetrail.sources import annotations, reads, tables
from placetrail.streaming import counts


def one(spark, **columns):
    return list(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def test_coordinates(spark):
    assert list(one(spark, x=sc.closed_to_bed(F.lit(11), F.lit(20)))[0]) == [10, 20]
    assert list(one(spark, x=sc.vcf_to_bed(F.lit(100), F.lit("ACGT")))[0]) == [99, 103]
    assert one(spark, x=sc.region_string(F.lit("chr1"), F.lit(10), F.lit(20))) == ["chr1:11-20"]
    for bad in (sc.closed_to_bed(F.lit(0), F.lit(5)), sc.bed_to_closed(F.lit(5), F.lit(5))):
        with pytest.raises(PySparkException):
            one(spark, x=bad)


def test_overlap_and_iou(spark):
    assert one(spark, a=sc.overlap(*map(F.lit, (0, 10, 10, 20))), b=sc.overlap(*map(F.lit, (0, 10, 9, 20)))) == [0, 1]
    assert one(spark, a=sc.iou(*map(F.lit, (0, 100, 100, 200))), b=sc.iou(*map(F.lit, (0, 100, 50, 150)))) == [0.0, pytest.approx(1 / 3)]


def test_wilson_and_phred(spark):
    low, high = sc.wilson(F.lit(0), F.lit(1000))
    assert one(spark, a=low)[0] == 0 and 0.003 < one(spark, b=high)[0] < 0.005
    low, high = sc.wilson(F.lit(0), F.lit(0))
    assert one(spark, a=low, b=high) == [None, None]
    assert one(spark, a=sc.phred(F.lit(0.001)), b=sc.phred(F.lit(0.0))) == [pytest.approx(30), pytest.approx(100)]
    ideal = [one(spark, q=sc.ideal_mapq(F.lit(1.0), F.lit(e), F.lit(1.0)))[0] for e in (0.001, 0.01, 0.1)]
    assert ideal == sorted(ideal, reverse=True) and len(set(ideal)) == 3


READ = "qname string, mate int, contig string, start0 long, end0 long, strand string"
ALN = "qname string, mate int, mapped boolean, contig string, start0 long, end0 long, strand string, mapq int, nm int, read_len int, clipped int, split boolean"


def test_outcomes(spark):
    names = ["hit", "far", "elsewhere", "lost", "silent", "beside"]
    truth = spark.createDataFrame([(q, 0, "chr7", 40_000, 40_090, "+") for q in names], READ)
    place = lambda q, contig, start, mapped=True: (q, 0, mapped, contig, start, start + 90, "+", 60, 0, 90, 0, False)
    aln = spark.createDataFrame([place("hit", "chr7", 40_010), place("far", "chr7", 77_000), place("elsewhere", "chrX", 40_000), place("lost", "", -1, False), place("beside", "chr7", 40_085)], ALN)
    want = {"hit": ("correct", ""), "far": ("misplaced", "same_contig_elsewhere"), "elsewhere": ("misplaced", "other_contig"), "lost": ("unmapped", ""), "silent": ("unmapped", ""), "beside": ("misplaced", "same_locus_low_overlap")}
    assert {r.qname: (r.outcome, r.misplaced_kind) for r in scoring.evaluate(truth, aln).collect()} == want
    # All tools at once give each tool's own rows, doubled where a tool places a read twice.
    other = aln.filter("qname <> 'hit'").union(aln.filter("qname = 'far'"))
    both = scoring.evaluate_all(truth, {"one": aln, "two": other}).collect()
    assert {r.qname: (r.outcome, r.misplaced_kind) for r in both if r.aligner == "one"} == want and sum(r.aligner == "one" for r in both) == 6
    assert sorted(r.qname for r in both if r.aligner == "two") == sorted([*names, "far"]) and {r.outcome for r in both if r.aligner == "two" and r.qname == "hit"} == {"unmapped"}
    with pytest.raises(PySparkException):
        scoring.evaluate(truth.union(truth), aln, validate=True).collect()


def test_calibration_runs_down_from_high_mapq(spark):
    counts = spark.createDataFrame([("x", 60, 1000, 0), ("x", 30, 100, 1), ("x", 0, 50, 25)], "aligner string, mapq int, n_mapped long, n_wrong long")
    got = {r.mapq: r for r in scoring.calibration(counts, ["aligner"]).collect()}
    assert [got[q].cum_mapped for q in (60, 30, 0)] == [1000, 1100, 1150] and got[0].cum_wrong == 26
    assert got[30].empirical_mapq == pytest.approx(20) and got[60].no_errors_seen and got[60].empirical_mapq < 30


def test_dominant_label_keeps_exactly_half(spark):
    marks = [("s", "c", 1000, 1040, "dune"), ("s", "c", 1020, 1064, "dune"), ("s", "c", 3000, 3032, "marsh"), ("s", "c", 3016, 3032, "dune"), ("other", "d", 0, 5, "x")]
    annot = spark.createDataFrame(marks, "set_name string, contig string, start0 long, end0 long, label string")
    asked = spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate([(0, 64), (1000, 1064), (1054, 1086), (2984, 3016), (3016, 3032)])], "rid int, contig string, start0 long, end0 long")
    got = {(r.rid, r.set_name): (r.label, r.fraction) for r in intervals.dominant_labels(asked, annot, "rid", width=16).collect()}
    assert {i: got[i, "s"] for i in range(5)} == {0: ("none", 0.0), 1: ("dune", 1.0), 2: ("none", 0.3125), 3: ("marsh", 0.5), 4: ("dune", 1.0)}
    assert all(got[i, "other"] == ("none", 0.0) for i in range(5))


def test_binned_join_equals_plain_join(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [("c", int(s), int(s + w)) for s, w in zip(rng.integers(0, 5000, n), rng.integers(1, 900, n), strict=True)]
    a, b = make(80), make(60)
    left = spark.createDataFrame(a, "contig string, start0 long, end0 long")
    right = spark.createDataFrame(b, "contig string, r_start long, r_end long")
    got = sorted((r.start0, r.end0, r.r_start, r.r_end) for r in intervals.overlap_join(left, right, 100).collect())
    assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if s < v and u < e)


def test_majority_needs_a_strict_majority(spark):
    place = lambda q, start: (q, 0, True, "chr1", start, start + 100, "+", 60, 0, 100, 0, False)
    starts = {"a": (0, 0, 0), "b": (0, 0, 5000), "c": (10, 9000, 7000), "d": (5000, 9000, 3000)}
    tools = {t: spark.createDataFrame([place(f"r{i}", s) for i, s in enumerate(v)], ALN) for t, v in starts.items()}
    got = {r.qname: r for r in consensus.consensus(consensus.long_table(tools), list(tools)).collect()}
    assert (got["r0"].has_consensus, got["r0"].support, got["r0"].status_d) == (True, 3, "disagree")
    assert not got["r1"].has_consensus and not got["r2"].has_consensus


def test_statistics(spark):
    side = spark.createDataFrame([(1, x, s) for x in range(5) for s in (True, False)] + [(2, x, x < 5) for x in range(10)], "g int, x int, s boolean")
    assert {r.g: r.ks for r in statistics.ks_distance(side, ["g"], "x", "s").collect()} == {1: 0.0, 2: 1.0}
    lengths = spark.createDataFrame([(1, x) for x in (2, 2, 2, 3, 3, 4, 8, 8)], "g int, length long")
    assert statistics.n50(lengths, ["g"], "length").first()["n50"] == 8
    pairs = spark.createDataFrame([(1, float(x), float(x * x)) for x in range(5)] + [(2, 1.0, float(x)) for x in range(5)], "g int, x double, y double")
    assert {r.g: r.rho for r in statistics.spearman(pairs, ["g"], "x", "y").collect()} == {1: pytest.approx(1.0), 2: None}


def test_names(spark):
    reference = spark.createDataFrame([("chr1",), ("chrM",)], "name string")
    groups = spark.createDataFrame([(1, "chr1"), (1, "NC_1"), (2, "NC_9")], "group_id long, name string")
    table = names.name_table(reference, names.aliases(groups, reference))
    rows = spark.createDataFrame([("1",), ("MT",), ("NC_1",), ("NC_9",)], "contig string")
    assert {r.contig: r.canonical for r in names.resolve(rows, table).collect()} == {"1": "chr1", "MT": "chrM", "NC_1": "chr1", "NC_9": None}


def test_wrong_assembly_is_refused(spark):
    parsed = spark.createDataFrame([("s", "chr1", 900, 1100, "x")], "set_name string, contig string, start0 long, end0 long, label string")
    reference = spark.createDataFrame([("chr1",)], "name string")
    lengths = spark.createDataFrame([("chr1", 1000)], "contig string, length long")
    with pytest.raises(PySparkException, match="assembly"):
        strata.build_strata(parsed, names.name_table(reference), lengths)[1].collect()


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown annotation format"):
        annotations.parse(spark.createDataFrame([], "value string"), "xyz")


def test_long_read_filter_and_halves(spark, tmp_path):
    path = tmp_path / "x.fastq.gz"
    records = [("a", 2000, "!"), ("b", 2000, "$"), ("c", 2000, "I"), ("d", 200, "I")]
    with gzip.open(path, "wt") as file:
        for name, n, q in records:
            file.write(f"@{name} more\n{'A' * n}\n+\n{q * n}\n")
    got = reads.fastq(spark, str(path))
    judged = qc.judge_reads(got, 1000, 7.0)
    assert {r.qname: r.reason for r in judged.collect()} == {"a": None, "b": "low_quality", "c": None, "d": "too_short"}
    metrics = {(r.step, r.metric): r.value for r in qc.filter_accounting(judged).collect()}
    assert metrics["filter:low_quality", "reads_without_quality_fraction"] == 0.25
    halves = qc.split_alternating(judged.filter("reason is null"), "file_order", block_rows=1)
    assert {r.qname: r.half for r in halves.collect()} == {"a": "calibration", "c": "held_out"}


def test_cigar_walk(spark):
    ops = sq.cigar_ops(spark.createDataFrame([(1, "2S3M1I2M2D1M")], "rid int, cigar string"), "rid").orderBy("op_index").collect()
    assert [(r.op, r.read_offset, r.ref_offset) for r in ops] == [("S", 0, 0), ("M", 2, 0), ("I", 5, 3), ("M", 6, 3), ("D", 8, 5), ("M", 8, 7)]


def test_greedy_variants(spark):
    rows = [("c", 0, 0, 10, "A"), ("c", 0, 5, 10, "A"), ("c", 0, 12, 2, "A"), ("c", 0, 13, 1, "A"), ("c", 1, 5, 1, "A")]
    got = variants.keep_apart(spark.createDataFrame(rows, "contig string, hap int, start0 long, ref_len int, alt string"))
    assert {(r.hap, r.start0): r.kept for r in got.collect()} == {(0, 0): True, (0, 5): False, (0, 12): True, (0, 13): False, (1, 5): True}


@pytest.fixture(scope="module")
def genome(spark):
    rng = np.random.default_rng(3)
    seq = "".join(rng.choice(list("ACGT"), 20000))
    lines = [(0, ">c1 x")] + [(i + 1, seq[k : k + 70]) for i, k in enumerate(range(0, len(seq), 70))] + [(9000, ">c2"), (9001, "ACGTN" * 2000)]
    return seq, reads.fasta_chunks(spark.createDataFrame(lines, "at long, value string"), "at", 512)


def plain_apply(ref: str, start0: int, own: list[tuple[int, int, str]]) -> tuple[str, list[int], int]:
    bases, positions, at, applied = "", [], 0, 0
    for begin, length, alt in sorted(own):
        offset = begin - start0
        if offset < at or offset + length > len(ref):
            continue
        bases += ref[at:offset] + alt
        positions += [*range(start0 + at, begin), *(begin + min(i, length - 1) for i in range(len(alt)))]
        at, applied = offset + length, applied + 1
    return bases + ref[at:], [*positions, *range(start0 + at, start0 + len(ref))], applied


def test_apply_variants(spark):
    rng = np.random.default_rng(4)
    refs = {i: (int(rng.integers(0, 60)), "".join(rng.choice(list("ACGT"), int(rng.integers(1, 40)))), i % 2) for i in range(60)}
    own = [("c", int(h), int(s), int(n), "".join(rng.choice(list("ACGT"), int(k)))) for h, s, n, k in zip(rng.integers(0, 2, 90), rng.integers(0, 110, 90), rng.integers(1, 6, 90), rng.integers(1, 5, 90), strict=True)]
    windows = spark.createDataFrame([(i, "c", h, s, q) for i, (s, q, h) in refs.items()] + [(99, "none", 0, 7, "ACG")], "window_id int, contig string, hap int, start0 long, seq string")
    kept = spark.createDataFrame([(*v, True) for v in own] + [("c", 0, 3, 1, "A", False)], "contig string, hap int, start0 long, ref_len int, alt string, kept boolean")
    got = {r.window_id: (r.sample_seq, list(r.positions), r.n_variants) for r in variants.apply_to_windows(windows, kept).collect()}
    want = {i: plain_apply(q, s, [v[2:] for v in own if v[1] == h and s <= v[2] < s + len(q)]) for i, (s, q, h) in refs.items()}
    assert got == want | {99: ("ACG", [7, 8, 9], 0)} and any(n for _, _, n in want.values())
    seq, places, n = plain_apply("GGCATTAC", 40, [(41, 1, "TT"), (43, 3, "G"), (47, 5, "A")])
    assert (seq, places, n) == ("GTTCGAC", [40, 41, 41, 42, 43, 46, 47], 2)


def test_reference_bases_of_intervals(spark, genome):
    seq, chunks = genome
    assert {r.contig: r.length for r in reads.contig_lengths(chunks).collect()} == {"c1": 20000, "c2": 10000}
    rows = [(i, "c1", i * 37, i * 37 + 1 + i * 11) for i in range(150)]
    got = reads.attach_reference(spark.createDataFrame(rows, "rid long, contig string, start0 long, end0 long"), chunks, "rid", 512).collect()
    assert {r.rid: r.ref for r in got} == {i: seq[a:b] for i, _, a, b in rows}
    picked = reads.select_contigs(chunks, spark.createDataFrame([("C2",)], "name string"), spark.createDataFrame([("C2", "c2")], "name string, canonical string"))
    assert {r.contig for r in picked.collect()} == {"c2"}
    with pytest.raises(Exception, match="not in the reference"):
        reads.select_contigs(chunks, spark.createDataFrame([("c9",)], "name string"), spark.createDataFrame([("C2", "c2")], "name string, canonical string")).count()


def test_profile_recovers_known_rates(spark, genome):
    seq, chunks = genome
    rows, wrong = [], 0
    for i in range(300):
        own = list(seq[i * 61 : i * 61 + 100])
        for at in {i % 100, i * 7 % 100}:
            own[at], wrong = "ACGT"["CGTA".index(own[at])], wrong + 1
        rows.append((i, 0, i % 2 == 1, "c1", i * 61, i * 61 + 100, "100M", "".join(own), "I" * 100))
    aligned = spark.createDataFrame(rows, "rid long, mate int, reverse boolean, contig string, start0 long, end0 long, cigar string, seq string, qual string")
    cells = profile.count_cells(reads.attach_reference(aligned, chunks, "rid", 512), "short")
    got = profile.rates(cells, "short").first()
    assert got.aligned == 30_000 and got.mismatch_rate == pytest.approx(wrong / 30_000) and got.ins_rate == got.del_rate == 0


def test_masked_positions_and_bad_reads_do_not_count(spark):
    rows = [(0, False, "c", 10, "5M", "ACGTA", "IIIII", "ACCTA"), (0, True, "c", 30, "2M1D3M", "ACGTA", "IIIII", "ACTGTT")]
    aligned = spark.createDataFrame(rows, "mate int, reverse boolean, contig string, start0 long, cigar string, seq string, qual string, ref string")
    masked = spark.createDataFrame([("c", 12), ("c", 35)], "contig string, pos long")
    plain, hidden = profile.rates(profile.count_cells(aligned), "short").first(), profile.rates(profile.count_cells(aligned, masked=masked), "short").first()
    assert (plain.aligned, round(plain.aligned * plain.mismatch_rate), round(plain.aligned * plain.del_rate)) == (10, 2, 1)
    assert (hidden.aligned, hidden.mismatch_rate) == (8, 0)


def test_run_factors_query_counts_indels(spark, sf_dir):
    bases, events = Counter(), {"I": Counter(), "D": Counter()}
    for row in catalog._long_reads(spark, sf_dir).collect():
        runs = [min(len(list(group)), 10) for _, group in itertools.groupby(row.ref)]
        lengths = [size for size, (_, group) in zip(runs, itertools.groupby(row.ref), strict=True) for _ in group]
        bases.update(lengths)
        at = used = 0
        for size, op in re.findall(r"(\d+)([MID])", row.cigar):
            if op == "I":
                events["I"][max(lengths[max(at - 1, 0)], lengths[min(at, len(lengths) - 1)])] += 1
            if op == "D":
                events["D"][lengths[at]] += 1
            at += int(size) * (op != "I")
            used += int(size) * (op != "D")
        assert (at, used) == (len(row.ref), len(row.seq))
    assert len(events["I"]) > 4 and len(events["D"]) > 4
    got = {r.run: r for r in catalog.QUERIES["pro02_run_factors"](spark, sf_dir).collect()}
    assert {run: r.bases for run, r in got.items()} == bases
    for column, op in (("ins_factor", "I"), ("del_factor", "D")):
        share = events[op].total() / bases.total()
        assert {run: r[column] for run, r in got.items()} == pytest.approx({run: (events[op][run] + 5) / (n * share + 5) for run, n in bases.items()}, abs=1e-6)
        assert max(r[column] for r in got.values()) > 1.5


def test_refine_query_uses_measured_indels(spark, sf_dir, monkeypatch):
    def aligned(spark, sf_dir, wrong=40):
        cigars = ["4M1I4M"] * (3 if wrong == 40 else 2) + ["4M1D5M"] * (1 if wrong == 40 else 3)
        rows = [(0, False, "c", 0, c, "ACGTACGTC", "I" * 9, "ACGTCGTC" if "I" in c else "ACGTAACGTC") for c in cigars]
        return spark.createDataFrame(rows, "mate int, reverse boolean, contig string, start0 long, cigar string, seq string, qual string, ref string")

    monkeypatch.setattr(catalog, "_aligned", aligned)
    got = catalog.QUERIES["pro03_refine"](spark, sf_dir).first()
    real, pilot = 3 * 8 + 1 * 9, 2 * 8 + 3 * 9  # aligned bases
    assert got["ins"] == pytest.approx((3 / real) / (2 / pilot), abs=1e-6) and got["del"] == pytest.approx((1 / real) / (3 / pilot), abs=1e-6)


def test_comparison_has_every_check(spark):
    def cells(*rows):
        return spark.createDataFrame(rows, profile.CELLS)

    def got(real, sim, kind):
        return {r.metric: (r.real, r.simulated, r.difference, r.ok) for r in profile.compare(real, sim, kind).collect()}

    def short(q, far):
        return cells(("first", 0, 30, 0, 0, 10), ("transition", 0, 1, 30, q, 10), ("first", 1, 30, 0, 0, 4), ("transition", 1, 1, 30, 31, 4), ("cycle", 0, 0, 0, 0, 9), ("cycle", 0, 1, 1, 0, 9), ("fragment", 0, 300, 0, 0, 3), ("fragment", 0, far, 0, 0, 4))

    rows = got(short(30, 301), short(33, 500), "short")
    assert rows["per-cycle mean quality, mate 1"] == (0, 3, 3, False) and rows["per-cycle mean quality, mate 2"] == (0, 0, 0, True)
    assert rows["fragment_median"][:2] == (301, 500) and not rows["fragment_median"][3]
    assert "fragment_median" not in got(short(30, 301).filter("kind <> 'fragment'"), short(30, 301), "short")

    def long(events, errors):
        runs = [("run", 0, 1, 0, 0, 1000), ("run", 0, 5, 0, 0, 100), ("run_insertion", 0, 1, 0, 0, 10), ("run_insertion", 0, 5, 0, 0, events), ("run_deletion", 0, 1, 0, 0, 10)]
        return cells(*runs, ("error", 0, errors, 1000, 0, 3), ("error", 0, 50, 1000, 0, 1), ("read", 0, 1000, 0, 0, 3), ("read", 0, 4000, 0, 0, 1))

    rows = got(long(10, 50), long(60, 100), "long")
    assert rows["read_n50"][:2] == (4000, 4000) and rows["mean_error"][:2] == pytest.approx((0.05, 0.0875)) and not rows["mean_error"][3]
    assert rows["per-read error distribution"][1:] == (0.75, 0.75, False)

    def mean(events, others):
        factor = {5: (events + 5) / (100 * (events + others) / 1100 + 5)}
        return sum(factor.get(run, 1.0) * (101 if run == 5 else 1) for run in range(4, 11)) / 107

    assert rows["hp_ins_factor (homopolymer >= 4)"][:2] == pytest.approx((mean(10, 10), mean(60, 10))) and not rows["hp_ins_factor (homopolymer >= 4)"][3]
    assert rows["hp_del_factor (homopolymer >= 4)"][:2] == pytest.approx((mean(0, 10),) * 2) and rows["hp_del_factor (homopolymer >= 4)"][3]


def test_report(spark, tmp_path):
    table = scoring.add_rates(spark.createDataFrame([("a", 10, 9, 1, 0, 10, 0), ("b", 0, 0, 0, 0, 0, 0)], "aligner string, n long, n_correct long, n_misplaced long, n_unmapped long, n_confident long, n_confident_wrong long"))
    digest.build_report({"Accuracy": table.orderBy("aligner")}, str(tmp_path))
    text = (tmp_path / "summary.md").read_text()
    assert "## Accuracy" in text and digest.parse_markdown(text)[0][0] == "Accuracy" and digest.parse_markdown(text)[0][2][1][0] == "b"
    assert "<table>" in (tmp_path / "report.html").read_text()


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    schema = "aligner string, qname string, mate int, outcome string, mapq int"
    rows = [("t", f"r{i}", 0, "misplaced" if i % 7 == 0 else "correct", i % 3 * 30) for i in range(100)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    query = counts.mapq_counts_stream(spark, str(tmp_path / "in"), schema).writeStream.outputMode("complete").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("seen").collect()}
    assert got == {tuple(r) for r in scoring.mapq_counts(spark.createDataFrame(rows, schema), ["aligner"]).collect()}


def test_download_checks_md5(tmp_path):
    source = tmp_path / "a"
    source.write_text("x")
    with pytest.raises(ValueError, match="MD5"):
        tables.download(str(source), str(tmp_path / "b"), md5="0" * 32)
    assert tables.download(str(source), str(tmp_path / "b"))["bytes"] == 1


def test_prepared_variants(spark):
    lines = ["##source=x", "##contig=<ID=1>", "#CHROM\tPOS", "1\t5\tr", "2\t7\tr", "9\t1\tr"]
    text = spark.createDataFrame(list(enumerate(lines)), "at long, value string")
    names, lengths = spark.createDataFrame([("1", "chr1"), ("2", "chr2")], "name string, canonical string"), spark.createDataFrame([("chr1", 9), ("chr2", 9)], "contig string, length long")
    out = annotations.prepare_vcf(text, "at", names, lengths)
    assert [r.value for r in out.filter("value is not null").orderBy("at").collect()] == ["##source=x", "#CHROM\tPOS", "chr1\t5\tr", "chr2\t7\tr"]
    assert tuple(annotations.vcf_stats(out).first()) == (2, 1)
    with pytest.raises(Exception, match="lies beyond the end"):
        annotations.prepare_vcf(text, "at", names, lengths.withColumn("length", F.lit(6))).collect()


def test_numbers_and_words(spark):
    cells = ["1e+03", "1.707e-05", "-2.5e+06", "12", "0.5%", "abc"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(scalars.pretty_number(F.col("c")).alias("p")).collect()
    assert [r.p for r in got] == ["1,000", "1.71 × 10⁻⁵", "-2,500,000", "12", "0.5%", "abc"]
    values = [0.0, 1.0, 0.05, 1234567.0, 1e-5, 123456.0, -0.000123456789, 1e20, 0.1 + 0.2]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(scalars.general(F.col("v")).alias("g")).collect()
    assert [r.g for r in got] == [f"{v:g}" for v in values]
    assert spark.range(1).select(scalars.words(F.lit("rate_of >=30 <5"))).first()[0] == "rate of ≥ 30 < 5"


def test_config_checks():
    good = {"genomes": {"g": {}}, "platforms": {"p": {"type": "short", "calibrate_on": "r"}}, "real_reads": {"r": {"platform": "p", "genome": "g"}}, "simulation": {"divergence_series": {"genomes": ["g"], "levels": [0.01]}}}
    assert {d["dataset"] for d in config.datasets(good)} == {"sim-g-p-d0", "sim-g-p-d0.01", "calib-r", "pilot-r", "real-r-on-g"}
    for path, value, said in ((("platforms", "p", "type"), "odd", "type"), (("platforms", "p", "calibrate_on"), "x", "calibrate_on"), (("real_reads", "r", "genome"), "h", "genome"), (("real_reads", "r", "platform"), "q", "platform")):
        bad = copy.deepcopy(good)
        bad[path[0]][path[1]][path[2]] = value
        with pytest.raises(ValueError, match=said):
            config.datasets(bad)
    with pytest.raises(ValueError, match="letters"):
        config.datasets({**good, "genomes": {"g": {}, "a b": {}}})


def test_runs_of_intervals_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [("x" if rng.random() < 0.8 else "y", int(a), int(a + rng.integers(1, 60))) for a in rng.integers(0, 4000, 400)]
    frame = spark.createDataFrame(rows, "contig string, start0 long, end0 long")
    want = set()
    for contig in "xy":
        now = None
        for _, a, b in sorted(r for r in rows if r[0] == contig):
            if now is None or a > now[1]:
                want |= {(contig, *now)} if now else set()
                now = [a, b]
            now[1] = max(now[1], b)
        want.add((contig, *now))
    for size in (10_000, 37):
        assert {tuple(r) for r in intervals.merge_intervals(frame, ("contig",), rows_a_range=size).collect()} == want


def test_download_goes_on_where_it_stopped(tmp_path):
    import http.server
    import threading

    body, asked = bytes(range(256)) * 40, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers.get("Range"))
            start = int(asked[-1].removeprefix("bytes=").rstrip("-")) if asked[-1] else 0
            self.send_response(206 if start else 200)
            self.end_headers()
            self.wfile.write(body[start:])

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    target = tmp_path / "f"
    (tmp_path / "f.part").write_bytes(body[:1000])
    got = tables.download(f"http://127.0.0.1:{server.server_port}/f", str(target))
    server.shutdown()
    assert target.read_bytes() == body and asked == ["bytes=1000-"] and got["bytes"] == len(body)


def test_names_and_checks(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "name string") for t in (["x", "y", "x", None], ["y", "z", None]))
    assert {r[0] for r in names.in_both(a, b, "name").collect()} == {"y", None} and [r[0] for r in names.missing(a, b, "name").collect()] == ["x"]
    checks = spark.createDataFrame([("p", True), ("p", None), ("q", False), ("p", False)], "set string, ok boolean")
    assert {tuple(r) for r in qc.inside_tolerance(checks, ["set"]).collect()} == {("p", 1, 3), ("q", 0, 1)}
    steps = spark.createDataFrame([("filter:x",), ("raw",)], "step string")
    assert qc.filter_rows(steps).count() == 1
    places = spark.createDataFrame([("c", 1), ("c", 2), ("c", 2)], "contig string, pos long")
    assert intervals.outside_mask(places, spark.createDataFrame([("c", 1), ("c", 1)], "contig string, pos long")).count() == 2


def test_consensus_summary_counts_alike_reads_before_stacking(spark):
    """Reads that are alike are one row when they are stacked by tool and label; repeated, missing and null values count as before."""
    rows = [(str(i), i % 5 != 0, "agree" if i % 5 else "disagree", 30 if i % 2 else None, "unmapped", 60, None if i % 3 == 0 else "x") for i in range(60)]
    majority = spark.createDataFrame(rows, "qname string, has_consensus boolean, status_a string, mapq_a long, status_b string, mapq_b long, ptype string")
    out = consensus.consensus_summary(majority, ["a", "b"], ["ptype"])
    got = {(r.aligner, r.stratum_set, r.stratum): (r.n_reads, r.n_no_consensus, r.n_unmapped_total, r.n_consensus, r.n_agree, r.n_disagree, r.n_disagree_confident, r.n_unmapped) for r in out.collect()}
    assert got == {("a", "all", "all"): (60, 12, 0, 48, 48, 0, 0, 0), ("b", "all", "all"): (60, 12, 60, 48, 0, 0, 0, 48), ("a", "ptype", "x"): (32, 0, 0, 32, 32, 0, 0, 0), ("b", "ptype", "x"): (32, 0, 32, 32, 0, 0, 0, 32)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("Generate") :] and "n_consensus_correct" not in out.columns
