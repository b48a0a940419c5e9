"""Steps that large tables have shown to be one task, or to make rows for every pair."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from placetrail.functions import sequence
from placetrail.operators import intervals, variants
from placetrail.sources import reads

from .test_operators import plain_apply


@pytest.mark.parametrize("size", [5, 64])
def test_run_lengths_are_counted_inside_tasks(spark, size, monkeypatch):
    rng = random.Random(size)
    contigs = {"a": "".join(b * rng.randint(1, 20) for b in rng.choices("ACGTN", k=90)), "b": "T" * 300, "c": "acGT", None: "AACCA"}
    rows = [(name, i // size, seq[i : i + size]) for name, seq in contigs.items() for i in range(0, len(seq), size)]
    chunks = spark.createDataFrame(rows, "contig string, chunk long, bases string").repartition(3)
    want: dict = {}
    for name, seq in contigs.items():
        for m in re.finditer(r"A+|C+|G+|T+|N+", seq.upper()):
            key = (name, m[0][0], len(m[0]))
            want[key] = want.get(key, 0) + 1
    assert {(r.contig, r.base, r.length): r.n for r in sequence.run_lengths(chunks, size).collect()} == want
    if size == 64:
        tallied = sequence._chunk_runs(chunks.repartition(1), size, tallied=True)
        assert tallied.count() < sequence._chunk_runs(chunks, size, tallied=False).count()


def test_a_record_is_many_keys(spark, monkeypatch):
    monkeypatch.setattr(reads, "STRETCH_BITS", 8)
    rng = random.Random(3)
    contigs = {"x": "".join(rng.choices("ACGT", k=3000)), "y": "".join(rng.choices("ACGT", k=70))}
    lines = [line for name, seq in contigs.items() for line in (f">{name} z", *(seq[i : i + 60] for i in range(0, len(seq), 60)))]
    chunks = reads.fasta_chunks(spark.createDataFrame(list(enumerate(lines)), "at long, value string"), "at", 512)
    got: dict = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.contig, r.chunk)):
        got[r.contig] = got.get(r.contig, "") + r.bases
    assert got == contigs
    assert "stretch" in chunks._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("long_query", [300, 1 << 20])
def test_dominant_labels_by_stalls(spark, long_query):
    rng = random.Random(11)
    contigs = ["c0", "c1"]
    marks = [(f"s{i % 2}", rng.choice(contigs), s, s + rng.randint(1, 400), f"l{i % 7}") for i in range(150) for s in [rng.randint(0, 4000)]]
    asked = [(i, rng.choice(contigs), s, s + int(2 ** rng.uniform(0, 11))) for i in range(120) for s in [rng.randint(0, 4000)]] + [(900, "c0", 5, 5), (901, "c9", 0, 50), (902, None, 0, 50)]
    annot = spark.createDataFrame(marks, "set_name string, contig string, start0 long, end0 long, label string")
    queries = spark.createDataFrame(asked, "rid int, contig string, start0 long, end0 long")
    got = {r.rid: {x.set_name: (x.label, -x.share) for x in r.best} for r in intervals.with_dominant(queries, annot, 16, long_query).collect()}
    for rid, contig, low, high in asked:
        want = {}
        for name in ("s0", "s1"):
            cover: dict = {}
            for n, c, s, e, label in marks:
                if n == name and c == contig:
                    cover.setdefault(label, set()).update(range(max(s, low), min(e, high)))
            best = min(((-len(v), k) for k, v in cover.items() if v), default=None)
            if best:
                want[name] = (best[1], pytest.approx(-best[0] / (high - low)))
        assert got[rid] == want


def test_queries_meet_one_row_whatever_lies_over_them(spark):
    """300 labels over everything: a query was joined to each of them."""
    annot = spark.range(300).select(F.lit("s").alias("set_name"), F.lit("c").alias("contig"), F.lit(0).cast("long").alias("start0"), F.lit(100_000).cast("long").alias("end0"), F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("label"))
    stalls = spark.createDataFrame([("c", 0, 3)], "contig string, _depth int, _stall long")
    row = intervals.stall_labels(stalls, intervals.merge_intervals(annot, ("set_name", "label", "contig")), 512).collect()
    assert len(row) == 1 and [(x.whole, len(x.parts)) for x in row[0]._sets] == [("l000", 0)]


def test_fastq_lines_of_one_split_are_many_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reads, "LINE_BITS", 3)
    path = tmp_path / "x.fastq.gz"
    path.write_bytes(gzip.compress("".join(f"@r{i}\n{'ACGT'[i % 4]}\n+\nI\n" for i in range(50)).encode()))
    found = reads.fastq(spark, str(path))
    assert [(r.qname, r.seq) for r in found.orderBy("file_order").collect()] == [(f"r{i}", "ACGT"[i % 4]) for i in range(50)]
    assert "stretch" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rows_a_range", [4, 50_000])
def test_a_run_of_overlapping_variants_is_many_ranges(spark, rows_a_range):
    """One run of all variants was one fold, which copied what it had found for every variant."""
    rng = random.Random(rows_a_range)
    rows = [(c, h, rng.randint(0, 150), rng.choice([0, 1, 1, 2, 3, 3, 40 if c == "b" else 5]), rng.choice(["T", "GG", ""])) for c, h, k in (("a", 0, 200), ("a", 1, 40), ("b", 0, 150), (None, 1, 60)) for _ in range(k)]
    rows += [("z", 0, 7, 1, None), ("z", 0, 7, 1, "A")]
    table = spark.createDataFrame(rows, "contig string, hap int, start0 long, ref_len int, alt string").repartition(3)
    found = variants.keep_apart(table, rows_a_range)
    want, reach = [], {}
    for c, h, s, n, alt in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3], r[4] or "")):
        kept = s >= reach.get((c, h), -1)
        reach[c, h] = s + n if kept else reach[c, h]
        want.append((c, h, s, n, alt, kept))
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(found.collect()) == order(want)
    assert "aggregate(" not in found._jdf.queryExecution().analyzed().toString()


def test_windows_of_all_lengths_meet_one_row_of_variants(spark):
    rng = random.Random(4)
    seqs = {(i, rng.randint(-50, 3000)): "".join(rng.choices("ACGT", k=int(2 ** rng.uniform(0, 11)))) for i in range(40)}
    windows = spark.createDataFrame([(i, "c", i % 2, s, seq) for (i, s), seq in seqs.items()], "window_id int, contig string, hap int, start0 long, seq string")
    changes = sorted({(i % 2, rng.randint(0, 4000)): (rng.choice([1, 2, 3]), rng.choice(["T", "GGA"])) for i in range(900)}.items())
    kept = variants.keep_apart(spark.createDataFrame([("c", h, s, n, alt) for (h, s), (n, alt) in changes], "contig string, hap int, start0 long, ref_len int, alt string"))
    apart = {(r.hap, r.start0): (r.ref_len, r.alt) for r in kept.filter("kept").collect()}
    out = variants.apply_to_windows(windows, kept)
    for r in out.collect():
        parts, at, many = [], 0, 0
        for (h, s), (n, alt) in sorted(apart.items()):
            if h == r.hap and at <= s - r.start0 and s - r.start0 + n <= len(r.seq):
                parts += [r.seq[at : s - r.start0], alt]
                at, many = s - r.start0 + n, many + 1
        assert (r.sample_seq, r.n_variants) == ("".join(parts) + r.seq[at:], many)
    assert "_stall" in out._jdf.queryExecution().analyzed().toString() and "r_end" not in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("one_mark", [False, True])
def test_windows_are_laid_out_many_at_once(spark, monkeypatch, one_mark):
    """Every window was folded over the variants of its stall by itself; a stall with many windows was one task."""
    hashed = F.xxhash64
    monkeypatch.setattr(variants.F, "xxhash64", lambda *c: F.lit(0).cast("long") if one_mark and c[0] == "contig" else hashed(*c))
    rng = random.Random(6)
    words = [("c", i % 2, rng.randint(-20, 400), "".join(rng.choices("ACGT" if i % 5 else "ACé🧬", k=rng.randint(0, 90)))) for i in range(150)]
    words += [(c, h, 40, "ACGTACGTAC") for c, h in (("d", 0), ("none", 0), (None, 0), ("c", None))] + [("c", h, 30, "GATTACA" * 90_000) for h in (0, 1)] + [("c", 0, 60, "ACGT" * 30)] * 30
    windows = spark.createDataFrame([(i, *w) for i, w in enumerate(words)] + [(900, "c", 0, 50, None), (901, "c", 0, None, "ACGT")], "window_id int, contig string, hap int, start0 long, seq string")
    apart = [("c", h, s + rng.randint(0, 3), rng.randint(1, 3), rng.choice(["T", "", "GGATC", "é"])) for h in (0, 1) for s in [*range(0, 300, 7), 560_000]]
    clashing = [("d", 0, s, n, alt) for s, n, alt in ((39, 3, "T"), (41, 4, "GG"), (44, 1, "A"), (45, 2, "CCC"), (45, 1, "T"), (49, 3, "T"))]
    kept = spark.createDataFrame([(*v, True) for v in apart + clashing] + [(None, 0, 41, 1, "T", True), ("c", 0, 41, None, "T", True), ("c", 0, 41, 1, "T", False)], "contig string, hap int, start0 long, ref_len int, alt string, kept boolean")
    out = variants.apply_to_windows(windows, kept, windows_a_task=4)
    got = {r.window_id: (r.sample_seq, r.positions, r.n_variants) for r in out.collect()}
    want = {i: plain_apply(seq, s, [(x, n, alt) for d, k, x, n, alt in apart + clashing if (d, k) == (c, h) and s <= x < s + len(seq)]) for i, (c, h, s, seq) in enumerate(words)}
    assert got == want | {900: (None, [], 0), 901: ("ACGT", None, 0)}
    assert {r.n for r in out.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1}
    plain = {r.window_id: (r.sample_seq, r.positions, r.n_variants) for r in variants.apply_to_windows(windows.filter("window_id < 100"), kept.limit(0)).collect()}
    assert plain == {i: plain_apply(seq, s, []) for i, (_, _, s, seq) in enumerate(words[:100])}


def test_an_insertion_without_reference_bases(spark):
    windows = spark.createDataFrame([(1, "c", 0, 10, "ACGT")], "window_id int, contig string, hap int, start0 long, seq string")
    kept = variants.keep_apart(spark.createDataFrame([("c", 0, 12, 0, "TT"), ("c", 0, 12, 0, "G"), ("c", 0, 12, 1, "A"), ("c", 0, 14, 0, "C")], "contig string, hap int, start0 long, ref_len int, alt string"))
    assert [tuple(r) for r in variants.apply_to_windows(windows, kept).select("sample_seq", "positions", "n_variants").collect()] == [("ACGTTAT", [10, 11, 12, 12, 12, 12, 13], 3)]


def test_records_are_not_dealt_out_by_contigs(spark):
    """All records of a contig were one task, and their genotypes were taken apart up to twelve times."""
    rows = [("1", 5, "a", "T,g", "0/2:x"), ("chr1", 9, "ACG", "T", "1"), ("1", 11, "A", "<DEL>", "99999999999|0"), ("1", 12, "A", "T", "./1"), ("1", 13, "A", "T", "0|0"), ("9", 1, "A", "T", "99999999999"), ("1", 14, "A", "T,C", "2|1|2")]
    records = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file_order int, contig string, pos1 long, ref string, alts string, genotype string")
    names = spark.createDataFrame([("1", "chr1"), ("chr1", "chr1")], "name string, canonical string")
    found = variants.genotype_rows(records, names)
    assert [(r.status, r.alleles and sorted(r.alleles)) for r in found.orderBy("file_order").collect()] == [("used", [0, 2]), ("used", [1, 1]), *[("skipped_other", None)] * 2, ("homozygous_reference", None), ("off_reference", None), ("used", [1, 2, 2])]
    haps = variants.haplotype_variants(found)
    assert sorted((r.start0, r.ref_len, r.alt) for r in haps.collect()) == [(4, 1, "G"), (8, 3, "T"), (8, 3, "T"), (13, 1, "C"), (13, 1, "C"), (13, 1, "T")]
    plan = haps._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(contig" not in plan and plan.count("^[0-9]+$") <= 2
