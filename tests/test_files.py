"""BAM in parts and by index, and sinks of one file."""

import gzip
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from placetrail.functions import sequence
from placetrail.operators import names
from placetrail.sources import annotations, bam, fastq_head, onefile, reads

CONTIGS = [("chr1", 300_000), ("chr2", 100_000), ("chrM", 16_000)]
COLUMNS = "qname string, flag int, rname string, pos1 long, mapq int, cigar string, seq string, qual string, nm int, sa string, tlen int"


def made(n: int, long: int = 0) -> list[tuple]:
    rng, out = random.Random(7), []
    for i in range(n):
        contig, length = rng.choice(CONTIGS)
        size = long if long and i % 50 == 7 else rng.randint(20, 120)
        start = rng.randint(0, length - 200)
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(rng.choices("!5:?I", k=size - 1)) + "I" if i % 9 else "*"
        placed = i % 11 != 0
        out.append((f"read:{i}", (0 if placed else 4) | (16 if i % 3 == 0 else 0) | (0x900 if i % 13 == 0 else 0), contig if placed else "*", start + 1 if placed else 0, i % 61, f"3S{size - 5}M2I" if placed else "*", seq, qual, i % 7, "x" if i % 17 == 0 else None, i))
    order = {name: i for i, (name, _) in enumerate(CONTIGS)}
    return sorted(out, key=lambda r: (order.get(r[2], 9), r[3], r[0]))


def written(spark, tmp_path, rows, block=700, name="x.bam"):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"place long, {COLUMNS}").repartition(5)
    bam.write_bam(frame, CONTIGS, f"{tmp_path}/{name}", ["place"], block_bytes=block)
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("long", [0, 9000])
def test_parts_of_any_size_are_the_whole(spark, tmp_path, long):
    rows = made(900, long)
    path = written(spark, tmp_path, rows)
    whole = [tuple(r) for r in bam.read_bam(spark, path).orderBy("file_order").collect()]
    plain = [(r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[10], r[11]) for r in whole]
    assert plain == [(q, f, c, p, m, g, s, k, nm, sa is not None, t) for q, f, c, p, m, g, s, k, nm, sa, t in rows]
    for split in (2500, 17_001, 10**9):
        parts = bam.read_bam(spark, path, split_bytes=split)
        assert split > 10**8 or parts.rdd.getNumPartitions() > 3
        assert [tuple(r) for r in parts.orderBy("file_order").collect()] == whole


def test_a_record_start_is_not_taken_inside_a_record(spark, tmp_path):
    """Names and bases that themselves look like records."""
    inner = bam.encode({"qname": "fake", "flag": 0, "rname": "chr1", "pos1": 5, "mapq": 1, "cigar": "4M", "seq": "ACGT", "qual": "IIII"}, {"chr1": 0})
    decoys = inner.hex().upper().translate(str.maketrans("0123456789ABCDEF", bam.BASES))
    rows = [(f"r{i}", 0, "chr1", i + 1, 60, f"{len(decoys)}M", decoys, "*", 0, None, 0) for i in range(200)]
    path = written(spark, tmp_path, rows, block=301)
    for split in (400, 1500):
        assert [r.qname for r in bam.read_bam(spark, path, split_bytes=split).orderBy("file_order").collect()] == [r[0] for r in rows]


def test_empty_and_foreign_files(spark, tmp_path):
    assert bam.read_bam(spark, written(spark, tmp_path, []), split_bytes=50).count() == 0
    (tmp_path / "no.bam").write_bytes(bam.compressed(b"nothing of the kind") + bam.END)
    with pytest.raises(Exception, match="not a BAM file"):
        bam.read_bam(spark, str(tmp_path / "no.bam")).count()
    two = f"{written(spark, tmp_path, made(20), name='a.bam')},{written(spark, tmp_path, made(30), name='b.bam')}"
    assert bam.read_bam(spark, two).count() == 50 and bam.read_bam(spark, two).select("file_order").distinct().count() == 50
    assert [tuple(r) for r in bam.header_contigs(spark, f"{tmp_path}/a.bam").collect()] == CONTIGS


def test_tags_and_table_of_a_foreign_record(spark, tmp_path):
    name, cigar = b"read1\0", [(5, 4), (10, 0)]
    record = struct.pack("<iiBBHHHiiii", 0, 99, len(name), 60, 0, len(cigar), 16, 15, -1, -1, 0) + name
    record += b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + bytes([0x12] * 7 + [0x10]) + bytes([30] * 15) + b"XBBs\x02\0\0\0\1\0\2\0" + b"NMC\x03" + b"SAZx\0"
    raw = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(record)) + record
    path = tmp_path / "x.bam"
    path.write_bytes(bam.compressed(raw) + bam.END)
    got = reads.alignment_table(bam.read_bam(spark, str(path))).first()
    assert (got.contig, got.start0, got.end0, got.strand, got.nm, got.clipped, got.split, got.read_len) == ("chr1", 99, 109, "-", 3, 5, True, 15)


def test_bins(spark):
    rng = random.Random(3)
    spans = [(s := rng.randrange(0, 1 << rng.randint(5, 29)), s + rng.randint(1, 1 << rng.randint(1, 25))) for _ in range(300)] + [(0, 1), (16383, 16385), ((1 << 29) - 2, (1 << 29) - 1)]
    frame = spark.createDataFrame(spans, "s long, e long").select("s", "e", bam.smallest_bin(F.col("s"), F.col("e")).alias("bin"), bam.touched_bins(F.col("s"), F.col("e")).alias("bins"))
    for r in frame.collect():
        assert r.bin == bam.bin_of(r.s, r.e) and r.bin in r.bins
        assert all(bam.bin_of(p, p + 1) in r.bins for p in (r.s, (r.s + r.e) // 2, r.e - 1))


def test_parts_of_a_file_are_bounded(spark, tmp_path, monkeypatch):
    """A file of many small parts was as many tasks."""
    path = written(spark, tmp_path, made(2000), block=900)
    monkeypatch.setattr(bam, "PARTS", 5)
    few = bam.BamReader(path, 1500, None).partitions()
    assert 1 < len(few) <= 5
    assert [(p.value[2], p.value[3]) for p in few][1:] == [(a.value[3], b.value[3]) for a, b in zip(few, few[1:], strict=False)]
    read = lambda parts: [r for p in parts for b in bam.BamReader(path, 1500, None).read(p) for r in b.to_pylist()]
    whole = read(bam.BamReader(path, 1 << 30, None).partitions())
    assert len(whole) == 2000 and read(few) == whole
    monkeypatch.setattr(bam, "PARTS", 1 << 20)
    many = bam.BamReader(path, 1500, None).partitions()
    assert len(many) > 5 and read(many) == whole
    monkeypatch.setattr(bam, "PARTS", 64)
    assert bam.part_bytes(1 << 40, 20_000) == 64 << 20 and bam.part_bytes(1000, 20_000) == 20_000 and bam.part_bytes(1 << 40, 1 << 30) == 1 << 30


def test_a_slice_reads_its_chunks_alone(spark, tmp_path):
    rows = made(3000)
    path = written(spark, tmp_path, rows, block=900)
    found = bam.read_bam(spark, path, split_bytes=20_000)
    bins, windows = (t.cache() for t in bam.build_index(found))
    wanted = [("1", 20_000, 21_500), ("chr2", 60_000, 60_001), ("MT", 0, 700), ("chr2", 5, 5)]
    aliases = spark.createDataFrame([("MT", "chrM")], "alias string, canonical string")
    table = names.name_table(bam.header_contigs(spark, path), aliases)
    own = bam.translated(spark.createDataFrame(wanted, "contig string, start0 long, end0 long"), table)
    spans = [("chr1", 20_000, 21_500), ("chr2", 60_000, 60_001), ("chrM", 0, 700)]
    want = {r[0] for r in rows if not r[1] & 0x900 and any(c == r[2] and s < r[3] - 1 + len(r[6]) - 5 and r[3] - 1 < e for c, s, e in spans)}
    assert want and {r.qname for r in bam.slice_bam(spark, path, own, bins, windows).collect()} == want
    # With every other block spoilt the slice still reads well.
    chunks = bam.joined_ranges([(r.beg, r.end) for r in bam.chunks_for(own, bins, windows).collect()])
    blocks, at, kept, spoilt, raw = bam.Blocks(path), 0, 0, 0, bytearray(open(path, "rb").read())
    first = bam.read_header(path).first >> 16
    while (got := blocks.at(at)) is not None:
        if at > first and not any(low >> 16 <= at <= high >> 16 for low, high in chunks):
            raw[at + 18 : got[1] - 8] = b"\xff" * (got[1] - at - 26)
            spoilt += 1
        else:
            kept += 1
        at = got[1]
    assert spoilt > kept
    open(path, "wb").write(raw)
    assert {r.qname for r in bam.slice_bam(spark, path, own, bins, windows).collect()} == want
    with pytest.raises(Exception):  # noqa: B017  the whole file is spoilt
        bam.read_bam(spark, path).count()
    with pytest.raises(Exception, match="contig not in the header"):
        bam.translated(spark.createDataFrame([("chr9", 0, 5)], "contig string, start0 long, end0 long"), table).collect()


def test_as_sequenced(spark):
    rows = [("a", 0x41, "AAC", "!5I"), ("a", 0x91, "AAC", "!5I"), ("b", 0x41, "G", "I"), ("c", 0x941, "T", "I"), ("c", 0x81, "T", "I")]
    frame = spark.createDataFrame(rows, "qname string, flag int, seq string, qual string")
    assert {tuple(r) for r in bam.as_sequenced(frame, True).collect()} == {("a", 1, "AAC", "!5I"), ("a", 2, "GTT", "I5!")}
    assert bam.as_sequenced(frame, False).count() == 4


def test_one_file_in_order(spark, tmp_path):
    path = f"{tmp_path}/out/x.gz"
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("value")).repartition(7)
    onefile.write_lines(rows, ["k"], path, header="# head\n# more\n")
    lines = gzip.open(path, "rt").read().split("\n")
    assert lines[:2] == ["# head", "# more"] and lines[2:-1] == [r.value for r in rows.orderBy("k").collect()] and lines[-1] == ""
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["x.gz"]
    onefile.write_lines(rows.limit(0), ["k"], path)
    assert gzip.open(path).read() == b""
    with pytest.raises(Exception):  # noqa: B017
        onefile.write_lines(rows.withColumn("value", F.when(F.col("value") == "77", F.raise_error(F.lit("broken"))).otherwise(F.col("value"))), ["k"], f"{tmp_path}/bad/y.gz")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    with pytest.raises(Exception, match="exists"):
        rows.select("value").write.format("gzip_lines").mode("append").save(path)


def test_vcf_and_bed_files(spark, tmp_path):
    text = [(0, "##contig=<ID=1>"), (1, "##x"), (2, "#CHROM"), (3, "1\t10\ta"), (4, "9\t1\tb"), (5, "1\t20\tc")]
    table = names.name_table(spark.createDataFrame([("chr1",)], "name string"))
    lengths = spark.createDataFrame([("chr1", 100)], "contig string, length long")
    prepared = annotations.prepare_vcf(spark.createDataFrame(text, "at long, value string"), "at", table, lengths)
    annotations.write_vcf(prepared, "at", f"{tmp_path}/x.vcf.gz", f"{tmp_path}/x.json")
    assert gzip.open(f"{tmp_path}/x.vcf.gz", "rt").read() == "##x\n#CHROM\nchr1\t10\ta\nchr1\t20\tc\n"
    assert json.load(open(f"{tmp_path}/x.json")) == {"variants_kept": 2, "variants_on_other_contigs": 1}
    beyond = annotations.prepare_vcf(spark.createDataFrame([(0, "1\t101\ta")], "at long, value string"), "at", table, lengths)
    with pytest.raises(Exception):  # noqa: B017
        annotations.write_vcf(beyond, "at", f"{tmp_path}/y.vcf.gz", f"{tmp_path}/y.json")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.json", "x.vcf.gz"]
    bed = spark.createDataFrame([("b", 5, 9, "y"), ("a", 7, 8, "x"), ("b", 1, 2, "z")], "contig string, start0 long, end0 long, label string")
    annotations.write_bed_file(bed, f"{tmp_path}/z.bed.gz")
    assert gzip.open(f"{tmp_path}/z.bed.gz", "rt").read() == "a\t7\t8\tx\nb\t1\t2\tz\nb\t5\t9\ty\n"


def test_pairs_of_two_files(spark, tmp_path):
    def file(name, reads_):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("".join(f"@{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads_))
        return str(tmp_path / name)

    one = [(f"r{i}/1", "ACG"[: i % 3 + 1]) for i in range(50)]
    two = [(f"r{i}/2", "TTT"[: i % 2 + 1]) for i in range(50)]
    got = reads.mates(reads.paired_fastq(spark, file("a.gz", one), file("b.gz", two))).collect()
    assert {(r.qname, r.mate, r.seq) for r in got} == {(n[:-2], m, s) for m, own in ((1, one), (2, two)) for n, s in own}
    with pytest.raises(Exception, match="without a mate"):
        reads.paired_fastq(spark, file("a.gz", one), file("c.gz", two[:-1])).collect()
    with pytest.raises(Exception, match="different names"):
        reads.paired_fastq(spark, file("a.gz", one), file("d.gz", [two[1], two[0], *two[2:]])).collect()


@pytest.mark.parametrize("packed", [True, False])
def test_first_reads_end_the_reading_early(spark, tmp_path, packed):
    rng = random.Random(9)
    text = "".join(f"@r{i} x\n{''.join(rng.choices('ACGT', k=100))}\n+\n{'I' * 100}\n" for i in range(20_000)).encode()
    raw = b"".join(gzip.compress(text[i : i + 300_000]) for i in range(0, len(text), 300_000)) if packed else text
    path = tmp_path / "x.fastq"
    path.write_bytes(raw[: len(raw) // 3] + b"\0 spoilt " * 20_000)  # nothing after the first third can be read
    got = fastq_head.first_of_files(spark, [str(path)], 500, 40).orderBy("place").collect()
    lines = text.decode().split("\n")
    assert [(r.place, r.qname, r.seq) for r in got] == [(i, f"r{i}", lines[4 * i + 1]) for i in range(40, 540)]
    short = b"@a\nAC\n+\nII\n\n\n"
    path.write_bytes(gzip.compress(short) if packed else short)
    assert [tuple(r) for r in fastq_head.first_of_files(spark, [str(path)], 500).collect()] == [(str(path), 0, "a", "AC", "II")]
    assert fastq_head.first_of_files(spark, [str(path)], 0).count() == 0 and fastq_head.first_of_files(spark, [str(path)], 5, 99).count() == 0


@pytest.mark.parametrize("size", [4, 7, 64])
def test_runs_over_chunks(spark, size):
    rng = random.Random(size)
    contigs = {"a": "".join(b * rng.randint(1, 20) for b in rng.choices("ACGTN", k=60)), "b": "T" * 300, "c": "acGT"}
    rows = [(name, i // size, seq[i : i + size]) for name, seq in contigs.items() for i in range(0, len(seq), size)]
    got = {(r.contig, r.base, r.start0, r.end0) for r in sequence.contig_runs(spark.createDataFrame(rows, "contig string, chunk long, bases string").repartition(3), size).collect()}
    want = {(name, m[0][0], m.start(), m.end()) for name, seq in contigs.items() for m in re.finditer(r"A+|C+|G+|T+|N+", seq.upper())}
    assert got == want and ("b", "T", 0, 300) in got
