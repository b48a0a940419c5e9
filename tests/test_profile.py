"""The vectorised tally of alignments against a walk over every base."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placetrail.operators import profile

CODE = {b: i for i, b in enumerate("ACGT")} | {b: i for i, b in enumerate("acgt")}


def plain_cells(rows: list[dict], kind: str) -> Counter:
    """Cells (kind, mate, a, b, c) by going through every operation and base."""
    out: Counter = Counter()
    for r in rows:
        ref, seq, n = r["ref"], r["seq"], len(r["seq"])
        hidden = {p - r["start0"] for p in r["hidden"] or ()}
        read = at = 0
        pairs, ins, dels = [], [], []
        for size, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", r["cigar"])):
            if op in "M=X":
                pairs += [(read + k, at + k) for k in range(size)]
            elif op in "ID" and 0 < size <= profile.INDEL and at not in hidden:
                (ins if op == "I" else dels).append((at, size))
            read += size if op in "MIS=X" else 0
            at += size if op in "MDN=X" else 0
        pairs = [(i, CODE[ref[j]], CODE[seq[i]]) for i, j in pairs if j not in hidden and ref[j] in CODE and seq[i] in CODE]
        if kind == "short":
            if not 0 < n <= profile.CYCLES or r["qual"] == "*":
                continue
            q = [min(ord(c) - 33, profile.MOST_QUALITY - 1) for c in r["qual"]]
            for i, t, c in pairs:
                cycle = n - 1 - i if r["reverse"] else i
                out["cycle", r["mate"], cycle, int(t != c), 0] += 1
                out["quality", r["mate"], cycle * profile.QUARTERS // n, q[i], int(t != c)] += 1
            own = q[::-1] if r["reverse"] else q
            out["first", r["mate"], own[0], 0, 0] += 1
            for i in range(1, n):
                out["transition", r["mate"], i, own[i - 1], own[i]] += 1
            out["length", r["mate"], n, 0, 0] += 1
            if r["proper"] and r["mate"] == 0 and r["tlen"]:
                out["fragment", 0, abs(r["tlen"]), 0, 0] += 1
        else:
            columns = len(pairs) + sum(s for _, s in ins + dels)
            if columns < 200:
                continue
            out["error", 0, sum(t != c for _, t, c in pairs) + columns - len(pairs), columns, 0] += 1
            out["read", 0, n, 0, 0] += 1
            runs = [len(m[0]) for m in re.finditer(r"A+|C+|G+|T+|[^ACGT]+", "".join(c if c in "ACGT" else "N" for c in ref.upper())) for _ in m[0]]
            runs = [min(x, profile.RUNS) for x in runs]
            for x in runs:
                out["run", 0, x, 0, 0] += 1
            for p, _ in ins:
                out["run_insertion", 0, max(runs[min(max(p - 1, 0), len(runs) - 1)], runs[min(p, len(runs) - 1)]), 0, 0] += 1
            for p, _ in dels:
                out["run_deletion", 0, runs[min(p, len(runs) - 1)], 0, 0] += 1
            for _, t, c in pairs:
                out["cycle", 0, 0, int(t != c), 0] += 1
        for _, t, c in pairs:
            if t != c:
                out["substitution", 0, 3 - t if r["reverse"] else t, 3 - c if r["reverse"] else c, 0] += 1
        for name, own in (("insertion", ins), ("deletion", dels)):
            for _, size in own:
                out[name, 0, size, 0, 0] += 1
    return out


def alignments(n: int, size: int, seed: int) -> list[dict]:
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        parts, read, at = [], 0, 0
        if rng.random() < 0.3:
            parts.append((int(rng.integers(1, 9)), "S" if rng.random() < 0.7 else "H"))
        while at < size * rng.uniform(0.5, 1.2):
            parts.append((int(rng.integers(1, size)), str(rng.choice(list("MMM=X")))))
            at += parts[-1][0]
            if rng.random() < 0.6:
                parts.append((int(rng.integers(1, 60)), str(rng.choice(list("IIDDN")))))
                at += parts[-1][0] if parts[-1][1] in "DN" else 0
        read = sum(s for s, op in parts if op in "MIS=X")
        at = sum(s for s, op in parts if op in "MDN=X")
        letters = list("AACGTTTN") if i % 7 else list("acgtA")
        start = int(rng.integers(0, 1000))
        row = {"mate": int(rng.integers(0, 2)), "reverse": bool(rng.random() < 0.5), "contig": "c", "start0": start, "cigar": "".join(f"{s}{op}" for s, op in parts), "seq": "".join(rng.choice(letters, read)), "ref": "".join(rng.choice(letters, at))}
        row["qual"] = "*" if i % 11 == 0 else "".join(chr(33 + q) for q in rng.integers(0, 60, read))
        row["hidden"] = [] if i % 3 else sorted({int(x) for x in rng.integers(start - 5, start + at + 5, 12)})
        out.append(row | {"proper": bool(rng.random() < 0.5), "tlen": int(rng.integers(-300, 300))})
    return out


@pytest.mark.parametrize("kind,size", [("short", 60), ("long", 160)])
@pytest.mark.parametrize("block", [1 << 20, 100])
def test_tally_equals_the_walk(spark, kind, size, block, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK_BASES", block)
    rows = alignments(120, size, seed=size)
    names = ["mate", "reverse", "contig", "start0", "cigar", "seq", "ref", "qual", "proper", "tlen"]
    frame = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "mate int, reverse boolean, contig string, start0 long, cigar string, seq string, ref string, qual string, proper boolean, tlen int")
    plain = [r | {"hidden": None} for r in rows]
    got = Counter({(c.kind, c.mate, c.a, c.b, c.c): c.n for c in profile.count_cells(frame, kind).collect()})
    want = plain_cells(plain, kind)
    assert got == want and len(want) > 50
    masked = spark.createDataFrame(sorted({("c", p) for r in rows for p in r["hidden"]}), "contig string, pos long")
    every = {p for r in rows for p in r["hidden"]}
    want = plain_cells([r | {"hidden": every} for r in rows], kind)
    assert Counter({(c.kind, c.mate, c.a, c.b, c.c): c.n for c in profile.count_cells(frame, kind, masked).collect()}) == want


def test_tally_of_nothing(spark):
    none = spark.createDataFrame([], "mate int, reverse boolean, contig string, start0 long, cigar string, seq string, ref string, qual string")
    assert profile.count_cells(none, "short").count() == 0
    odd = spark.createDataFrame([(0, False, "c", 0, "*", "", "", "*"), (0, False, "c", 0, "3S", "ACG", "", "III"), (1, True, "c", 5, "2M", "AC", "AG", "I")], none.schema)
    assert profile.count_cells(odd.withColumn("x", F.lit(1)), "long").count() == 0
    assert {(r.kind, r.a, r.n) for r in profile.count_cells(odd, "short").collect()} == {("first", 40, 1), ("transition", 1, 1), ("transition", 2, 1), ("length", 3, 1)}


def test_cells_are_tallied_once(spark, monkeypatch):
    """A comparison tallied both sides anew for every figure, and a task sent cells for every block."""
    monkeypatch.setattr(profile, "BLOCK_BASES", 64)
    monkeypatch.setattr(profile, "MERGE", 2)
    own = [(0, False, "c", 10 * i, "20M", "ACGT" * 5, "I" * 20, "ACGT" * 4 + "ACGA") for i in range(40)]
    rows = spark.createDataFrame(own, "mate int, reverse boolean, contig string, start0 long, cigar string, seq string, qual string, ref string").coalesce(1)
    cells = profile.count_cells(rows, "short")
    plan = profile.compare(cells, cells, "short")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert {(r.a, r.b): r.n for r in cells.filter("kind = 'cycle'").collect()} == {(i, int(i == 19)): 40 for i in range(20)}
    want = sorted(tuple(r) for r in cells.collect())
    monkeypatch.setattr(profile, "HELD", 3)
    monkeypatch.setattr(profile, "DENSE", 0)
    assert sorted(tuple(r) for r in profile.count_cells(rows, "short").collect()) == want


def test_grouped_in_place_and_sorted_agree(monkeypatch):
    columns, n = [np.array([0, 1, 0, 0, 1]), np.array([900, 3, 900, 2, 3]), np.array([1, 0, 1, 5, 0])], np.array([2, 3, 4, 5, 6])
    dense = profile.grouped(columns), profile.grouped(columns, n)
    monkeypatch.setattr(profile, "DENSE", 0)
    for (cells, sums), (same, others) in zip(dense, (profile.grouped(columns), profile.grouped(columns, n)), strict=True):
        assert cells.tolist() == same.tolist() and sums.tolist() == others.tolist()
    assert dense[1][1].tolist() == [5, 6, 9]
