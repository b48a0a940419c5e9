"""Operators whose rows must not grow with an interval's length, and whose groups must not be one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placetrail.functions import ordered
from placetrail.operators import intervals, statistics


def spans(rng, n, most):
    size = np.exp(rng.uniform(0, np.log(most), n)).astype(int) + 1
    start = rng.integers(0, 2 * most, n)
    return [(i, f"c{i % 2}", int(s), int(s + w)) for i, (s, w) in enumerate(zip(start, size, strict=True))]


def exploded(plan: str) -> int:
    return plan.count("Generate explode")


def test_join_of_intervals_of_all_lengths(spark):
    rng = np.random.default_rng(5)
    a, b = spans(rng, 150, 2 * 10**8), [*spans(rng, 120, 2 * 10**8), (900, "c0", 0, 4 * 10**8)]
    left = spark.createDataFrame(a, "rid long, contig string, start0 long, end0 long").withColumn("own", F.lit(1))
    right = spark.createDataFrame(b, "id long, contig string, r_start long, r_end long").withColumn("bin", F.lit(2))
    joined = intervals.overlap_join(left, right)
    assert sorted((r.rid, r.id) for r in joined.collect()) == sorted((i, j) for i, c, s, e in a for j, d, u, v in b if c == d and s < v and u < e)
    assert set(joined.columns) == {"rid", "contig", "start0", "end0", "own", "id", "r_start", "r_end", "bin"}
    level = intervals._level(F.col("start0"), F.col("end0"), 4096)
    most = left.select(F.size(intervals._bins(F.col("start0"), F.col("end0"), level, 4096)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2


@pytest.mark.parametrize("long_query", [1, 5000, 1 << 40])
@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_swept_coverage_equals_the_joined(spark, long_query, range_rows, monkeypatch):
    monkeypatch.setattr(intervals.swept_coverage, "__defaults__", (range_rows,))
    rng = np.random.default_rng(6)
    asked = [*spans(rng, 60, 10**6), (500, "c0", 5, 5), (501, "c9", 0, 100)]
    marks = [(f"s{i % 2}", f"l{i % 3}", c, s, e) for i, c, s, e in spans(rng, 80, 10**5)]
    queries = spark.createDataFrame(asked, "rid long, contig string, start0 long, end0 long")
    annotations = spark.createDataFrame(marks, "set_name string, label string, contig string, start0 long, end0 long")
    got = {(r.rid, r.set_name, r.label): r.covered for r in intervals.coverage(queries, annotations, "rid", long_query=long_query).collect()}
    want = {}
    for name in {(m[0], m[1]) for m in marks}:
        for i, c, s, e in asked:
            inside = np.zeros(max(0, e - s), bool)
            for m in marks:
                if (m[0], m[1]) == name and m[2] == c:
                    inside[max(0, m[3] - s) : max(0, m[4] - s)] = True
            if inside.any():
                want[i, *name] = int(inside.sum())
    assert got == want


@pytest.mark.parametrize("range_rows", [5, 50_000])
def test_points_counted_from_sums(spark, range_rows):
    rng = np.random.default_rng(7)
    asked = [*spans(rng, 60, 1000), (77, "c0", 3, 3), (78, "c5", 0, 9)]
    points = [(f"c{int(c)}", int(p)) for c, p in zip(rng.integers(0, 2, 300), rng.integers(0, 2000, 300), strict=True)] + [("c0", 10)] * 50
    queries = spark.createDataFrame(asked, "rid long, contig string, start0 long, end0 long")
    got = {r.rid: r.n_points for r in intervals.count_points(queries, spark.createDataFrame(points, "contig string, pos long"), "rid", range_rows).collect()}
    assert got == {i: sum(c == d and s <= p < e for d, p in points) for i, c, s, e in asked}
    plan = intervals.count_points(queries, spark.createDataFrame(points, "contig string, pos long"), "rid")._jdf.queryExecution().toString()
    assert "sequence(" not in plan  # nothing is laid out over bins or bases


@pytest.mark.parametrize("range_rows", [4, 50_000])
def test_order_statistics_of_groups(spark, range_rows, monkeypatch):
    monkeypatch.setattr(ordered.running_sums, "__defaults__", (range_rows,))
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"g": rng.choice(["x", "y", "z", None], 400, p=[0.7, 0.2, 0.05, 0.05]), "v": rng.integers(1, 60, 400), "w": rng.normal(size=400).round(1), "side": rng.random(400) < 0.4})
    table = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "g string, v long, w double, side boolean")
    known = frame[frame.g.notna()]
    held = lambda df, c: {r.g: r[c] for r in df.collect() if r.g is not None}
    assert held(statistics.medians(table, ["g"], "v", "m"), "m") == known.groupby("g").v.median().to_dict()
    assert held(statistics.medians(table, ["g"], "w", "m"), "m") == pytest.approx(known.groupby("g").w.median().to_dict())
    want = {}
    for g, own in known.groupby("g"):
        lengths = np.sort(own.v.to_numpy())[::-1]
        want[g] = int(lengths[np.searchsorted(np.cumsum(lengths), lengths.sum() / 2)])
    assert held(statistics.n50(table, ["g"], "v"), "n50") == want
    gaps = {}
    for g, own in known.groupby("g"):
        a, b = own.v[own.side].to_numpy(), own.v[~own.side].to_numpy()
        gaps[g] = max(abs((a <= t).mean() - (b <= t).mean()) for t in own.v)
    assert held(statistics.ks_distance(table, ["g"], "v", "side"), "ks") == pytest.approx(gaps)
    ranked = statistics.average_ranks(table.filter("g is not null").withColumn("id", F.monotonically_increasing_id()), ["g"], "v", "rank").toPandas()
    assert np.allclose(ranked["rank"], ranked.groupby("g").v.rank())
    described = {r.g: r for r in statistics.describe(table.filter("g is not null"), ["g"], "v", "w").collect()}
    assert all(d.reads == (known.g == g).sum() and d.n50 == want[g] and d.median_length == known.v[known.g == g].median() for g, d in described.items())
    whole = statistics.describe(table, [], "v", "w").first()
    assert (whole.reads, whole.median_length) == (400, frame.v.median())
    if range_rows == 4:
        plan = statistics.medians(table, ["g"], "v", "m")._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan or "_range" in plan


def test_sums_of_groups_with_nulls(spark):
    rows = [(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", 1, 8), ("b", 3, 9), ("a", 9, 1)] * 3
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, o int, v long, i int")
    for range_rows in (2, 100):
        got = ordered.running_sums(table, [F.col("o"), F.col("i")], {"s": F.col("v")}, range_rows, by=("g",)).collect()
        for r in got:
            assert r.s == sum(x.v for x in got if x.g == r.g and (x.o, x.i) < (r.o, r.i))
