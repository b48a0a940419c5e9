"""Embedding near-duplicates by an epsilon grid order join.

Vectors are normalised, so cosine >= t means a distance of at most eps = sqrt(2 - 2t). A rotation to principal axes keeps
distances; grid cells of width eps on the leading axes, compared axis by axis, give the epsilon grid order. All vectors are numbered in
that order and cut into sequence intervals of equal length, however many lie in one cell. Intervals whose boxes come within eps of each
other are paired by an equi-join of the coarse cells that they cover, and a task joins two intervals recursively, halving them and
skipping parts whose boxes lie more than eps apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from .components import connected_components
from .lineage import cut
from .topk import _matrix, valid_vectors

#: Grid axes, rows of a sequence interval, rows that are compared without further halving, and sample rows for the axes.
AXES, INTERVAL, LEAF, SAMPLE = 8, 8192, 256, 4096
#: Axes and least width of the coarse cells by which the intervals' boxes are paired.
COARSE_AXES, COARSE = 3, 0.25


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Join:
    """Recursive join of two intervals; collects the weight of every row's links and a spanning forest of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, axes: np.ndarray, eps: float, least: float, same: bool):
        self.a, self.b, self.same, self.least, self.reach = a, b, same, least, eps + 1e-9
        self.pa, self.pb = a @ axes, b @ axes
        self.wa, self.wb = weight_a, weight_b
        self.links_a, self.links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        self.edges: list[np.ndarray] = []
        if len(a) and len(b):
            self.step(0, len(a), 0, len(b))

    def step(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:
            return  # the mirror of another part
        pa, pb = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(0, np.maximum(pa.min(0) - pb.max(0), pb.min(0) - pa.max(0)))
        if (gap * gap).sum() > self.reach**2:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self.leaf(a0, a1, b0, b1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self.step(a0, mid, b0, b1)
            self.step(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self.step(a0, a1, b0, mid)
            self.step(a0, a1, mid, b1)

    def leaf(self, a0: int, a1: int, b0: int, b1: int) -> None:
        hit = self.a[a0:a1] @ self.b[b0:b1].T >= self.least
        if self.same:
            hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)
        if not hit.any():
            return
        self.links_a[a0:a1] += hit @ self.wb[b0:b1]
        self.links_b[b0:b1] += hit.T @ self.wa[a0:a1]
        # Labels of the leaf's connected parts: the least row of side a.
        rows = np.flatnonzero(hit.any(1))
        label = np.full(a1 - a0, a1 - a0, np.int64)
        label[rows] = rows
        none = a1 - a0
        while True:
            other = np.where(hit, label[:, None], none).min(0)
            fresh = np.minimum(label, np.where(hit, other, none).min(1))
            if (fresh == label).all():
                break
            label = fresh
        split = np.flatnonzero((label < none) & (label != np.arange(none)))
        cols = np.flatnonzero(other < none)
        offset = 0 if self.same else len(self.a)
        self.edges.append(np.stack([np.concatenate((split + a0, cols + b0 + offset)), np.concatenate((label[split], other[cols])) + a0], 1))

    def forest(self) -> np.ndarray:
        """The edges without those that close a cycle."""
        if not self.edges:
            return np.zeros((0, 2), np.int64)
        root = list(range(len(self.a) + len(self.b)))
        kept = []
        for u, v in np.unique(np.concatenate(self.edges), axis=0).tolist():
            x, y = u, v
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append((u, v))
        return np.array(kept, np.int64).reshape(-1, 2)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Links are pairs with cosine >= `least` in double precision. Null, empty or zero vectors and vectors with null or
    non-finite components link with nothing. Identical vectors form one class that stands for all its rows: its members
    count each other, and links between classes are counted by class sizes, so a hot vector costs one row. Rows that share
    a vec_id are one node and share a component. Shorter vectors are padded with zeros. An empty table gives an empty result. Only the two
    columns named are read, so others cannot clash.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    good = valid_vectors(rows.filter(F.col("vec_id").isNotNull()), "v").filter(F.exists("v", lambda x: x != 0))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = classes.agg(F.max(F.size("v"))).first()[0]
    axes = np.linalg.svd(_unit(_matrix(sample, dims)), full_matrices=True)[2].T
    eps, leading = float(np.sqrt(2 - 2 * least)), min(AXES, dims)

    def place(batches):
        for batch in batches:
            at = _unit(_matrix(batch.column("v"), dims)) @ axes[:, :leading]
            steps = np.arange(0, at.size + 1, leading, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(steps, pa.array(x.ravel())) for x in (np.floor(at / eps).astype(np.int32), at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "v")), *lists], ["rep", "n", "v", "cell", "at"])

    kind = "array<float>" if single else "array<double>"
    placed = cut(classes.select("rep", "n", "v").mapInArrow(place, f"rep long, n long, v {kind}, cell array<int>, at array<double>"))
    numbered = running_sums(placed, [F.col("cell"), F.col("rep"), F.xxhash64("v")], {"place": F.lit(1)})
    members = cut(numbered.select("rep", "n", "v", "at", F.floor(F.col("place") / INTERVAL).alias("block")))
    pairs = _near_blocks(members, leading, eps)
    # Both intervals' rows go to their pair, those of the smaller number as its first side.
    sided = pairs.select(F.col("x").alias("block"), "x", "y", F.lit(True).alias("first")).unionByName(pairs.filter("x < y").select(F.col("y").alias("block"), "x", "y", F.lit(False).alias("first")))
    dealt = members.join(sided, "block").select("x", "y", "first", "rep", "n", "v")

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("first").to_numpy().astype(bool)
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        unit = _unit(_matrix(table.column("v").combine_chunks(), dims))
        same = table.column("x")[0] == table.column("y")[0]
        # Epsilon grid order: by cell, then along the axes.
        grid = np.floor(unit @ axes[:, : min(8, dims)] / eps)
        order = np.lexsort((rep, *grid.T[::-1]))
        a = order[side[order]]
        b = a if same else order[~side[order]]
        done = _Join(unit[a], unit[b], n[a], n[b], axes, eps, least, same)
        ids = rep[a] if same else np.concatenate((rep[a], rep[b]))
        links = done.links_a + done.links_b if same else np.concatenate((done.links_a, done.links_b))
        edges = done.forest()
        some = np.flatnonzero(links)
        return pa.table(
            {
                "u": pa.array(np.concatenate((ids[some], ids[edges[:, 0]])), pa.int64()),
                "v": pa.array(np.concatenate((np.full(len(some), -1), ids[edges[:, 1]])), pa.int64()),
                "n": pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64))), pa.int64()),
            }
        )

    joined = cut(dealt.groupBy("x", "y").applyInArrow(join, "u long, v long, n long"))
    links = joined.filter(F.col("n") > 0).groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    # A vec_id with different vectors stands in several classes and links them.
    named = rows.filter(F.col("vec_id").isNotNull()).select("vec_id", F.xxhash64("v").alias("mark"))
    several = named.groupBy("vec_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low <> high").select("vec_id")
    same_id = good.join(several, "vec_id", "left_semi").join(classes, "v").select(F.col("rep").alias("u"), F.col("vec_id").alias("v")).distinct()
    parts = cut(connected_components(joined.filter(F.col("n") == 0).select("u", "v").unionByName(same_id)))

    ends = classes.join(links, "rep", "left").join(parts, classes["rep"] == parts["node"], "left")
    ends = cut(ends.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("part")))
    # Rows of one vector meet in one key; the skew of that join is split, as its right side has one row a key.
    full = cut(rows.join(ends, "v", "left").select("vec_id", "n_links", "part"))
    bad = full.filter(F.col("part").isNull()).join(parts, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("part"))
    out = full.filter(F.col("part").isNotNull()).unionByName(bad).withColumnRenamed("part", "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _near_blocks(members: DataFrame, leading: int, eps: float) -> DataFrame:
    """Pairs (x, y), x <= y, of intervals whose boxes on the leading axes are at most eps apart. Boxes are met by the coarse cells
    that they cover, widened by one cell on one side."""
    axes, width = range(leading), max(eps, COARSE) * (1 + 1e-9)
    bounds = [f(F.col("at")[i]).alias(f"{side}{i}") for i in axes for side, f in (("l", F.min), ("h", F.max))]
    boxes = cut(members.groupBy("block").agg(*bounds))

    def cells(name: str, more: int) -> DataFrame:
        out = boxes.select(F.col("block").alias(name), *[F.col(f"{s}{i}").alias(f"{name}{s}{i}") for i in axes for s in "lh"])
        for i in range(min(COARSE_AXES, leading)):
            low, high = (F.floor(F.col(f"{name}{s}{i}") / width).cast("int") for s in "lh")
            out = out.withColumn(f"c{i}", F.explode(F.sequence(low - more, high + more)))
        return out

    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"xl{i}") - F.col(f"yh{i}"), F.col(f"yl{i}") - F.col(f"xh{i}")), F.lit(2.0)) for i in axes)
    met = cells("x", 1).join(cells("y", 0), [f"c{i}" for i in range(min(COARSE_AXES, leading))])
    return cut(met.filter((F.col("x") <= F.col("y")) & (gap <= F.lit((eps + 1e-9) ** 2))).select("x", "y").distinct())


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u
), c AS (SELECT u, least(u, min(w)) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""
