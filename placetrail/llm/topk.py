"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; the distances of a pivot are cut into annuli. By the triangle
inequality d(q, x) >= |d(q, p) - d(x, p)|, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, so every annulus has a bound that no score in it
passes. A query sorts the annuli by that bound and expands them in growing rounds; it leaves as soon as the next bound stays below
its k-th best score. All arithmetic on components is on integers, hence exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Least pivots and annuli of a pivot (their product grows with the square root of the rows), most pivots, sample rows that place them,
#: and rows of one block of vectors or queries.
PIVOTS, RINGS, MOST_PIVOTS, SAMPLE, BLOCK = 16, 8, 512, 2048, 1024
#: Annuli that a query expands in each round; the last round takes all that its bounds leave.
ROUNDS = (1, 8, 64, None)


def valid_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to `dims`."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), flat.dtype)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through doubles where no sum can pass 2**53, else on 64-bit integers; an error where a sum could pass those."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top >= 2**62:
        raise ValueError("components are too large for inner products of 64 bits")
    return a @ b.T


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over `vectors`, ties to the smaller vec_id.

    Both tables hold (vec_id long, v array<long>). Every row of `vectors` is a candidate of its own, also where a vec_id repeats, but
    never for a query with its vec_id; a vec_id that asks more than once asks with its smallest vector. Rows without a vec_id take no
    part. Vectors of unequal lengths are padded with zeros; no rows give none; other columns
    are not read; components whose products could pass 64 bits are an error. Only pivots and the bounds of the annuli, in number about the square root of the
    rows, reach the driver.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "v")
    queries = queries.filter(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = [t.agg(F.max(F.size("v")), F.count(F.lit(1))).first() for t in (vectors, queries)]
    width, rows = max(1, found[0][0] or 0, found[1][0] or 0), found[0][1]
    if not rows or not found[1][1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    points = _matrix(sample, width).astype(np.float64)
    many = int(min(MOST_PIVOTS, max(PIVOTS, np.sqrt(rows) / RINGS)))
    pivots = points[:1]
    while len(pivots) < min(many, len(points)):  # farthest first
        pivots = np.concatenate((pivots, points[[_distances(points, pivots).min(1).argmax()]]))
    rings = int(max(RINGS, np.sqrt(rows) / len(pivots)))
    edges = np.quantile(_distances(points, pivots).min(1), np.arange(1, rings) / rings)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            far = _distances(x, pivots)
            home = far.argmin(1)
            near = far[np.arange(len(x)), home]
            cell = home * rings + np.searchsorted(edges, near, "right")
            size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(near), pa.array(size)], ["vec_id", "v", "cell", "far", "size"])

    index = cut(vectors.mapInArrow(place, "vec_id long, v array<long>, cell int, far double, size double"))
    cells = cut(index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("size").alias("size")))
    bounds = cells.orderBy("cell").toArrow()
    number, low, high, size = (bounds.column(c).to_numpy() for c in ("cell", "low", "high", "size"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / BLOCK)).alias("part")
    packed = cut(index.join(cells.select("cell", "n"), "cell").groupBy("cell", part).agg(F.collect_list("vec_id").alias("vec_ids"), F.collect_list("v").alias("vs")))
    asked = cut(queries)
    parts = max(1, -(-found[1][1] // BLOCK))

    def expand(batches: Iterator[pa.RecordBatch], skip: int, take: int | None) -> Iterator[pa.RecordBatch]:
        """A round of every query: its annuli in order of their bounds, from number `skip` on, `take` of them, while their bounds reach
        the score to beat."""
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                own = batch.slice(start, BLOCK)
                x = _matrix(own.column("v"), width)
                far, norm = _distances(x, pivots)[:, number // rings], np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
                gap = np.maximum(0, np.maximum(far - high, low - far) - 1e-6 * (1 + far))
                bound = np.minimum((norm**2 + size**2 - gap**2) / 2, norm * size) * (1 + 1e-9) + 1
                order = np.argsort(-bound, axis=1, kind="stable")[:, skip : None if take is None else skip + take]
                q, at = np.nonzero(np.take_along_axis(bound, order, 1) >= own.column("beat").to_numpy()[:, None])
                rows = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(number[order[q, at]].astype(np.int32)), *(own.column(c).take(rows) for c in ("vec_id", "v", "beat"))], ["cell", "vec_id", "v", "beat"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of a block of vectors for every query of a block."""
        for batch in batches:
            out = [[], [], []]
            for r in range(len(batch)):
                row = {n: batch.column(n)[r].values for n in ("q_ids", "qs", "beats", "vec_ids", "vs")}
                ids, q_ids, beats = (row[n].to_numpy() for n in ("vec_ids", "q_ids", "beats"))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                score = _products(_matrix(row["qs"], width), _matrix(row["vs"], width)[order])
                for i in range(len(q_ids)):
                    good = np.flatnonzero((score[i] >= beats[i]) & (ids != q_ids[i]))
                    if len(good) > k:
                        good = good[np.argsort(-score[i, good], kind="stable")[:k]]
                    out[0].append(np.full(len(good), q_ids[i]))
                    out[1].append(ids[good])
                    out[2].append(score[i, good])
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    lowest, skip = F.lit(-(1 << 63)), 0
    top = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    for take in ROUNDS:
        beat = top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("beat"))
        open_ = asked.join(beat, "vec_id", "left").select("vec_id", "v", F.coalesce("beat", lowest).alias("beat"))
        moved = open_.mapInArrow(lambda b, s=skip, t=take: expand(b, s, t), "cell int, vec_id long, v array<long>, beat long")
        lists = [F.collect_list(c).alias(n) for c, n in (("vec_id", "q_ids"), ("v", "qs"), ("beat", "beats"))]
        grouped = moved.groupBy("cell", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("qpart")).agg(*lists)
        # A row holds two blocks; an Arrow batch has a bound on its bytes.
        met = grouped.join(packed, "cell").select("q_ids", "qs", "beats", "vec_ids", "vs").mapInArrow(scan, "query_id long, vec_id long, score long")
        both = top.select("query_id", "vec_id", "score").unionByName(met)
        top = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        if take is not None:
            top, skip = cut(top), skip + take
    return top.select("query_id", "rank", "vec_id", "score")


def to_grid(vectors: DataFrame, scale: float = 1024.0, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of the valid vectors."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)))
    return valid_vectors(vectors, vector).select("vec_id", v.alias("v"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
