"""Embedding whitening by an incremental eigendecomposition.

Every partition keeps the spectrum of its own centred scatter and applies centred rank-one updates to it: the update's eigenvalues are the
roots of a secular equation, after deflation of what the update does not touch. A block of rows is first rotated to at most as many rows as
there are dimensions, with the same scatter, so that long partitions cost few updates. Spectra of partitions meet a few at a time, one
becoming successive rank-one updates of the other. A last pass over all rows projects them on the basis found (Rayleigh-Ritz), which takes the
rounding of all updates out again. All sums of components are integers, hence exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .topk import valid_vectors

#: Rows that are rotated together before they become rank-one updates, and states that one task merges.
BLOCK, FAN = 1024, 16
EPS = np.finfo(float).eps
STATE = "n long, total array<long>, first array<double>, second array<double>"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(origin, offset) of the roots of 1 + rho * sum(z_i**2 / (d_i - x)): root j is d[origin[j]] + offset[j], between d[j] and d[j + 1].

    d ascends strictly, no z is 0, rho is positive. A root is sought from the nearer pole, so that its distance from that pole keeps all its
    digits; a step interpolates the two poles around it and falls back to halving the interval that is known to hold it.
    """
    squares, last = z * z, len(d) - 1
    right = np.append(d[1:], d[-1] + rho * squares.sum())
    gap = right - d
    here = np.arange(len(d))
    middle = 1 + rho * (squares[:, None] / (d[:, None] - d - gap / 2)).sum(0)
    origin = np.where((middle >= 0) | (here == last), here, np.minimum(here + 1, last))
    delta = d[:, None] - d[origin]
    left_pole, right_pole = d - d[origin], right - d[origin]
    low = np.where(middle >= 0, left_pole, left_pole + gap / 2)
    high = np.where(middle >= 0, left_pole + gap / 2, right_pole)
    at = (low + high) / 2
    below = here[:, None] <= here
    for _ in range(100):
        parts = squares[:, None] / (delta - at)
        value = 1 + rho * parts.sum(0)
        slopes = parts / (delta - at)
        psi, phi = rho * (slopes * below).sum(0), rho * (slopes * ~below).sum(0)
        low, high = np.where(value < 0, at, low), np.where(value < 0, high, at)
        done = (np.abs(value) <= 8 * EPS * len(d) * (1 + rho * np.abs(parts).sum(0))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        one, two = left_pole - at, right_pole - at
        c = value - one * psi - two * phi
        a = (one + two) * value - one * two * (psi + phi)
        b = one * two * value
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = at + step
        at = np.where(done, at, np.where((moved > low) & (moved < high), moved, (low + high) / 2))
    return origin, at


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in rising order and eigenvectors of `vectors diag(values) vectors' + rho u u'` for rising values and rho >= 0."""
    z = vectors.T @ u
    size = float(np.sqrt(z @ z))
    if not rho * size:
        return values, vectors
    z, rho = z / size, rho * size * size
    least = 8 * EPS * max(float(np.abs(values).max()), rho)
    vectors = vectors.copy()
    # Equal values: a reflection of their eigenvectors leaves one of them with all of the update.
    alike = np.concatenate(([False], np.diff(values) <= least, [False]))
    for low, high in zip(np.flatnonzero(alike[1:] & ~alike[:-1]), np.flatnonzero(alike[:-1] & ~alike[1:]) + 1, strict=True):
        own = z[low:high].copy()
        length = float(np.sqrt(own @ own))
        if length:
            length = -length if own[-1] < 0 else length
            own[-1] += length
            vectors[:, low:high] -= np.outer(vectors[:, low:high] @ own, own * (2 / (own @ own)))
            z[low:high] = 0
            z[high - 1] = -length
    touched = rho * np.abs(z) > least
    if not touched.any():
        return values, vectors
    d, z = values[touched], z[touched]
    origin, offset = secular_roots(d, z, rho)
    away = (d[:, None] - d[origin]) - offset
    away[away == 0] = np.finfo(float).tiny
    # The update for which these roots are exact: its eigenvectors are orthogonal to working precision.
    apart = d - d[:, None]
    np.fill_diagonal(apart, 1)
    exact = np.sqrt(np.abs(np.prod(-away / apart, axis=1))) * np.sign(z)
    turn = exact[:, None] / away
    turn /= np.sqrt((turn * turn).sum(0))
    values = values.copy()
    values[touched] = d[origin] + offset
    vectors[:, touched] = vectors[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen, their sums, and the eigenvalues and eigenvectors of their centred scatter."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims))

    def add(self, n: int, total: np.ndarray, updates: Iterator[tuple[float, np.ndarray]]) -> None:
        """Take in n rows with the given sums, whose own centred scatter is the sum of rho u u'."""
        if self.n and n:
            between = (self.total * n - total * self.n) / (self.n * n) if max(self.n, n) < 1 << 20 else self.total / self.n - total / n
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * n / (self.n + n), between)
        for rho, u in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, max(0.0, rho), u)
        self.n, self.total = self.n + n, self.total + total

    def add_rows(self, x: np.ndarray) -> None:
        total = x.sum(0)
        centred = (x * len(x) - total) / len(x)
        rows = np.linalg.qr(centred, mode="r") if len(x) > x.shape[1] else centred
        self.add(len(x), total, ((1.0, row) for row in rows))

    def merge(self, other: Spectrum) -> None:
        self.add(other.n, other.total, zip(other.values, other.vectors.T, strict=True))


@dataclass
class Moments:
    """Rows seen, their means and their centred scatter, for rows projected to few dimensions."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def add(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        apart, both = mean - self.mean, self.n + n
        self.scatter = self.scatter + scatter + np.outer(apart, apart) * (self.n * n / max(1, both))
        self.mean, self.n = self.mean + apart * (n / max(1, both)), both


def _grid(column: pa.Array, dims: int, scale: float, shift: int) -> np.ndarray:
    """Rows of a list column as whole numbers floor(scale * c) + shift; entries that a shorter row lacks count as 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 1 << 40:
        raise ValueError("a component times the scale is too large for exact sums")
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out + shift


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def _row(n: int, total: np.ndarray, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.ravel()]) for x in (total, first, second))], ["n", "total", "first", "second"])


def _rows(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        total, first, second = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("total", "first", "second"))
        yield batch.column("n")[i].as_py(), total, first, second.reshape(dims, dims)


def _gathered(rows: DataFrame, read: Callable, start: Callable, dump: Callable, dims: int):
    """The state of all rows. `read(state, block)` takes a block in; the states of partitions are merged FAN a task, round by round, until
    one row of dims**2 numbers is left, which is all that reaches the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for block in _blocks(batches):
            read(state, block)
        if state.n:
            yield dump(state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for n, total, one, two in _rows(batch, dims):
                state.merge(Spectrum(n, total, one, two)) if isinstance(state, Spectrum) else state.add(n, one, two)
        if state.n:
            yield dump(state)

    states = cut(rows.mapInArrow(first, STATE))
    while (many := states.count()) > 1:
        states = cut(states.repartition(-(-many // FAN)).mapInArrow(merge, STATE))
    table = states.toArrow()
    return next(_rows(table.to_batches()[0], dims)) if table.num_rows else None


@dataclass
class Whitening:
    """What `fit` found: rows, sums, and per component the eigenvalue, its share of the trace and its direction (a column)."""

    n: int
    total: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x minus the sums: exact whole numbers."""
        if self.n * float(np.abs(x).max(initial=0)) >= 2**62:
            raise ValueError("rows times components are too large for exact sums")
        return self.n * x - self.total

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = self.centred(x) / self.n @ self.vectors / np.sqrt(self.values)
        return np.where(self.values > 0, scaled, np.nan)


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 0) -> Whitening | None:
    """The leading components of all valid vectors, taken as floor(scale * c) + shift; None without any. The dimension is that of the longest
    vector. A component without variance has the eigenvalue 0."""
    rows = valid_vectors(vectors, vector).select(F.col(vector).alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return None
    grid = lambda block: _grid(block.column("v"), dims, scale, shift)
    n, total, _, basis = _gathered(
        rows, lambda s, block: s.add_rows(grid(block)), lambda: Spectrum.empty(dims), lambda s: _row(s.n, s.total, s.values, s.vectors), dims
    )
    basis = np.linalg.qr(basis)[0]
    found = Whitening(n, total, np.ones(dims), np.ones(dims), basis, scale, shift)
    _, _, mean, scatter = _moments(rows, lambda block: found.whitened(grid(block)), dims)
    values, turn = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    trace = float(values.sum())
    order = np.argsort(-values, kind="stable")[:components]
    real = np.where(values[order] > 4 * dims * EPS * values.max(), values[order], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        explained = real / trace
    return Whitening(n, total, real, explained, basis @ turn[:, order], scale, shift)


def _moments(rows: DataFrame, project: Callable, dims: int):
    def read(state: Moments, block: pa.RecordBatch) -> None:
        y = project(block)
        mean = y.mean(0)
        state.add(len(y), mean, (y - mean).T @ (y - mean))

    empty = np.zeros(0, np.int64)
    return _gathered(rows, read, lambda: Moments(0, np.zeros(dims), np.zeros((dims, dims))), lambda s: _row(s.n, empty, s.mean, s.scatter), dims)


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    real = np.flatnonzero(model.values > 0)
    if not len(real):
        return 0.0
    rows = valid_vectors(vectors, vector).select(F.col(vector).alias("v"))
    dims = len(model.total)
    n, _, _, scatter = _moments(rows, lambda block: model.whitened(_grid(block.column("v"), dims, model.scale, model.shift))[:, real], len(real))
    return float(np.abs(scatter / n - np.eye(len(real))).max())


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0, shift: int = 0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every valid vector and each of the leading components.

    Vectors that are null or hold null or non-finite entries take no part; repeated rows and ids count each time, a null vec_id is kept, vectors
    of equal direction or value are like any other. Entries that a shorter vector lacks count as 0. A component without variance (constant
    columns, fewer rows than dimensions, one row) has explained 0, or null if nothing varies, and whitened null. No rows give no rows. Only the
    three columns named are read, so other columns can't clash. Components beyond 2**40 / scale and deviations beyond 64 bits are an error.
    Four passes over the vectors; a task holds one block of rows and a few matrices of dims x dims.
    """
    spark = vectors.sparkSession
    model = fit(vectors, vector, components, scale, shift)
    if model is None:
        return spark.createDataFrame([], OUT)
    error, dims, many = identity_error(vectors, model, vector), len(model.total), len(model.values)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _grid(block.column("v"), dims, scale, shift)
            away = model.centred(x)
            if (away.astype(np.float64) ** 2).sum(1).max(initial=0) >= 2**63 * (1 - 1e-9):
                raise ValueError("a deviation passes 64 bits")
            rows = len(x)
            white = pa.array(model.whitened(x).ravel(), from_pandas=True)
            shares = pa.array(np.tile(model.explained, rows), from_pandas=True)
            ids = block.column("vec_id").take(pa.array(np.repeat(np.arange(rows), many)))
            numbers = [np.tile(np.arange(1, many + 1, dtype=np.int32), rows), np.full(rows * many, model.n), np.repeat((away * away).sum(1), many)]
            arrays = [ids, *map(pa.array, numbers), white, shares, pa.array(np.full(rows * many, error))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid_vectors(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(give, OUT)
