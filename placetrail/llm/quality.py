"""Quality: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A text is described by shares of its bytes and a few counts. Each training pair prefers a good text to a bad one;
logistic loss on the difference of their features gives a linear score. All training rows take part: tasks pair the rows of their blocks
and add up the sums of a Newton step. The share of bad texts in the training rows
names a quantile of all their scores, and the score is mapped so that this cut lies at `CUT`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard
from .sampling import fold
from .textops import per_text, prefix_hash, sigmoid, small_batches, span_hash, text_blocks, word_spans

#: A score from here on predicts good quality.
CUT = 0.7
#: Rows of the other label that a row is paired with, passes over the training rows at most, the decrease that is small enough to stop, the weight of the squared weights.
ROUNDS, STEPS, ENOUGH, SHRINK = 2, 24, 1e-7, 1e-4
#: The cut lies within so much of the quantile; cells in which scores are counted at a time.
NEAR, CELLS = 0.01, 1 << 16

#: Byte classes whose shares are features.
_CLASSES = np.zeros(256, np.int64)
for _k, _range in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(128, 256)), 1):
    _CLASSES[list(_range)] = _k
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
for _k, _b in enumerate(_MARKS, 6):
    _CLASSES[_b] = _k
N_CLASSES = 6 + len(_MARKS)
N_FEATURES = 2 * N_CLASSES + 7


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES): for every byte class its share and the root of the share; then word and line statistics."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * N_CLASSES + _CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    share = counts / np.maximum(sizes, 1)[:, None]
    starts, ends, first = word_spans(data, offsets)
    prefix = prefix_hash(data)
    words = np.diff(first)
    lengths = (ends - starts).astype(np.float64)
    mean = per_text(lengths, first) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(per_text(lengths**2, first) / np.maximum(words, 1) - mean**2, 0))

    def distinct(s: np.ndarray, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Share of distinct strings among those of each text."""
        hashes, own = span_hash(prefix, s, e), np.repeat(np.arange(n), np.diff(f))
        order = np.lexsort((hashes, own))
        h, o = hashes[order], own[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[fresh], minlength=n) / np.maximum(np.diff(f), 1)

    lines = word_spans(data, offsets, data != 10)
    capital = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    more = [np.log1p(words), mean, spread, distinct(starts, ends, first), distinct(*lines), np.log1p(words / np.maximum(np.diff(lines[2]), 1)), per_text(capital.astype(float), first) / np.maximum(words, 1)]
    return np.concatenate([share, np.sqrt(share), np.stack(more, 1)], axis=1)


@dataclass
class Ranking:
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * (x @ self.weights - self.cut) + np.log(CUT / (1 - CUT)))


def _features_of(texts: list[str]) -> np.ndarray:
    parts = [features(d, o) for _, d, o in text_blocks(pa.array(texts, pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def _pair_sums(x: np.ndarray, good: np.ndarray, w: np.ndarray, counts: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives of the preferences of a block of rows. Every row meets ROUNDS rows of the other label or more; in a
    block of one label, the mean row of the other. Both labels weigh the same in all."""
    better, worse = x[good == 1], x[good == 0]
    weight = (len(better) / counts[1] + len(worse) / counts[0]) / 2
    if len(better) and len(worse):
        at = np.arange(max(len(better), len(worse)))
        d = np.concatenate([better[at % len(better)] - worse[(at + k) % len(worse)] for k in range(ROUNDS)])
    else:
        d = better - means[0] if len(better) else means[1] - worse
    weight /= max(1, len(d))
    z = d @ w
    p = sigmoid(-z)
    return np.concatenate([[weight * np.logaddexp(0, -z).sum()], -weight * (p @ d), weight * ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def _moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For both labels: rows, sums and sums of squares."""
    own = [x[good == k] for k in (0, 1)]
    return np.concatenate([np.concatenate([[len(o)], o.sum(0), (o * o).sum(0)]) for o in own])


def fit_weights(total: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rows of label 0 and 1) by Newton's method; `total` adds up a function of (features, labels) over all blocks of all training rows.
    Weights are 0 where a label has no row."""
    found = total(_moments).reshape(2, -1)
    counts, sums, squares = found[:, 0], found[:, 1 : 1 + N_FEATURES], found[:, 1 + N_FEATURES :]
    if not counts.all():
        return np.zeros(N_FEATURES), counts
    mean = sums.sum(0) / counts.sum()
    spread = np.sqrt(np.maximum(squares.sum(0) / counts.sum() - mean**2, 0)) + 1e-3
    means = sums / counts[:, None] / spread
    w, best, least, step = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf, np.zeros(N_FEATURES)
    for _ in range(STEPS):
        loss, rest = (out := total(lambda x, good: _pair_sums(x / spread, good, w, counts, means)))[0], out[1:]  # noqa: B023
        loss += SHRINK / 2 * (w @ w)
        if loss < least:
            best, least = w, loss
            slope = rest[:N_FEATURES] + SHRINK * w
            step = -np.linalg.solve(rest[N_FEATURES:].reshape(N_FEATURES, N_FEATURES) + SHRINK * np.eye(N_FEATURES), slope)
            if slope @ step > -ENOUGH:
                break
        else:
            step = step / 4
        w = best + step
    return best / spread, counts


def widest_gap(low: np.ndarray, high: np.ndarray, weight: np.ndarray, bad_share: float, before: float = 0.0) -> tuple[float, float, float]:
    """(cut, gap, share below it) of ordered cells of scores from `low` to `high`: the middle of the widest gap between cells within one hundredth of the quantile
    `bad_share`; `before` is the weight below the first cell."""
    if len(low) < 2:
        return float(low[0] + high[0]) / 2, 0.0, before
    cum = before + np.cumsum(weight)
    at = int(np.clip(np.searchsorted(cum, bad_share), 0, len(low) - 2))
    first, last = np.searchsorted(cum, [bad_share - NEAR, bad_share + NEAR])
    near = np.arange(max(0, min(first, at)), min(len(low) - 1, max(last, at + 1)))
    best = near[(low[near + 1] - high[near]).argmax()]
    return float((high[best] + low[best + 1]) / 2), float(low[best + 1] - high[best]), float(cum[best])


def fit_ranking(x: np.ndarray, good: np.ndarray, bad_share: float) -> Ranking:
    """Fit on rows in memory, as one block; `bad_share` is the quantile of the cut. One label or no row gives a constant score: good where nothing is known to be bad."""
    w, counts = fit_weights(lambda of: of(x, good))
    if not counts.all():
        return constant(counts)
    # The rows may hold the labels in other shares than the table; weights restore the table's shares.
    weight = np.where(good == 1, (1 - bad_share) / counts[1], bad_share / counts[0])
    values = x @ w
    order = np.argsort(values, kind="stable")
    return Ranking(w, widest_gap(values[order], values[order], weight[order], bad_share)[0], 1.0)


def constant(counts: np.ndarray) -> Ranking:
    return Ranking(np.zeros(N_FEATURES), 5.0 if counts[0] and not counts[1] else 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, mod: int, held: int) -> DataFrame:
    """(label, x) of every row of docs whose doc_id has a label outside the fold crc32(doc_id) mod `mod` = `held`: the features of its whole text. Of several
    labels of one doc_id the smallest counts. Features, not texts, are joined."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & (fold("doc_id", mod) != held)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))

    @F.arrow_udf("array<float>")
    def described(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), N_FEATURES), np.float32)
        for rows, data, offsets in text_blocks(texts):
            out[rows] = features(data, offsets)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_FEATURES), pa.array(out.ravel()))

    texts = docs.filter(fold("doc_id", mod) != held).select("doc_id", described(F.col("text")).alias("x"))
    return texts.join(known, "doc_id").select("label", "x")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def _total(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of` over all blocks of training rows; tasks send one sum each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in batches:
            found = found + of(_matrix(batch), batch.column("label").to_numpy())
        if not np.isscalar(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["place", "value"])

    sums = rows.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(len(sums) or 2 * (1 + 2 * N_FEATURES))
    out[sums["place"].to_numpy(np.int64)] = sums["value"].to_numpy(np.float64)
    return out


def _cut_of(scored: DataFrame, bad_share: float) -> float:
    """The cut of scored(value): scores are counted in CELLS cells of equal width, of which the driver gets one row each. Where the widest gap is narrower than a
    cell, a cell may hide a wider one, and where a cell holds too many scores, none may lie near the quantile: then the range around it is counted again in finer cells."""
    bounds = scored.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    many, low, high, before = bounds[0], bounds[1], bounds[2], 0.0
    while True:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("value") - low) / width), F.lit(CELLS - 1)) if width > 0 else F.lit(0).cast("long")
        inside = scored.filter(F.col("value").between(low, high)).groupBy(cell.alias("cell"))
        cells = inside.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).toPandas().sort_values("cell")
        lows, highs, weight = cells["low"].to_numpy(), cells["high"].to_numpy(), cells["n"].to_numpy() / many
        at, gap, below = widest_gap(lows, highs, weight, bad_share, before)
        cum = before + np.cumsum(weight)
        first, last = (int(min(np.searchsorted(cum, bad_share + d), len(cum) - 1)) for d in (-NEAR, NEAR))
        narrow = (lows[first], highs[last])
        if (gap >= width and abs(below - bad_share) <= NEAR) or narrow[1] - narrow[0] > (high - low) / 2:
            return at
        before += weight[:first].sum()
        low, high = map(float, narrow)


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> Ranking:
    """Fit on all rows of docs that have a label (doc_id, quality) outside the fold crc32(doc_id) mod `mod` = `held`. Their features are written once; weights, the
    share of bad texts and the cut are sums and counts over all of them."""
    rows = cut(training_rows(docs, labels, mod, held))
    w, counts = fit_weights(lambda of: _total(rows, of))
    if not counts.all():
        discard(rows)
        return constant(counts)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(batch) @ w)], ["value"])

    scored = cut(rows.mapInArrow(valued, "value double"))
    model = Ranking(w, _cut_of(scored, float(counts[0] / counts.sum())), 1.0)
    discard(rows, scored)
    return model


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from CUT). Null and empty texts get the score of a text without
    bytes; texts are whole, a long one in a block of its own; repeated rows are scored each, no rows give none; existing columns of these two names
    are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for rows, data, offsets in text_blocks(texts):
            out[rows] = shared.value.score(features(data, offsets))
        return pa.array(out)

    return docs.drop("score", "predicted").withColumn("score", quality(F.col("text"))).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
