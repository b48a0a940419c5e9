"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding joins a row of a table hashed by the whole word and a row of one hashed by its first bytes, which word forms share;
filters one, two and three words wide slide over the text, each filter keeps its maximum, and a logistic layer reads the maxima.
Everything starts at random and is learned by gradient descent on the logistic loss. A naive Bayes guess of the language, made from the
same hashed words, picks a decision threshold; thresholds are calibrated per guessed language on training rows that the network was not
fitted on, and moved to score 0.5. The guess is learned from the languages of the training rows, but a score depends on the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold, labelled_sample
from .textops import fold_latin, per_text, prefix_hash, sigmoid, small_batches, span_hash, text_blocks, word_spans

if TYPE_CHECKING:
    import pandas as pd

#: Rows of each hashed table, dimensions of a half and of an embedding, filters of each width.
ROWS, HALF, DIMS, FILTERS, WIDTHS = 1 << 17, 4, 8, 8, (1, 2, 3)
#: Bytes at a word's front that the second table is hashed by.
FRONT = 6
#: Fitted on at most about so many texts of each label, of at most so many characters.
PER_LABEL, MAX_CHARS = 2000, 20_000
#: Batches of so many texts, half of them toxic; every one sees so large a share of each text's words.
STEPS, BATCH, SHOWN = 900, 64, 0.8
RATE, WORD_RATE, SHRINK = 0.02, 0.1, 1e-3
#: Share of the training rows that only calibrates.
CALIBRATION = 0.3
#: Calibration texts of both labels that a guessed language needs for a threshold of its own.
LEAST_CALIBRATION = 12

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


@dataclass
class Cnn:
    embedding: np.ndarray  # (2 * ROWS, HALF), the second table below the first
    filters: list[np.ndarray]  # (width * DIMS, FILTERS) for each width
    biases: np.ndarray  # (widths, FILTERS)
    out: np.ndarray  # (widths * FILTERS,)
    bias: float
    language: np.ndarray | None = None  # (ROWS, L) log-probabilities
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both embedding rows of the words of all texts, (words, 2), and each text's first word."""
    low = fold_latin(data)
    starts, ends, first = word_spans(low, offsets, WORD[low])
    prefix = prefix_hash(low)
    word, front = span_hash(prefix, starts, ends), span_hash(prefix, starts, np.minimum(ends, starts + FRONT))
    return np.stack([word % np.uint64(ROWS), front % np.uint64(ROWS) + np.uint64(ROWS)], 1).astype(np.int32), first


def _vectors(model: Cnn, rows: np.ndarray) -> np.ndarray:
    return model.embedding[rows].reshape(len(rows), DIMS)


def _maps(model: Cnn, vectors: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Filter outputs at every word; a filter that would reach past its text's end sees zeros there."""
    n = len(vectors)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the end of the text
    shifted = [vectors]
    for k in range(1, max(WIDTHS)):
        moved = np.zeros_like(vectors)
        moved[:-k] = vectors[k:]
        moved[left <= k] = 0
        shifted.append(moved)
    return [np.concatenate(shifted[:w], axis=1) @ f + b for w, f, b in zip(WIDTHS, model.filters, model.biases, strict=True)]


def logits(model: Cnn, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    pooled = [np.maximum(per_text(m, first, np.maximum), 0) for m in _maps(model, _vectors(model, rows), first)]
    return np.concatenate(pooled, axis=1) @ model.out + model.bias


def guess_language(model: Cnn, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    if model.language is None:
        return np.zeros(len(first) - 1, np.int64)
    return per_text(model.language[rows[:, 0]], first).argmax(1)


def scores(model: Cnn, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    return sigmoid(logits(model, rows, first) - model.thresholds[guess_language(model, rows, first)])


def _rows_of(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    parts, counts = [np.zeros((0, 2), np.int32)], [np.zeros(0, np.int64)]
    for _, data, offsets in text_blocks(pa.array(list(texts), pa.large_string())):
        rows, first = word_rows(data, offsets)
        parts.append(rows)
        counts.append(np.diff(first))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64)


@dataclass
class Gradients:
    loss: float  # mean logistic loss of the texts
    out: np.ndarray
    bias: float
    filters: list[np.ndarray]
    biases: np.ndarray
    rows: np.ndarray  # embedding rows that some maximum depends on
    embedding: np.ndarray  # and their gradients


def gradients(model: Cnn, rows: np.ndarray, first: np.ndarray, y: np.ndarray) -> Gradients:
    """Back-propagation through the logistic layer, the maxima and the filters; a text without words reaches only the bias."""
    vectors = _vectors(model, rows)
    maps = _maps(model, vectors, first)
    full = np.flatnonzero(np.diff(first))
    where = [np.array([m[first[i] : first[i + 1]].argmax(0) + first[i] for i in full], np.int64).reshape(len(full), FILTERS) for m in maps]
    hidden = np.zeros((len(y), len(WIDTHS) * FILTERS), vectors.dtype)
    hidden[full] = np.concatenate([np.maximum(np.take_along_axis(m, w, 0), 0) for m, w in zip(maps, where, strict=True)], axis=1)
    z = hidden @ model.out + model.bias
    delta = (sigmoid(z) - y) / len(y)
    back = (delta[:, None] * model.out * (hidden > 0))[full]
    ends, keys, pulls = first[full + 1][:, None], [np.zeros(0, np.int64)], [np.zeros((0, HALF))]
    filters, biases = [], np.zeros(model.biases.shape)
    for k, width in enumerate(WIDTHS):
        d, gradient = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros(model.filters[k].shape)
        biases[k] = d.sum(0)
        for j in range(width):
            inside, part = where[k] + j < ends, slice(j * DIMS, (j + 1) * DIMS)
            place = np.minimum(where[k] + j, len(rows) - 1)
            gradient[part] = np.einsum("tf,tfd->df", d * inside, vectors[place])
            keys.append(rows[place].ravel())
            pulls.append(((d * inside)[..., None] * model.filters[k][part].T[None]).reshape(-1, HALF))
        filters.append(gradient)
    used, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    pulls = np.concatenate(pulls)
    steps = np.stack([np.bincount(inverse, pulls[:, j], len(used)) for j in range(HALF)], 1)
    loss = np.mean(np.logaddexp(0, z) - y * z)
    return Gradients(float(loss), hidden.T @ delta, float(delta.sum()), filters, biases, used, steps)


def _start(rng: np.random.Generator) -> Cnn:
    return Cnn(
        rng.normal(0, 0.1, (2 * ROWS, HALF)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * DIMS), (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )


def fit_cnn(texts: pd.Series, toxic: np.ndarray, languages: pd.Series | None = None, seed: int = 3, steps: int = STEPS) -> Cnn:
    """Train on texts with labels 0 and 1. One label or no text gives a constant score: 0 where nothing is toxic."""
    rng = np.random.default_rng(seed)
    every, bounds = _rows_of(texts)
    labels = np.asarray(toxic, np.float64)
    aside = rng.random(len(labels)) < CALIBRATION
    rows, first = _part(every, bounds, ~aside)
    y, model = labels[~aside], _start(rng)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.bias = 5.0 if len(labels) and labels.min() == 1 else -5.0
        return model
    means = {k: np.zeros(np.shape(v)) for k, v in (("out", model.out), ("bias", 0.0), ("biases", model.biases), *enumerate(model.filters))}
    squares, past = {k: np.zeros(np.shape(v)) for k, v in means.items()}, np.full(2 * ROWS, 1e-6)
    sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
    for t in range(1, steps + 1):
        batch = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        spans = [rows[first[i] : first[i + 1]] for i in batch]
        spans = [s[rng.random(len(s)) < SHOWN] for s in spans]
        local = np.concatenate(([0], np.cumsum([len(s) for s in spans])))
        if not local[-1]:
            continue
        g, fade = gradients(model, np.concatenate(spans), local, y[batch]), min(1.0, 2 * (1 - t / (steps + 1)))

        def move(k, value, step, t=t, fade=fade):
            """One step of Adam, the rate fading over the second half."""
            means[k] = 0.9 * means[k] + 0.1 * step
            squares[k] = 0.99 * squares[k] + 0.01 * step * step
            return value - RATE * fade * (means[k] / (1 - 0.9**t)) / (np.sqrt(squares[k] / (1 - 0.99**t)) + 1e-8)

        model.out = move("out", model.out, g.out + SHRINK * model.out).astype(np.float32)
        model.bias = float(move("bias", model.bias, g.bias))
        model.biases = move("biases", model.biases, g.biases).astype(np.float32)
        model.filters = [move(k, f, d + SHRINK * f).astype(np.float32) for k, (f, d) in enumerate(zip(model.filters, g.filters, strict=True))]
        past[g.rows] += (g.embedding**2).mean(1)
        model.embedding[g.rows] -= (WORD_RATE * fade * g.embedding / np.sqrt(past[g.rows])[:, None]).astype(np.float32)
    if not 0 < labels[aside].sum() < aside.sum():
        aside[:] = True  # too few rows to set some aside: all of them calibrate
    names = None if languages is None else languages.to_numpy()[aside]
    _calibrate(model, *_part(every, bounds, aside), labels[aside], names)
    return model


def _part(rows: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some of the texts."""
    lengths = np.diff(first)
    return rows[np.repeat(chosen, lengths)], np.concatenate(([0], np.cumsum(lengths[chosen])))


def _threshold(values: np.ndarray, y: np.ndarray) -> float:
    """The cut with the largest sum of both labels' rates found, in the middle of the widest equal stretch."""
    order = np.argsort(values, kind="stable")
    v, t = values[order], y[order]
    gain = np.concatenate(([0], np.cumsum((1 - t) / max(1, (1 - y).sum()) - t / max(1, y.sum()))))
    edges = np.concatenate(([v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]))
    width = np.concatenate(([0], np.diff(v), [0]))
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(edges[best[width[best].argmax()]])


def _calibrate(model: Cnn, rows: np.ndarray, first: np.ndarray, y: np.ndarray, languages: np.ndarray | None) -> None:
    blocks = [_part(rows, first, np.arange(len(y)) // 256 == k) for k in range(-(-len(y) // 256))]
    values = np.concatenate([logits(model, *b) for b in blocks])
    common = _threshold(values, y)
    names = sorted({x for x in languages if isinstance(x, str)}) if languages is not None else []
    if not names:
        model.thresholds = np.array([common])
        return
    table = np.full((ROWS, len(names)), 0.05)
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    for k, name in enumerate(names):
        table[:, k] += np.bincount(rows[:, 0], (languages == name)[owner].astype(float), ROWS)
    model.language = (np.log(table) - np.log(table.sum(0))).astype(np.float32)
    guessed = guess_language(model, rows, first)
    model.thresholds = np.full(len(names), common)
    for k in range(len(names)):
        mine = guessed == k
        if min(y[mine].sum(), (1 - y[mine]).sum()) >= LEAST_CALIBRATION:
            model.thresholds[k] = _threshold(values[mine], y[mine])


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, per_label: int = PER_LABEL) -> Cnn:
    """Fit on a bounded sample of labels(doc_id, toxic) outside the fold crc32(doc_id) mod `mod` = `held`."""
    keys = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", mod) != held)).select("doc_id", F.col("toxic").alias("label"))
    sample = labelled_sample(docs, keys, "label", per_label, MAX_CHARS, seed=4, also=("lang",))
    return fit_cnn(sample["text"], sample["label"].to_numpy(), sample["lang"])


def score(docs: DataFrame, model: Cnn) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from 0.5). Null and empty texts get the score of a text without
    words; texts are whole, a long one in a block of its own; repeated rows are scored each, no rows give none; existing columns of these two names
    are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for rows, data, offsets in text_blocks(texts):
            out[rows] = scores(shared.value, *word_rows(data, offsets))
        return pa.array(out)

    return docs.drop("score", "predicted").withColumn("score", toxicity(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
