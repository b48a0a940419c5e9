"""Language identification with a linear-chain conditional random field over the words of a text.

Every word has a state (a language). Its emission score is a sum of learned weights of the hashed word itself
(lexicon), its affixes of two and three bytes and its byte bigrams; learned transitions join neighbouring words.
Forward-backward gives each word's posterior, so code-switched text is labelled word by word; a text's
language is the one with the largest mean posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fold, labelled_sample
from .textops import fold_latin, give_back, mix, per_text, prefix_hash, span_hash, small_batches, text_blocks, unused, word_spans

if TYPE_CHECKING:
    import pandas as pd

#: Slots of the hashed lexicon and affix weights; with more than MANY languages they are fewer, so that a model stays within memory.
SLOTS, LEAST_SLOTS, MANY = 1 << 17, 1 << 13, 32
#: Fitted on at most about so many texts of each language, of at most so many characters.
PER_LANGUAGE, MAX_CHARS = 300, 20_000
#: Words of one training sequence, and of the runs from different texts that are spliced into it.
SEQUENCE, RUN = 48, 12
EPOCHS, BATCH, RATE = 3, 256, 0.2
#: Bytes of the texts that are labelled together, and of the words whose features are held at a time.
BLOCK, PART = 1 << 18, 1 << 17

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # (slots, L): lexicon and affixes
    bigrams: np.ndarray  # (65536, L)
    transitions: np.ndarray  # (L, L)
    start: np.ndarray  # (L,)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in small letters with a zero byte after each; starts and ends of their words (maximal runs of letters: A-Z and
    every byte of a non-ASCII character), and each text's first word."""
    low = np.insert(fold_latin(data), offsets[1:], 0)
    bounds = offsets + np.arange(len(offsets))
    return low, *word_spans(low, bounds, LETTER[low])


def parts_of(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Words in runs of about PART bytes; a longer word is a run of its own."""
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PART, "right")))
        yield slice(at, to)
        at = to


def slots_for(languages: int) -> int:
    """A power of two: SLOTS for up to MANY languages, then so many that slots times languages stays about the same."""
    return max(LEAST_SLOTS, SLOTS >> max(0, (languages - 1) // MANY).bit_length())


def word_slots(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: int) -> np.ndarray:
    """(n, 5) slots, of `many`, of each word's lexicon and affix weights."""
    prefix = prefix_hash(low)
    slots = np.empty((len(starts), 5), np.int32)
    two_s, two_e = np.minimum(starts + 2, ends), np.maximum(ends - 2, starts)
    three_s, three_e = np.minimum(starts + 3, ends), np.maximum(ends - 3, starts)
    for i, (s, e) in enumerate(((starts, ends), (starts, two_s), (starts, three_s), (two_e, ends), (three_e, ends))):
        slots[:, i] = (mix(span_hash(prefix, s, e) + np.uint64(i + 1)) & np.uint64(many - 1)).astype(np.int32)
    return slots


def bigrams_at(low: np.ndarray) -> np.ndarray:
    """At every place the code of the byte before it and the byte on it, where only letters count: a word of n letters has the n + 1
    codes from its start to its end, with a mark before and after it."""
    codes = np.where(LETTER[low], low, 0).astype(np.uint16)
    codes[1:] += codes[:-1] * np.uint16(256)
    return codes


def emissions(model: Crf, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, L) scores of every word, from PART bytes at a time."""
    out = np.empty((len(starts), len(model.languages)), np.float32)
    for part in parts_of(starts, ends):
        base = starts[part][0]
        own, s, e = low[base : ends[part][-1] + 1], starts[part] - base, ends[part] - base
        slots = word_slots(own, s, e, len(model.weights))
        score = model.weights[slots].sum(1)
        codes = bigrams_at(own)
        if len(s) > 1:
            out[part] = score + np.add.reduceat(model.bigrams[codes], s, axis=0)
        else:
            out[part] = score + sum(model.bigrams[codes[i : i + PART]].sum(0) for i in range(0, len(codes), PART))
    return out


#: Steps between two normalisations: a step scales a state by 1e-30 at the least, so doubles cannot underflow.
NORMAL_EVERY = 8


def posteriors(emission: np.ndarray, first: np.ndarray, model: Crf) -> np.ndarray:
    """Forward-backward over all texts at once, longest first: one step handles the t-th word of every text.

    Words are laid out by step, so each step reads and writes one slice.
    """
    lengths = np.diff(first)
    if not len(emission):
        return np.zeros(emission.shape)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    steps = int(lengths.max())
    active = np.searchsorted(-lengths[order], -np.arange(steps), "left")  # texts longer than t
    level = np.concatenate(([0], np.cumsum(active)))
    place = level[np.arange(len(emission)) - np.repeat(first[:-1], lengths)] + np.repeat(rank, lengths)
    score = np.empty(emission.shape)
    score[place] = np.exp(emission - emission.max(1, keepdims=True)) + 1e-26
    move = np.exp(model.transitions - model.transitions.max())
    forward, backward = np.empty_like(score), np.ones_like(score)
    state = score[: active[0]] * np.exp(model.start - model.start.max())
    forward[: active[0]] = state
    sizes, bounds = active.tolist(), level.tolist()
    for t in range(1, steps):
        n, low = sizes[t], bounds[t]
        state = (state[:n] @ move) * score[low : low + n]
        if t % NORMAL_EVERY == 0:
            state /= state.sum(1, keepdims=True)
        forward[low : low + n] = state
    back = np.ascontiguousarray(move.T)
    for t in range(steps - 1, 0, -1):
        n, low = sizes[t], bounds[t]
        state = (backward[low : low + n] * score[low : low + n]) @ back
        if t % NORMAL_EVERY == 0:
            state /= state.sum(1, keepdims=True)
        backward[bounds[t - 1] : bounds[t - 1] + n] = state
    forward /= forward.max(1, keepdims=True)
    forward *= backward / backward.max(1, keepdims=True)
    forward /= forward.sum(1, keepdims=True)
    return forward[place]


@dataclass
class Gradients:
    likelihood: float  # log-likelihood of the labels, over all sequences
    emission: np.ndarray  # its gradient by the emissions (B, T, L)
    transitions: np.ndarray  # by the transitions (L, L)
    start: np.ndarray  # by the start weights (L,)


def gradients(emission: np.ndarray, labels: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> Gradients:
    """Exact gradients for sequences of one length: emission (B, T, L), labels (B, T).

    Forward and backward states are scaled to sum 1 at every word. The expected number of moves i -> j at a word is the pair
    marginal forward(t, i) * move(i, j) * score(t + 1, j) * backward(t + 1, j), divided by its sum.
    """
    many, steps, size = emission.shape
    top = emission.max(2, keepdims=True)
    score, move, begin = np.exp(emission - top), np.exp(transitions), np.exp(start)
    forward, backward, scale = np.empty_like(score), np.ones_like(score), np.empty((many, steps))
    state = begin * score[:, 0]
    for t in range(steps):
        if t:
            state = (forward[:, t - 1] @ move) * score[:, t]
        scale[:, t] = state.sum(1)
        forward[:, t] = state / scale[:, t, None]
    for t in range(steps - 1, 0, -1):
        backward[:, t - 1] = (backward[:, t] * score[:, t]) @ move.T / scale[:, t, None]
    post = forward * backward
    after = score[:, 1:] * backward[:, 1:] / scale[:, 1:, None]
    pairs = move * (forward[:, :-1].reshape(-1, size).T @ after.reshape(-1, size))
    truth = np.eye(size)[labels]
    seen = truth[:, :-1].reshape(-1, size).T @ truth[:, 1:].reshape(-1, size)
    path = (truth * emission).sum() + (seen * transitions).sum() + start[labels[:, 0]].sum()
    return Gradients(float(path - np.log(scale).sum() - top.sum()), truth - post, seen - pairs, (truth[:, 0] - post[:, 0]).sum(0))


def fit_crf(sample: pd.DataFrame, label: str = "lang", seed: int = 5) -> Crf | None:
    """Fit on texts with one label each. Runs of words from different texts are spliced into sequences, so that the
    transitions are learned from code-switched examples. None without any labelled word."""
    sample = sample[sample[label].notna()]
    languages = sorted(set(sample[label]))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    texts = pa.array(sample["text"].tolist(), pa.large_string())
    wanted = np.searchsorted(np.array(languages, object), sample[label].to_numpy(object))
    slots, labels, codes, begins, lengths, size = [], [], [], [], [], len(languages)
    for rows, data, offsets in text_blocks(texts):
        low, starts, ends, first = words_of(data, offsets)
        slots.append(word_slots(low, starts, ends, slots_for(size)))
        labels.append(np.repeat(wanted[rows], np.diff(first)))
        begins.append(starts + sum(map(len, codes)))
        lengths.append(ends - starts + 1)
        codes.append(bigrams_at(low))
    slots, labels, codes, begins, lengths = map(np.concatenate, (slots, labels, codes, begins, lengths))
    n = len(labels)
    if not n:
        return None
    runs = rng.permutation(n // RUN) if n >= RUN else np.zeros(1, np.int64)
    whole = (runs[:, None] * RUN + np.arange(RUN)).ravel() % n
    whole = np.resize(whole, max(1, len(whole) // SEQUENCE) * SEQUENCE).reshape(-1, SEQUENCE)
    model = Crf(languages, np.zeros((slots_for(size), size), np.float32), np.zeros((65536, size), np.float32), np.zeros((size, size)), np.zeros(size))
    past = [np.full_like(x, 1e-2) for x in (model.weights, model.bigrams, model.transitions, model.start)]
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(whole)), max(1, len(whole) // BATCH)):
            at = whole[batch].ravel()
            first = np.concatenate(([0], np.cumsum(lengths[at])))
            own = codes[np.arange(first[-1]) - np.repeat(first[:-1] - begins[at], lengths[at])]
            emission = model.weights[slots[at]].sum(1) + per_text(model.bigrams[own], first)
            g = gradients(emission.reshape(len(batch), SEQUENCE, size).astype(np.float64), labels[at].reshape(len(batch), SEQUENCE), model.transitions, model.start)
            delta = (g.emission.reshape(-1, size) / len(batch)).astype(np.float32)
            for table, seen, keys, change in (
                (model.weights, past[0], slots[at].ravel(), np.repeat(delta, slots.shape[1], axis=0)),
                (model.bigrams, past[1], own, np.repeat(delta, lengths[at], axis=0)),
            ):
                used, inverse = np.unique(keys, return_inverse=True)
                step = np.stack([np.bincount(inverse, change[:, j], len(used)) for j in range(size)], 1).astype(np.float32)
                seen[used] += step * step
                table[used] += RATE * step / np.sqrt(seen[used])
            for table, seen, step in ((model.transitions, past[2], g.transitions / len(at)), (model.start, past[3], g.start / len(batch))):
                seen += step * step
                table += RATE * step / np.sqrt(seen)
    return model


def identify(docs: DataFrame, model: Crf | None) -> DataFrame:
    """docs plus lang_pred and score (mean posterior of that language, 0 to 1).

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Works on whole texts, a long one in a block of its
    own, whose posteriors (words x languages, four times) a task then holds at once. Repeated rows are labelled each, no rows give none; existing
    columns of these two names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def label(texts: pa.Array) -> pa.Array:
        crf = shared.value
        names = np.array([*crf.languages, "und"], object)
        found, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
        for rows, data, offsets in text_blocks(texts, max(1 << 12, BLOCK * 8 // max(8, len(crf.languages)))):
            low, starts, ends, first = words_of(data, offsets)
            post = posteriors(emissions(crf, low, starts, ends), first, crf)
            counts = np.diff(first)
            mean = per_text(post, first) / np.maximum(counts, 1)[:, None]
            best = np.where(counts > 0, mean.argmax(1), len(crf.languages))
            found[rows] = names[best]
            sure[rows] = np.where(counts > 0, np.minimum(mean.max(1), 1.0), 0.0)
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(sure)], ["lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = unused("found", kept.columns)
    return (
        kept.withColumn(found, label(F.col("text")))
        .withColumns({"lang_pred": F.when(lettered, F.col(found)["lang_pred"]).otherwise(F.lit("und")), "score": F.when(lettered, F.col(found)["score"]).otherwise(F.lit(0.0))})
        .drop(found)
    )


def identify_into(docs: DataFrame, model: Crf | None, least: float) -> DataFrame:
    """The rows of docs whose language is recognised with a score of at least `least`, with docs' own columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    marked = docs.toDF(*names).withColumnRenamed(names[docs.columns.index("text")], "text")
    kept = identify(marked, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return kept.toDF(*docs.columns)


def label_words(text: str, model: Crf) -> list[tuple[str, str]]:
    """(word, language) of each run of letters of one text."""
    found = []
    for _, data, offsets in text_blocks(pa.array([text], pa.large_string())):
        low, starts, ends, first = words_of(data, offsets)
        states = posteriors(emissions(model, low, starts, ends), first, model).argmax(1)
        found += [(bytes(data[s:e]).decode("utf-8", "replace"), model.languages[k]) for s, e, k in zip(starts, ends, states, strict=True)]
    return found


def train(docs: DataFrame, mod: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> Crf | None:
    """Fit on a bounded sample of docs(doc_id, text, lang) outside the held-out fold crc32(doc_id) mod `mod` = `held`."""
    usable = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)
    keys = docs.filter(usable & (fold("doc_id", mod) != held)).select("doc_id", "lang")
    model = fit_crf(labelled_sample(docs, keys, "lang", per_language, MAX_CHARS, seed=9))
    give_back()
    return model
