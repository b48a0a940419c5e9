"""Byte-level BPE encoding and decoding by replaying all merges over the words of a corpus.

A text is cut into words by the pre-tokenizer's pattern, evaluated on whole blocks of bytes. Every distinct word of a partition is encoded once:
the words stand one after another as a linked list of symbols, an inverted index leads from each token pair to the places where it
stands, and the merges are applied in the order of their ranks, each at all of its places; only the pairs that a merge's neighbours form
with the new symbol enter the index anew. Documents are then put together from their words' ids. Merges act inside a word alone, so the index of
the whole corpus falls apart into those of its partitions, and nothing has to be shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import unitcodes
from .textops import give_back, small_batches, text_blocks, unused

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes of new words that one index covers, of text whose words are encoded together (a replay walks through all ranks that occur, so few replays
#: are best), and of words that a task keeps for later texts.
INDEX_BYTES, GATHER, KEPT_BYTES = 1 << 23, 1 << 25, 1 << 27
LETTER, NUMBER, SPACE, OTHER = range(4)
#: The letters after an apostrophe that the pattern takes as a word of their own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


@dataclass
class Merges:
    """A vocabulary: the bytes of every id, the id of every byte, and the pairs of ids (left * size + right, in rising order) that
    merge, with the id they merge to, which is their rank."""

    spelled: list[bytes]
    byte_ids: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray

    @property
    def size(self) -> int:
        return len(self.spelled)

    @cached_property
    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """The left and the right id of every merge, by the id it leads to; -1 where none does."""
        left, right = np.full(self.size, -1), np.full(self.size, -1)
        left[self.merged], right[self.merged] = self.pairs // self.size, self.pairs % self.size
        return left, right

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, -1 for pairs that do not merge."""
        if not len(self.pairs):
            return np.full(len(left), -1)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.merged[at], -1)


def read_ranks(path: str = RANKS) -> Merges:
    """The ranks of a file of lines (base64 token, rank)."""
    with open(path, "rb") as f:
        return make_merges({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def make_merges(ranks: dict[bytes, int]) -> Merges:
    """The merge that leads to every token: what is left of it when all merges of lower rank have been applied to it.

    If that is two tokens, the token is their merge. If it is more, no text holds the token, provided that the token does not come up through
    a token of higher rank; a vocabulary where it does, or one without all 256 bytes, is an error, as no order of ranks would give its encodings.
    """
    spelled = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    if len(single := {t[0]: r for t, r in ranks.items() if len(t) == 1}) < 256:
        raise ValueError("a vocabulary needs all 256 bytes")
    pairs, merged = [], []
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = _shorten(token, ranks, rank)
            if len(parts) == 2:
                pairs.append(ranks[parts[0]] * len(spelled) + ranks[parts[1]])
                merged.append(rank)
            elif len(_shorten(token, ranks, len(spelled))) == 1:
                raise ValueError(f"token {rank} comes up through a token of higher rank")
    order = np.argsort(np.array(pairs, np.int64))
    return Merges(spelled, np.array([single[b] for b in range(256)]), np.array(pairs, np.int64)[order], np.array(merged, np.int64)[order])


def _shorten(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The token's bytes after all merges of rank below `below`, the lowest first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    import regex

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            low, high = ord(found[0][0]), ord(found[0][-1])
            classes[low : high + 1] = kind
    return classes


_classes: list[np.ndarray] = []


def character_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that every byte belongs to."""
    if not _classes:
        _classes.append(character_classes())
    kinds = _classes[0][data & 0x7F]  # right for ASCII
    for lead in np.split(wide := np.flatnonzero(data >= 0xC0), range(1 << 16, len(wide), 1 << 16)):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        for k in range(4):
            more = size > k
            kinds[lead[more] + k] = _classes[0][code[more]]
    return kinds


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the starts and ends of the pattern's matches, and each text's first match.

    The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` makes a word of every run of one class, with three
    exceptions. The last character of white space before a run stands alone, and goes to the run if it is a plain space. An apostrophe that is
    a run of its own, without such a space, takes the letters of a contraction after it.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    kinds = character_kinds(data)
    fronts = offsets[:-1][np.diff(offsets) > 0]
    begin = np.ones(len(data), bool)
    begin[1:] = kinds[1:] != kinds[:-1]
    begin[fronts] = True
    # Where white space is followed by something else in the same text.
    after = np.flatnonzero(begin[1:] & (kinds[:-1] == SPACE)) + 1
    after = np.setdiff1d(after, fronts, assume_unique=True)
    begin[after[data[after - 1] == 32]] = False
    last = after - 1
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last = last - inside
    begin[last] = True
    end = np.zeros(len(data) + 1, bool)
    end[fronts], end[-1] = True, True
    quote = np.flatnonzero(begin & (data == 39) & ~end[1:])
    quote = quote[kinds[quote + 1] == LETTER]
    for letters in CONTRACTIONS:
        own = quote[quote + len(letters) < len(data)]
        for k, letter in enumerate(letters, 1):
            own = own[(data[own + k] == letter) & ~end[own + k]]
        begin[own + 1] = False
        rest = own + len(letters) + 1
        begin[rest[rest < len(data)]] = True
    starts = np.flatnonzero(begin)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def replay(merges: Merges, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the ids of words data[offsets[i] : offsets[i + 1]] are ids[bounds[i] : bounds[i + 1]].

    A place whose pair has changed since it entered the index is passed over. In a run of equal symbols a pair takes every other place,
    as from left to right.
    """
    symbols = merges.byte_ids[data].astype(np.int32)
    here = np.arange(len(data), dtype=np.int32)
    following, before = here + 1, here - 1
    full = np.diff(offsets) > 0
    following[offsets[1:][full] - 1] = -1
    before[offsets[:-1][full]] = -1
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Places of left symbols into the index, under the rank of the pair that begins there."""
        ranks = merges.look_up(symbols[places], symbols[following[places]])
        good = ranks >= 0
        ranks, places = ranks[good], places[good]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranks)), bool), ranks[1:] != ranks[:-1])))
        for rank, own in zip(ranks[heads].tolist(), np.split(places, heads[1:]) if len(heads) else [], strict=True):
            if rank not in index:
                index[rank] = []
                heappush(waiting, rank)
            index[rank].append(own)

    enter(np.flatnonzero(following >= 0).astype(np.int32))
    lefts, rights = merges.sides
    while waiting:
        rank = heappop(waiting)
        left, right = lefts[rank], rights[rank]
        places = np.unique(np.concatenate(index.pop(rank)))
        places = places[(symbols[places] == left) & (following[places] >= 0)]
        places = places[symbols[following[places]] == right]
        if left == right and len(places) > 1:
            chained = np.concatenate(([False], following[places[:-1]] == places[1:]))
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
        gone = following[places]
        symbols[places], symbols[gone] = rank, -1
        beyond = following[gone]
        following[places] = beyond
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        front = before[places]
        enter(np.union1d(front[front >= 0], places[beyond >= 0]))
    left = symbols >= 0
    return symbols[left], np.concatenate(([0], np.cumsum(left)))[offsets]


class Words:
    """The distinct words that a task has met, numbered, and the ids of those that have been encoded."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.fresh: list[bytes] = []
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.size = 0

    def number(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of a block of texts in order, and each text's first word."""
        data, starts, ends, first = words(data, offsets)
        h, g = unitcodes.unit_hashes(data, starts, ends)
        order = np.lexsort((g, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        names = unitcodes.strings(data, starts, ends, order[new]).cast(pa.binary()).to_pylist()
        known = len(self.numbers)
        numbers = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in names], np.int32)
        fresh = [x for x, number in zip(names, numbers.tolist(), strict=True) if number >= known]
        self.fresh += fresh
        self.size += sum(map(len, fresh)) + 120 * len(fresh)
        out = np.empty(len(order), np.int32)
        out[order] = numbers[np.cumsum(new) - 1]
        return out, first

    def encode(self) -> None:
        """Replay all merges over the words that have no ids yet."""
        for _, data, offsets in text_blocks(pa.array(self.fresh, pa.binary()).cast(pa.string()), INDEX_BYTES):
            ids, bounds = replay(self.merges, data, offsets)
            self.bounds = np.concatenate((self.bounds, len(self.ids) + bounds[1:]))
            self.ids = np.concatenate((self.ids, ids))
        self.fresh = []


def encode_documents(docs: DataFrame, merges: Merges) -> DataFrame:
    """Every row of docs, its text replaced by n_bytes, n_pieces (long), ids (array<int>, in order), decoded (string, the text
    rebuilt from the ids alone) and round_trip (boolean: decoded has the text's length and hash).

    One pass, without a shuffle: a task numbers the distinct words of its texts, replays the merges over all new ones whenever it has
    gathered GATHER bytes of text, and then writes those rows. Whole texts, of any length, and words of any length; null and empty texts have no
    ids and are decoded to themselves; repeated rows are encoded each, no rows give none. Where docs has a column of one of the five names, the new
    one gets an underscore.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(merges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(shared.value)
        spelled = pa.array(own.merges.spelled, pa.binary())
        waiting, size = [], 0

        def written() -> Iterator[pa.RecordBatch]:
            own.encode()
            lengths = np.diff(own.bounds)
            for columns, numbers, first, n_bytes in waiting:
                ids = unitcodes.ragged(own.ids, own.bounds[numbers], lengths[numbers])
                upto = np.concatenate(([0], np.cumsum(lengths[numbers])))[first]
                parts = spelled.take(pa.array(ids))
                ends = np.concatenate(([0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))))[upto].astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(n_bytes), [None, pa.py_buffer(ends.tobytes()), parts.buffers()[2] or pa.py_buffer(b"")]).cast(pa.string())
                texts = pc.if_else(columns[-1], pa.scalar(None, pa.string()), texts)
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(n_bytes), pa.array(np.diff(upto)), lists, texts], ["held", "mark", "n_bytes", "n_pieces", "ids", "decoded"])
            waiting.clear()
            if own.size > KEPT_BYTES:
                own.clear()
            give_back()

        for batch in batches:
            for rows, data, offsets in text_blocks(batch.column("text")):
                # Copies, as a slice would keep the whole batch with its texts.
                take = pa.array(np.arange(rows.start, rows.stop))
                waiting.append(([batch.column(c).take(take) for c in ("held", "mark", "absent")], *own.number(data, offsets), np.diff(offsets)))
                size += len(data)
                if size >= GATHER:
                    yield from written()
                    size = 0
        yield from written()

    held = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    keyed = docs.select("text", held.alias("held"), F.xxhash64("text").alias("mark"), F.col("text").isNull().alias("absent"))
    kind = keyed.schema["held"].dataType.simpleString()
    out = keyed.mapInArrow(encode, f"held {kind}, mark long, n_bytes long, n_pieces long, ids array<int>, decoded string")
    same = (F.xxhash64("decoded") == F.col("mark")) & (F.coalesce(F.octet_length("decoded"), F.lit(0)) == F.col("n_bytes"))
    outputs = [*map(F.col, ("n_bytes", "n_pieces", "ids", "decoded")), same]
    return out.select("held.*", *[c.alias(unused(n, docs.columns)) for c, n in zip(outputs, unitcodes.OUTPUTS, strict=True)])


def decode_ids(merges: Merges, ids: list[int]) -> bytes:
    return b"".join(merges.spelled[i] for i in ids)


