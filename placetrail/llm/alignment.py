"""Alignment of two tokenizers' tokens over a corpus, with the document frequency of every pair of ids.

Both tokenizers encode a space and the text. Byte places where tokens of both end cut a text into groups; every overlap of two tokens is a link.
A texts' group of one token each has the same bytes on both sides, so the pair of ids is known from the A-id alone: an array from A-ids
to the B-ids of the same bytes, made once from the vocabularies, tells such pairs, and they are counted in vectors of the vocabulary's length. Only
other pairs, those of irregular groups, are counted through a shuffle.

Texts are aligned unit by unit, a unit ending where no token of either vocabulary can span; a task aligns a unit once and keeps the result, within a
bound of bytes, for later texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepairs import SPACE, character_kinds, words
from .lineage import cut
from .textops import give_back, small_batches, text_blocks, unused
from .unitcodes import most_frequent, packed, strings, unit_hashes, unpacked

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of aligned units that a task keeps; then it starts afresh.
KEPT_BYTES = 1 << 26
#: Counts of so many of the most frequent irregular pairs are sent to every task; all others are joined.
FREQUENT = 1 << 18
#: Pairs that a counting task holds before it adds them up.
PENDING = 1 << 21
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@dataclass
class Side:
    """One vocabulary: the bytes of every id, and how to load an encoder of strings into lists of ids inside a task."""

    spelled: list[bytes]
    load: Callable[[], Callable[[list[str]], list[list[int]]]]
    sizes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)


def read_byte_bpe(path: str = BYTE_BPE) -> Side:
    """A byte-level BPE; strings of special tokens are plain text."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()

    held = json.loads(raw)
    vocabulary = held["model"]["vocab"]
    spelled = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in held.get("added_tokens", []))]))
    byte_of = _byte_letters()
    for token, i in vocabulary.items():
        spelled[i] = bytes(byte_of[c] for c in token)
    return Side(spelled, partial(_byte_bpe, raw))


def _byte_bpe(raw: str) -> Callable[[list[str]], list[list[int]]]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(raw)
    model.encode_special_tokens = True
    return lambda texts: [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def read_pieces(path: str = PIECES) -> Side:
    """A SentencePiece BPE with byte fallback that puts one space before every text. The encoder takes strings that bring their space along: a character
    that is in no piece goes before them, and what it and the model's own space encode to is dropped."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    spelled, pieces = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        unseen = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if unseen else piece.replace("▁", " ").encode())
        pieces.append(piece)
    alone = next(c for c in ("\n", "\x01", "\ue000", "\ue001") if not any(c in piece for piece in pieces))
    drop = len(model.encode(alone))
    return Side(spelled, partial(_pieces, raw, alone, drop))


def _pieces(raw: bytes, alone: str, drop: int) -> Callable[[list[str]], list[list[int]]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return lambda texts: [ids[drop:] for ids in model.encode([alone + x for x in texts], num_threads=1)]


def identity_map(a: Side, b: Side) -> np.ndarray:
    """For every A-id the B-id of the same bytes (the largest, where several are alike), else -1."""
    same = {piece: i for i, piece in enumerate(b.spelled) if piece}
    return np.array([same.get(piece, -1) if piece else -1 for piece in a.spelled], np.int64)


def inner_pairs(b: Side) -> np.ndarray:
    """(256, 256): which bytes stand side by side in a token."""
    found = np.zeros((256, 256), bool)
    for piece in b.spelled:
        x = np.frombuffer(piece, np.uint8)
        found[x[:-1], x[1:]] = True
    return found


def units(inner: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each non-empty one, the starts and ends of their units, and each text's first unit.

    A unit begins where a word of A's pattern begins and the two bytes around the place are in no token of B, but not behind white space that something
    else follows: so a unit's words are the same when it stands alone.
    """
    full = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[full], 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    data, starts, _, _ = words(data, offsets)
    kinds = character_kinds(data) if len(data) else data
    before = np.maximum(starts - 1, 0)
    good = ~inner[data[before], data[starts]] & ((kinds[before] != SPACE) | (kinds[starts] == SPACE))
    good |= np.isin(starts, offsets)
    starts = starts[good]
    return data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets)


class Aligned:
    """The units that a task has aligned so far: their counts, the pairs of their links, and their groups as text."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b, self.encode_a, self.encode_b = a, b, a.load(), b.load()
        ids = np.arange(max(len(a.spelled), len(b.spelled))).astype(str)
        self.text = pa.array([*(f"{i}{end}" for own, ends in ((a, ",|"), (b, ",;")) for end in ends for i in ids[: len(own.spelled)])], pa.binary())
        self.clear()

    def clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.counts = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes differ
        self.pairs, self.pair_ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups, self.group_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def look_up(self, names: list[bytes]) -> np.ndarray:
        """The place of every unit; new ones are aligned first."""
        if self.pairs.nbytes + self.groups.nbytes + 200 * len(self.places) > KEPT_BYTES:
            self.clear()
        if new := [x for x in names if x not in self.places]:
            self.add(new)
        return np.array([self.places[x] for x in names], np.int64)

    def add(self, new: list[bytes]) -> None:
        texts = [x.decode() for x in new]
        own = [encode(texts) for encode in (self.encode_a, self.encode_b)]
        bad = np.zeros(len(new), bool)
        for side, lists in zip((self.a, self.b), own, strict=True):
            bad |= [b"".join([side.spelled[i] for i in ids]) != x for ids, x in zip(lists, new, strict=True)]
        sizes = np.where(bad, 0, [len(x) for x in new])
        bounds = np.cumsum(sizes)
        ids = [np.array([i for x, wrong in zip(lists, bad, strict=True) if not wrong for i in x], np.int64) for lists in own]
        ends = [np.cumsum(side.sizes[x]) for side, x in zip((self.a, self.b), ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        overlaps = np.union1d(*ends)
        links = ids[0][np.searchsorted(ends[0], overlaps)] * len(self.b.spelled) + ids[1][np.searchsorted(ends[1], overlaps)]
        upto = [np.searchsorted(x, bounds, "right") for x in (*ends, common, overlaps)]
        counts = np.stack([*(np.diff(x, prepend=0) for x in upto), bad], axis=1)
        # Tokens in the order of their groups, A before B: each stands behind its own side's earlier tokens and the other's of the groups before.
        group = [np.searchsorted(common, x) for x in ends]
        places = [np.arange(len(ids[0])) + np.searchsorted(group[1], group[0], "left"), np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], "right")]
        shown, size, base = np.zeros(len(ids[0]) + len(ids[1]), np.int64), [len(self.a.spelled), len(self.b.spelled)], 0
        for k in (0, 1):
            shown[places[k]] = base + ids[k] + size[k] * np.isin(ends[k], common, assume_unique=True)
            base += 2 * size[k]
        parts = self.text.take(pa.array(shown))
        part_ends = np.concatenate(([0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)
        drawn = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[: part_ends[-1]]
        first = len(self.places)
        self.places.update(zip(new, range(first, first + len(new)), strict=True))
        self.counts = np.concatenate((self.counts, counts))
        self.pair_ends = np.concatenate((self.pair_ends, len(self.pairs) + upto[3]))
        self.pairs = np.concatenate((self.pairs, links))
        self.group_ends = np.concatenate((self.group_ends, len(self.groups) + part_ends[upto[0] + upto[1]]))
        self.groups = np.concatenate((self.groups, drawn))


def _align_block(aligned: Aligned, inner: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Per text: counts (tokens of A and B, groups, links), digest of its groups, their text, distinct pairs, how often each is linked."""
    data, starts, ends, first = units(inner, data, offsets)
    h, g = unit_hashes(data, starts, ends)
    order = np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    code = np.zeros(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    names = strings(data, starts, ends, order[new]).cast(pa.binary()).to_pylist()
    code = aligned.look_up(names)[code]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wrong = np.bincount(owner, aligned.counts[code, 4], len(first) - 1) > 0
    good = ~wrong[owner]
    code, owner = code[good], owner[good]
    bounds = np.searchsorted(owner, np.arange(len(first)))
    counts = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(aligned.counts[code, :4], axis=0)))[bounds]
    counts = counts[1:] - counts[:-1]
    shown = pa.Array.from_buffers(pa.large_binary(), len(aligned.counts), [None, pa.py_buffer(aligned.group_ends), pa.py_buffer(aligned.groups)]).take(pa.array(code))
    shown_ends = np.concatenate(([0], np.cumsum(np.diff(aligned.group_ends)[code])))[bounds]
    raw = memoryview(shown.buffers()[2] or b"")
    texts = [raw[s : e - 1] if e > s else raw[:0] for s, e in zip(shown_ends[:-1].tolist(), shown_ends[1:].tolist(), strict=True)]
    # Equal units of a text once, with their number, before their links are laid out.
    both, times = np.unique(owner * len(aligned.counts) + code, return_counts=True)
    owner, code = both // len(aligned.counts), both % len(aligned.counts)
    many = np.diff(aligned.pair_ends)[code]
    at = np.arange(many.sum()) + np.repeat(aligned.pair_ends[code] - np.cumsum(many) + many, many)
    width = len(aligned.a.spelled) * len(aligned.b.spelled)
    keys = np.repeat(owner, many) * width + aligned.pairs[at]
    order = np.argsort(keys)
    keys, times = keys[order], np.repeat(times, many)[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    times = np.add.reduceat(times, heads) if len(heads) else times
    keys = keys[heads]
    bounds = np.searchsorted(keys, np.arange(len(first)) * width)
    return counts, texts, keys % width, times, bounds


def _pack(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs in rising order as their differences, then how often each is linked."""
    return packed(np.concatenate((np.diff(keys, prepend=0), times))) if len(keys) else b""


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, how often, rows) of all rows of a batch."""
    sizes = batch.column("n_pairs").to_numpy()
    both = [unpacked(x, 2 * n) for x, n in zip(batch.column("pairs").to_pylist(), sizes.tolist(), strict=True) if n]
    keys = [np.cumsum(x[: len(x) // 2]) for x in both] or [np.zeros(0, np.int64)]
    times = [x[len(x) // 2 :] for x in both] or [np.zeros(0, np.int64)]
    return np.concatenate(keys), np.concatenate(times), np.repeat(np.arange(len(sizes)), sizes)


def count_pairs(linked: DataFrame, same: np.ndarray, width: int) -> DataFrame:
    """(a, b, regular, n): how many rows of linked(n_pairs, pairs) hold each pair. Pairs of the identity map are added up in one vector a task; others
    in batches, which are shuffled as sums."""

    def out(keys: np.ndarray, n: np.ndarray, regular: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(np.full(len(keys), regular)), pa.array(n)], ["a", "b", "regular", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, held, n = np.zeros(len(same), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, _, _ = _unpack(batch)
            regular = same[keys // width] == keys % width
            vector += np.bincount(keys[regular] // width, minlength=len(same))
            more, times = np.unique(keys[~regular], return_counts=True)
            held, back = np.unique(np.concatenate((held, more)), return_inverse=True)
            n = np.bincount(back, np.concatenate((n, times)), len(held)).astype(np.int64)
            if len(held) > PENDING:
                yield out(held, n, False)
                held, n = held[:0], n[:0]
        seen = np.flatnonzero(vector)
        yield out(seen * width + same[seen], vector[seen], True)
        yield out(held, n, False)
        give_back()

    rows = linked.select("n_pairs", "pairs").mapInArrow(add, "a int, b int, regular boolean, n long")
    return rows.groupBy("a", "b", "regular").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, a: Side, b: Side, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(aligned, counts). aligned: every row of docs, its text replaced by n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256
    (string), with keep_groups also by groups, the groups themselves; counts: (a, b, n), the documents (rows) that hold each pair linked.

    Whole texts of any length; a text longer than a block is aligned in one piece. Texts that are null or empty, or that either vocabulary spells
    otherwise (as those with U+2581), have no tokens: zeros and an empty string. Repeated rows count each; no rows give none. Where docs has a column
    of one of the new names, the new one gets an underscore. Ties for an A-id's highest count are all best. Only vectors of the vocabularies' lengths and
    the FREQUENT most frequent irregular pairs reach the driver; counts of other pairs are joined, whatever their number.
    """
    spark = docs.sparkSession
    small_batches(spark)
    inner, same, width = inner_pairs(b), identity_map(a, b), len(b.spelled)
    sides = spark.sparkContext.broadcast((a, b))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligned(*sides.value)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch.column("text")):
                counts, texts, keys, times, bounds = _align_block(aligned, inner, data, offsets)
                pairs = [_pack(keys[s:e], times[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                digests = [sha256(x).hexdigest() if len(x) else "" for x in texts]
                own = [batch.column(c).slice(rows.start, len(texts)) for c in ("row", "held")]
                kept = pa.array([bytes(x).decode() for x in texts] if keep_groups else [None] * len(texts), pa.string())
                arrays = [*own, *map(pa.array, counts.T), pa.array(digests), kept, pa.array(np.diff(bounds)), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "held", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_pairs", "pairs"])

    held = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "text", held.alias("held"))
    kind = keyed.schema["held"].dataType.simpleString()
    numbers = "row long, held {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string".format(kind=kind)
    linked = cut(keyed.mapInArrow(align, f"{numbers}, n_pairs long, pairs binary"))
    counts = cut(count_pairs(linked, same, width))
    highest = cut(counts.groupBy("a").agg(F.max("n").alias("most")))

    def vector(table: DataFrame, value: str) -> np.ndarray:
        found, out = table.select("a", value).toArrow(), np.zeros(len(same), np.int64)
        out[found.column("a").to_numpy()] = found.column(value).to_numpy()
        return out

    often = most_frequent(counts.filter(~F.col("regular")), FREQUENT).select((F.col("a") * F.lit(width).cast("long") + F.col("b")).alias("pair"), "n").toArrow()
    pair, n = (often.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    known = spark.sparkContext.broadcast((pair[order], n[order], vector(counts.filter("regular"), "n"), vector(highest, "most")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, regular_n, most = known.value
        for batch in batches:
            keys, times, owner = _unpack(batch)
            left = keys // width
            regular = same[left] == keys % width
            at = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
            hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
            count = np.where(regular, regular_n[left], np.where(hit, n[at] if len(pair) else 0, 0))
            open_ = ~regular & ~hit
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], owner, np.where(~open_ & (count == most[left]), times, 0))
            np.add.at(sums[1], owner, times * count)
            bounds = pa.array(np.searchsorted(owner[open_], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(bounds, pa.array(x[open_])) for x in (keys, times)]
            arrays = [batch.column(c) for c in batch.schema.names if c not in ("n_pairs", "pairs")]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, sums), *rest], [*(c for c in batch.schema.names if c not in ("n_pairs", "pairs")), "n_best", "count_sum", "rest", "times"])
        give_back()

    scored = cut(linked.mapInArrow(score, f"{numbers}, n_best long, count_sum long, rest array<long>, times array<long>"))
    rare = scored.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
    table = counts.filter(~F.col("regular")).join(highest, "a").select((F.col("a") * F.lit(width).cast("long") + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).alias("best"))
    more = rare.join(table, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    joined = scored.drop("rest", "times").join(more, "row", "left")
    joined = joined.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    names = [*OUTPUTS, *(["groups"] if keep_groups else [])]
    return joined.select("held.*", *[F.col(c).alias(unused(c, docs.columns)) for c in names]), counts.select("a", "b", "n")
