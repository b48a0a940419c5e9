"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units at every place that no piece of a best segmentation spans, so the best segmentation of a text is that of its
units. For each distinct unit, substrings of bounded length are exploded and equi-joined to the piece table; the edges are grouped by unit
and a Viterbi pass folds over the unit's characters with Spark's higher-order `aggregate`. Long units are dealt out in blocks of
characters, whose edges are grouped by unit and block; the pass then carries its state from block to block. Characters without a piece
fall back to byte pieces. A space stands for the space mark, and, as in the model's own encoder, a text is encoded with one space
before it. A piece that scores less than the best way to spell it with shorter pieces is in no best segmentation, so the lattice
leaves it out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import unitcodes
from .lineage import cut, release
from .textops import give_back, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units of more bytes are folded block by block; a text without cuts cannot grow a group of edges.
LONG = 64
#: Characters of a block of a long unit.
BLOCK = 64
#: Substrings of up to so many characters are looked up everywhere, longer ones where a longer piece can end.
COMMON = 5
#: Units whose edges one task groups: some hundred thousand edges, which need no spilling.
UNITS_A_TASK = 20_000
MARK = "▁"


@dataclass
class Model:
    ids: dict[bytes, int]  # normal pieces, the mark written as a space
    scores: dict[int, float]
    byte_ids: list[int]
    fallback: float  # score of one character that falls back to bytes
    spelled: list[bytes]  # the bytes of every id
    useful: dict[str, int]  # the pieces that a best segmentation can hold
    longest: int  # characters of those
    cuts: Cuts


@dataclass
class Cuts:
    """Which bytes stand side by side in a useful piece."""

    pairs: np.ndarray  # (65536,) pieces of two bytes
    triples: np.ndarray  # (2 ** 21,) one bit for each three bytes that some piece holds


def read_model(path: str = MODEL) -> Model:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids = {}, {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece.replace(MARK, " ").encode()] = i
            scores[i] = float(model.get_score(i))
    made = make_model(ids, scores, byte_ids)
    give_back()
    return made


def make_model(ids: dict[bytes, int], scores: dict[int, float], byte_ids: list[int]) -> Model:
    fallback = min(scores.values()) * 2 - 10.0
    spelled = [b""] * (max([*ids.values(), *byte_ids]) + 1)
    for piece, i in [*ids.items(), *((bytes([b]), i) for b, i in enumerate(byte_ids))]:
        spelled[i] = piece
    useful = useful_pieces({piece.decode(): i for piece, i in ids.items()}, scores, fallback)
    pairs, triples = np.zeros(65536, bool), np.zeros(1 << 24, bool)
    for piece in map(str.encode, useful):
        if len(piece) == 2:
            pairs[piece[0] << 8 | piece[1]] = True
        for i in range(len(piece) - 2):
            triples[piece[i] << 16 | piece[i + 1] << 8 | piece[i + 2]] = True
    return Model(ids, scores, byte_ids, fallback, spelled, useful, max(map(len, useful)), Cuts(pairs, np.packbits(triples)))


def useful_pieces(ids: dict[str, int], scores: dict[int, float], fallback: float) -> dict[str, int]:
    """The pieces that no chain of shorter pieces beats."""
    useful: dict[str, int] = {}
    for piece in sorted(ids, key=len):
        best = [0.0]
        for end in range(1, len(piece) + 1):
            ways = [best[end - 1] + fallback]
            for start in range(end):
                if end - start < len(piece) and (i := useful.get(piece[start:end])) is not None:
                    ways.append(best[start] + scores[i])
            best.append(max(ways))
        if len(piece) == 1 or best[-1] <= scores[ids[piece]]:
            useful[piece] = ids[piece]
    return useful


def units(cuts: Cuts, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each non-empty one, the starts and ends of their units, and each text's first unit.

    A place is no cut if its two bytes are a piece, or if the three bytes that end or begin around it are part of one: every longer piece
    that spans the place holds one of these. How a text is cut depends on the text alone.
    """
    full = np.flatnonzero(np.diff(offsets))
    data = np.insert(data, offsets[full], 32)
    offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    fronts = offsets[:-1][np.diff(offsets) > 0]
    code = data.astype(np.int32)
    code[1:] |= data[:-1].astype(np.int32) << 8
    spanned = cuts.pairs[code]
    code[2:] |= data[:-2].astype(np.int32) << 16
    held = (cuts.triples[code >> 3] >> (7 - (code & 7)).astype(np.uint8) & 1).astype(bool)
    held[fronts] = False
    held[np.minimum(fronts + 1, len(data) - 1)] = False
    spanned |= held
    spanned[:-1] |= held[1:]
    begin = ~spanned & ((data & 0xC0) != 0x80)
    begin[fronts] = True
    starts = np.flatnonzero(begin)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


def viterbi(model: Model, unit: bytes) -> list[int]:
    """The best segmentation of one unit over all pieces; ties go to the shorter last piece, as in `encode_units`."""
    text, longest = unit.decode(), max(map(len, model.ids))
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for end in range(1, len(text) + 1):
        choice = None
        for start in range(max(0, end - longest), end):
            part = text[start:end].encode()
            if (i := model.ids.get(part)) is not None:
                found = (best[start][0] + model.scores[i], start, [i])
            elif end - start == 1:
                found = (best[start][0] + model.fallback, start, [model.byte_ids[b] for b in part])
            else:
                continue
            choice = found if choice is None or found[:2] > choice[:2] else choice
        best.append(choice)
    out, end = [], len(text)
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return [i for ids in out[::-1] for i in ids]


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score): a fixed table of the model's size. Made with Arrow, so that no executor starts Python workers for it."""
    ids = list(model.useful.values())
    columns = {"piece": pa.array(list(model.useful), pa.string()), "id": pa.array(ids, pa.int32()), "score": pa.array([model.scores[i] for i in ids], pa.float64())}
    return spark.createDataFrame(pa.table(columns))


def _edges(spans: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(keys, edges): the pieces in `view`, in order of their ends. A piece ends among the last `own` characters of the view; of these,
    one without a piece is an edge of its own. Places count from `model.longest - 1` characters before them, or from the view's start where it
    is the unit's."""
    pieces = F.broadcast(piece_table(spans.sparkSession, model))
    tails = {piece[-COMMON:] for piece in model.useful if len(piece) > COMMON}
    longer = F.substring("view", F.col("stop") - COMMON + 1, COMMON).isin(*tails) & (F.col("stop") >= COMMON) if tails else F.lit(False)
    most = F.least(F.col("stop"), F.when(longer, F.lit(model.longest)).otherwise(F.lit(min(COMMON, model.longest))))
    edges = (
        spans.select(*keys, "view", "shift", F.explode(F.sequence(F.char_length("view") - F.col("own") + 1, F.char_length("view"))).alias("stop"))
        .select(*keys, "view", "shift", "stop", F.explode(F.sequence(F.lit(1), most)).alias("size"))
        .withColumn("piece", F.substring(F.col("view"), F.col("stop") - F.col("size") + 1, F.col("size")))
        .join(pieces, "piece", "left")
        .filter(F.col("id").isNotNull() | (F.col("size") == 1))
    )
    stop = F.col("stop") + F.col("shift")
    edge = F.struct(stop.alias("stop"), (stop - F.col("size")).alias("start"), F.coalesce("score", F.lit(model.fallback)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    return edges.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _step(best: Column, e: Column) -> Column:
    """best[p] is the best way to reach place p; edges come in order of their ends, so the last entry is under way."""
    found = F.array(F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start"), e["id"].alias("id")))
    better = F.get(found, F.lit(0))["score"] >= F.element_at(best, -1)["score"]
    return F.when(F.size(best) == e["stop"], F.concat(best, found)).when(better, F.concat(F.slice(best, F.lit(1), e["stop"]), found)).otherwise(best)


def _path(best: Column, at: Column, first: int, most: Column) -> Column:
    """(at, path): the path back from place `at` to place `first` or before it, in `most` steps at most."""

    def back(state: Column, _: Column) -> Column:
        """One piece further to the front of the path."""
        at = F.get(best, state["at"])
        piece = F.array(F.struct(at["id"].alias("id"), at["start"].alias("start")))
        return F.when(state["at"] > first, F.struct(at["start"].alias("at"), F.concat(piece, state["path"]).alias("path"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), most), F.struct(at.alias("at"), F.array().cast("array<struct<id: int, start: int>>").alias("path")), back)


def _ids(path: Column, text: Column, first: int, model: Model) -> Column:
    """The ids of a path; characters of `text`, which starts at place `first`, without a piece become byte pieces."""
    byte_ids = F.array(*[F.lit(i) for i in model.byte_ids])

    def spelled(p: Column) -> Column:
        """The byte pieces of the character where p starts."""
        code = F.hex(F.encode(F.substring(text, p["start"] - first + 1, F.lit(1)), "utf-8"))
        return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.get(byte_ids, F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int")))

    plain = F.transform(path, lambda p: p["id"])
    with_bytes = F.flatten(F.transform(path, lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(spelled(p))))
    return F.when(F.exists(path, lambda p: p["id"] < 0), with_bytes).otherwise(plain)


def _origin(places: int) -> Column:
    """The state before the first character, which stands at the last of so many places."""
    return F.array(*[F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id"))] * places)


def encode_units(distinct: DataFrame, model: Model) -> DataFrame:
    """distinct(unit) plus ids array<int>: explode, equi-join, group, fold. Units are dealt out once, before they are exploded;
    the broadcast join and the grouping keep that partitioning, so no edge is shuffled."""
    parts = max(1, -(-distinct.count() // UNITS_A_TASK))
    spans = distinct.repartition(parts, "unit").withColumns({"view": F.col("unit"), "own": F.char_length("unit"), "shift": F.lit(0)})
    folded = _edges(spans, ["unit"], model).select("unit", F.aggregate("edges", _origin(1), _step).alias("best"))
    length = F.char_length("unit")
    paths = folded.select("unit", _path(F.col("best"), length, 0, length)["path"].alias("path"))
    return paths.select("unit", _ids(F.col("path"), F.col("unit"), 0, model).alias("ids"))


def encode_long_units(distinct: DataFrame, model: Model) -> DataFrame:
    """As `encode_units`, for units of any length. Blocks of characters are dealt out, each with the characters before it that a piece may
    hold, and their edges are grouped; one row a unit then holds its blocks, and the fold keeps for each block the best ways to its
    places and the last places before it. Two hashes stand for a unit here."""
    before = model.longest - 1
    size = max(BLOCK, before)
    chunks = distinct.select(F.xxhash64("unit").alias("h"), F.xxhash64(F.lit(1), "unit").alias("g"), F.regexp_extract_all("unit", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("chunks"))
    each = F.transform("chunks", lambda x, i: F.struct(i.alias("block"), x.alias("own"), F.when(i > 0, F.right(F.get(F.col("chunks"), i - 1), F.lit(before))).otherwise("").alias("lead")))
    blocks = chunks.select("h", "g", F.explode(each).alias("x")).select("h", "g", "x.block", F.col("x.own").alias("text"), F.col("x.lead").alias("lead"))
    spans = blocks.repartition("h", "g", "block").withColumns({"view": F.concat("lead", "text"), "own": F.char_length("text"), "shift": F.lit(before) - F.char_length("lead")})
    block = F.struct("block", "text", "edges")
    grouped = _edges(spans, ["h", "g", "block", "text"], model).groupBy("h", "g").agg(F.sort_array(F.collect_list(block)).alias("blocks"))

    def step(bests: Column, b: Column) -> Column:
        former = F.slice(F.element_at(bests, -1), -model.longest, model.longest)
        return F.concat(bests, F.array(F.aggregate(b["edges"], former, _step)))

    def back(paths: Column, best: Column) -> Column:
        """The path through one block further to the front; it ends where the path of the block behind it begins."""
        at = F.when(F.size(paths) == 0, F.size(best) - 1).otherwise(F.get(paths, F.lit(0))["at"] + size)
        return F.concat(F.array(_path(best, at, before, F.lit(size))), paths)

    bests = F.slice(F.aggregate("blocks", F.array(_origin(model.longest)), step), F.lit(2), F.size("blocks"))
    none = F.array().cast("array<struct<at: int, path: array<struct<id: int, start: int>>>>")
    paths = grouped.select("blocks", bests.alias("bests")).select("blocks", F.aggregate(F.reverse("bests"), none, back).alias("paths"))
    ids = F.flatten(F.zip_with("paths", "blocks", lambda p, b: _ids(p["path"], b["text"], before, model)))
    return paths.select(F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("unit"), ids.alias("ids"))


def decode(encoded: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """(keys, ids, text) for every row of encoded(keys, ids): ids are exploded, equi-joined to the pieces' bytes and put together
    in order. A partitioning by the keys is kept."""
    ids = [i for i, piece in enumerate(model.spelled) if piece]
    table = pa.table({"id": pa.array(ids, pa.int32()), "spelled": pa.array([model.spelled[i].hex() for i in ids], pa.string())})
    spelled = F.broadcast(encoded.sparkSession.createDataFrame(table))
    parts = encoded.select(*keys, F.posexplode_outer("ids").alias("place", "id")).join(spelled, "id")
    grouped = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "id", "spelled"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["spelled"]), "")
    return grouped.select(*keys, F.transform("parts", lambda p: p["id"]).alias("ids"), F.decode(F.unhex(joined), "utf-8").alias("text"))


def unit_codes(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(distinct, codes): the units (unit, n) of all texts with their numbers, and (unit, ids, ok) with their encodings, ok if a unit
    decodes to itself."""
    distinct = unitcodes.distinct_units(docs, partial(units, model.cuts))
    bytes_ = F.octet_length("unit")
    back = decode(encode_units(distinct.filter(bytes_ <= LONG).select("unit"), model), model, ["unit"])
    coded = cut(encode_long_units(distinct.filter(bytes_ > LONG).select("unit"), model))
    long = decode(coded.select(F.xxhash64("unit").alias("h"), F.xxhash64(F.lit(1), "unit").alias("g"), "ids"), model, ["h", "g"])
    whole = coded.join(long.select("h", "g", "text"), (F.xxhash64("unit") == F.col("h")) & (F.xxhash64(F.lit(1), "unit") == F.col("g")))
    codes = cut(back.unionByName(whole.select("unit", "ids", "text")).select("unit", "ids", (F.col("text") == F.col("unit")).alias("ok")))
    release(docs.sparkSession)
    return distinct, codes


def encode_documents(docs: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(encoded, codes). encoded: every row of docs, its text replaced by n_bytes, n_pieces (long), ids (array<int>, in order),
    decoded (string, the text rebuilt from the ids alone) and round_trip (boolean); codes: (unit, ids) of every distinct unit.

    Whole texts, of any length; null and empty texts have no pieces, are decoded to themselves and have round_trip true; repeated rows are encoded
    each, no rows give none. Each distinct unit is encoded once, whatever the number of documents that hold it. Where docs has a
    column of one of the five names, the new one gets an underscore.
    """
    small_batches(docs.sparkSession)
    split = partial(units, model.cuts)
    distinct, codes = unit_codes(docs, model)
    return unitcodes.put_together(docs, distinct, codes, split, model.spelled, lead=True), codes.select("unit", "ids")


def decode_ids(model: Model, ids: list[int]) -> bytes:
    return b"".join(model.spelled[i] for i in ids)
