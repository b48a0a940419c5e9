"""Texts as sequences of known units: every distinct unit of a corpus is encoded once, and documents are put together from its code.

A tokenizer gives `split`, which cuts texts into units that can be encoded one by one, and a table (unit, ids, ok) with the encoding of
every distinct unit; ok says that the unit decodes to itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, release
from .textops import BLOCK_BYTES, give_back, prefix_hash, small_batches, span_hash, text_blocks, unused

#: Encodings of so many of the most frequent units are sent to every task; all others are joined.
FREQUENT = 1 << 17
#: Bytes of a unit in that table; of the longer ones, up to SOME bytes, there are FREQUENT / 512.
LONG, SOME = 64, 1 << 14
OUTPUTS = ("n_bytes", "n_pieces", "ids", "decoded", "round_trip")

#: (bytes, offsets of texts) -> (bytes, starts and ends of the units, each text's first unit).
Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every unit, which together stand for it inside a task."""
    return tuple(span_hash(prefix_hash(data, k), starts, ends, k).astype(np.int64) for k in (0, 1))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def packed(codes: np.ndarray) -> bytes:
    """Codes of one document's units, byte planes one after another, compressed."""
    return pa.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * size, codec="zstd"), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())


def distinct_units(docs: DataFrame, split: Split) -> DataFrame:
    """(unit, n): every unit of all texts and how often it stands in them."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column("text")):
                data, starts, ends, _ = split(data, offsets)
                h, g = unit_hashes(data, starts, ends)
                order = np.lexsort((g, h))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
                heads = np.flatnonzero(new)
                numbers = np.diff(np.append(heads, len(order)))
                yield pa.RecordBatch.from_arrays([strings(data, starts, ends, order[heads]), pa.array(numbers)], ["unit", "n"])

    return cut(docs.select("text").mapInArrow(collect, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(n, ...) whose n reaches the lowest level that no more than `most` rows reach. Levels are steps of an eighth of a doubling,
    so their histogram is a few hundred rows, and no task has to order all rows."""
    level = F.floor(F.log2("n") * 8).cast("int")
    seen = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    least, rows = None, 0
    for r in seen:
        rows += r.rows
        if rows > most:
            break
        least = r.level
    return counts.filter(F.lit(False) if least is None else level >= least)


def put_together(docs: DataFrame, distinct: DataFrame, codes: DataFrame, split: Split, pieces: list[bytes], lead: bool) -> DataFrame:
    """Every row of docs, its text replaced by n_bytes, n_pieces (long), ids (array<int>, in order), decoded (string, the text rebuilt
    from the ids alone) and round_trip (boolean: decoded has the text's length and hash, and all of its units decode to themselves).

    distinct(unit, n) and codes(unit, ids, ok) cover all units; pieces[id] are the bytes of an id; with `lead`, split puts one byte before
    every text that is not empty, which decoded loses again. The most frequent encodings reach every task as a fixed-size table. Each text's
    rarer units are joined to their encodings and gathered by two hashes of the text, once for equal texts; a document is shuffled as
    compressed numbers of its units, and its ids are put together beyond the join. Where docs has a column of one of the five names, the new one
    gets an underscore.
    """
    base, spark = docs, docs.sparkSession
    bytes_ = F.octet_length("unit")
    top = most_frequent(distinct.filter(bytes_ <= LONG), FREQUENT).unionByName(most_frequent(distinct.filter((bytes_ > LONG) & (bytes_ <= SOME)), FREQUENT >> 9))
    table = codes.join(F.broadcast(top), "unit").select("unit", "ids", "ok").toArrow().combine_chunks()
    known = _known(table)
    lookup = spark.sparkContext.broadcast(known[:4])
    encodings = spark.sparkContext.broadcast(known[4:])
    least = table.num_rows
    del table, known
    give_back()

    def numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the units of all texts their places in the known table, or `least` plus the place among the text's own rarer units in order of
        their hashes; each text's first unit; whether all known ones are good; text, place and name of the rarer units."""
        hs, gs, places, oks = lookup.value
        data, starts, ends, first = split(data, offsets)
        h, g = unit_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(hs, h), max(0, least - 1))
        hit = (hs[at] == h) & (gs[at] == g) if least else np.zeros(len(h), bool)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rare = np.flatnonzero(~hit)
        order = rare[np.lexsort((g[rare], h[rare], owner[rare]))]
        new = np.ones(len(order), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        heads = order[new]
        bounds = np.searchsorted(owner[heads], np.arange(len(first)))
        code, wrong = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        code[hit], wrong[hit] = places[at[hit]], ~oks[at[hit]]
        code[order] = least + np.cumsum(new) - 1 - bounds[owner[order]]
        wrong = np.concatenate(([0], np.cumsum(wrong)))[first]
        return code, first, wrong[1:] == wrong[:-1], owner[heads], code[heads] - least, lambda: strings(data, starts, ends, heads)

    def rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch.column("text")):
                *_, owner, k, names = numbers(data, offsets)
                take = pa.array(owner + rows.start)
                yield pa.RecordBatch.from_arrays([batch.column("mark").take(take), batch.column("mark2").take(take), pa.array(k.astype(np.int32)), names()], ["mark", "mark2", "k", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch.column("text")):
                code, first, good, *_ = numbers(data, offsets)
                coded = [packed(code[s:e]) if e > s else b"" for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                own = [batch.column(c).slice(rows.start, len(good)) for c in ("held", "absent", "mark", "mark2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets)), pa.array(good), pa.array(np.diff(first)), pa.array(coded, pa.binary())], ["held", "absent", "mark", "mark2", "n_bytes", "good", "n_units", "packed"])

    spelled = pa.array(pieces, pa.binary())

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        froms, lengths, ids = encodings.value
        n_units = batch.column("n_units").to_numpy()
        parts = [unpacked(p, n) if n else np.zeros(0, np.int64) for p, n in zip(batch.column("packed").to_pylist(), n_units.tolist(), strict=True)]
        code = np.concatenate([np.zeros(0, np.int64), *parts])
        # The rarer units of all rows stand one row after another behind the known ones.
        found = batch.column("found")
        many = pc.fill_null(found.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        code += np.where(code >= least, np.repeat(np.cumsum(many) - many, n_units), 0)
        if len(code) and code.max() >= least + many.sum():
            raise ValueError("a unit has no encoding")
        lists = found.flatten().field("ids")
        own = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        froms = np.concatenate((froms, len(ids) + np.cumsum(own) - own))
        lengths = np.concatenate((lengths, own))
        upto = np.concatenate(([0], np.cumsum(lengths[code])))[np.concatenate(([0], np.cumsum(n_units)))]
        ids = ragged(np.concatenate((ids, lists.flatten().to_numpy(zero_copy_only=False))), froms[code], lengths[code]).astype(np.int32)
        parts = spelled.take(pa.array(ids))
        text_ends = np.concatenate(([0], np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False))))[upto].astype(np.int64)
        # What split put before every text that is not empty goes again.
        full = (np.diff(text_ends) > 0) & lead
        data = np.delete(np.frombuffer(parts.buffers()[2] or b"", np.uint8)[: text_ends[-1]], text_ends[:-1][full])
        text_ends = (text_ends - np.concatenate(([0], np.cumsum(full)))).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(text_ends.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
        texts = pc.if_else(batch.column("absent"), pa.scalar(None, pa.string()), texts)
        kept = [batch.column(c) for c in ("held", "mark", "n_bytes", "good")]
        lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(upto)), lists, texts], ["held", "mark", "n_bytes", "good", "n_pieces", "ids", "decoded"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of all units in their order, and the text that they spell."""
        for batch in batches:
            low, ends = 0, np.cumsum(batch.column("n_bytes").to_numpy())
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, "right")))
                yield whole(batch.slice(low, high - low))
                low = high
            give_back()

    held = F.struct(*[F.col(c) for c in base.columns if c != "text"])
    keyed = base.select("text", held.alias("held"), F.col("text").isNull().alias("absent"), F.xxhash64("text").alias("mark"), F.hash("text").alias("mark2"))
    kind = keyed.schema["held"].dataType.simpleString()
    asked = keyed.select("mark", "mark2", "text").mapInArrow(rarer, "mark long, mark2 int, k int, unit string")
    gathered = asked.join(codes, "unit").groupBy("mark", "mark2")
    found = cut(gathered.agg(F.sort_array(F.collect_set(F.struct("k", "ids"))).alias("found"), F.min("ok").alias("all_ok")))
    release(spark)
    coded = keyed.mapInArrow(pack, f"held {kind}, absent boolean, mark long, mark2 int, n_bytes long, good boolean, n_units long, packed binary")
    none = F.array().cast("array<struct<k: int, ids: array<int>>>")
    joined = coded.join(found, ["mark", "mark2"], "left").select(
        "held", "absent", "mark", "n_bytes", (F.col("good") & F.coalesce("all_ok", F.lit(True))).alias("good"), "n_units", "packed", F.coalesce("found", none).alias("found")
    )
    filled = joined.mapInArrow(fill, f"held {kind}, mark long, n_bytes long, good boolean, n_pieces long, ids array<int>, decoded string")
    same = F.col("good") & (F.xxhash64("decoded") == F.col("mark")) & (F.coalesce(F.octet_length("decoded"), F.lit(0)) == F.col("n_bytes"))
    outputs = [*map(F.col, ("n_bytes", "n_pieces", "ids", "decoded")), same]
    return filled.select("held.*", *[c.alias(unused(n, base.columns)) for c, n in zip(outputs, OUTPUTS, strict=True)])


def _known(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The known units in order of their hashes: both hashes, their places in the table, whether they decode; then where the table's
    encodings begin, their lengths, and all of them one after another."""
    if not table.num_rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool), none, none, none.astype(np.int32)
    units, lists = table.column("unit").combine_chunks(), table.column("ids").combine_chunks()
    (_, data, offsets), = text_blocks(units, 1 << 62)
    h, g = unit_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(h, kind="stable")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return h[order], g[order], order.astype(np.int32), table.column("ok").to_numpy()[order], (np.cumsum(lengths) - lengths).astype(np.int32), lengths.astype(np.int32), lists.flatten().to_numpy(zero_copy_only=False)
