"""Repeated byte strings: exact removal of every string of LENGTH bytes that also starts anywhere else.

Phrases. Every window of LENGTH bytes has an anchor, the k-gram in it with the least hash; equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a fragment, and equal fragments are one phrase with a multiplicity, as in
prefix-free parsing: the transform of a repetitive corpus is built from its different phrases. A phrase whose anchor occurs once holds no
repeat; a phrase that occurs twice repeats as a whole; different phrases that share an anchor need their bytes compared.

Comparison. A task takes the phrases of some anchors and builds a run-length index: suffixes are sorted, the Burrows-Wheeler transform is
kept as runs, and only the suffixes at run ends are sampled, with the match lengths between neighbouring runs. Between two samples a match
shrinks by one byte for every byte of text, so one pass over the text streams the longest match of every suffix with any other
(matching statistics), and those of at least LENGTH bytes are marked.

An anchor with very many different phrases (a passage that a third of all documents quote, each in words of its own) is
split by ever longer cores that all windows of a part share, until its parts are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut, discard, release
from .textops import give_back, mix, prefix_hash, small_batches, span_hash, text_blocks, unused

LENGTH, ANCHOR = 200, 48
#: Different fragments of one anchor from which on it is split, and sizes (in windows) of the parts.
HOT, SPLITS = 2048, (31, 7, 2, 1)
#: Bytes that one index covers on average.
INDEX_BYTES = 1 << 20
#: Indexes that one task builds one after another.
BUCKETS_A_TASK = 4
SEPARATOR = 0xFF  # no byte of a UTF-8 text


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by block prefixes and suffixes."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def fragments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Fragments of all texts: text, start, windows, at (place of the anchor in it), h (anchor), c (content), times.

    start and c refer to the block's bytes; every window of every text lies in exactly one fragment. Equal fragments that follow
    each other, as in a run of one byte, are one row that stands `times` times, each `windows` bytes behind the last.
    """
    names = ("text", "start", "windows", "at", "h", "c", "times")
    if len(data) < length:
        return {k: np.zeros(0, np.int64) for k in names}
    prefix = prefix_hash(data)
    grams = np.arange(len(data) - anchor + 1)
    hashes = span_hash(prefix, grams, grams + anchor)
    low = np.uint64(0xFFFFFFFF)
    place = (window_minima((hashes & ~low) | grams.astype(np.uint64), length - anchor + 1) & low).astype(np.int64)
    windows = np.arange(len(place))
    text = np.searchsorted(offsets, windows, "right") - 1
    whole = windows + length <= offsets[text + 1]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    number = np.cumsum(fresh) - 1
    count = np.bincount(number[whole], minlength=int(number[-1]) + 1)
    start = np.flatnonzero(fresh)[count > 0]
    count = count[count > 0]
    c = span_hash(prefix, start, start + count - 1 + length)
    columns = (text[start], start, count, place[start] - start, hashes[place[start]], c)
    again = np.zeros(len(start), bool)
    again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in columns[:1] + columns[2:]])
    heads = np.flatnonzero(~again)
    return dict(zip(names, (*(x[heads] for x in columns), np.diff(np.append(heads, len(start)))), strict=True))


def sorted_suffixes(text: np.ndarray, words: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order of their first `longest` bytes, from their first eight bytes (`words`). Ranks of one length are joined to ranks of
    three times that length, of twice that length where three ranks do not fit a key."""
    n = len(text)
    bits = 21 if n < 1 << 21 else 32
    key, step, joined = words, 8, 64 // bits
    while True:
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.zeros(n, np.int32)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(fresh, dtype=np.int32) + 1
        if step >= longest or rank.max() == n:
            return order
        key = rank.astype(np.uint64)
        for k in range(1, joined):
            key <<= np.uint64(bits)
            key[: max(0, n - k * step)] |= rank[k * step :].astype(np.uint64)
        step *= joined


class RunIndex:
    """Run-length index of some byte strings: the runs of their Burrows-Wheeler transform (symbols and lengths), the suffixes at the runs'
    heads and tails, and the match length between each run's tail and the next one's head. The suffix array itself is not kept."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in strings), np.uint8)
        sizes = np.array([len(s) + 1 for s in strings])
        self.starts = np.cumsum(sizes) - sizes
        self.left = np.repeat(self.starts + sizes - 1, sizes) - np.arange(len(self.text))  # bytes to the separator
        # Strings differ, so no two places agree over a whole string and its separators: matches end within two strings' length.
        n, longest = len(self.text), 2 * int(sizes.max())
        padded, words = np.concatenate((self.text, np.zeros(8, np.uint8))), np.zeros(n, np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | padded[j : j + n]
        order = sorted_suffixes(self.text, words, longest)
        before = np.where(order > 0, self.text[order - 1], SEPARATOR - 1)
        bounds = np.concatenate(([0], np.flatnonzero(before[1:] != before[:-1]) + 1, [n]))
        self.symbols, self.lengths = before[bounds[:-1]], np.diff(bounds)
        self.heads, self.tails = order[bounds[:-1]], order[bounds[1:] - 1]
        self.matches = self._matches(words, self.tails[:-1], self.heads[1:], longest)

    @staticmethod
    def _matches(words: np.ndarray, a: np.ndarray, b: np.ndarray, longest: int) -> np.ndarray:
        """Common prefixes of the suffixes a and b, eight bytes at a time; they may run on into the next strings."""
        total, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for done in range(0, longest, 8):
            x, y = a[open_] + done, b[open_] + done
            inside = (x < len(words)) & (y < len(words))
            open_, x, y = open_[inside], x[inside], y[inside]
            differ = words[x] ^ words[y]
            for k in range(1, 9):
                total[open_] += differ >> np.uint64(64 - 8 * k) == 0
            open_ = open_[differ == 0]
            if not len(open_):
                break
        return total

    def statistics(self) -> np.ndarray:
        """For every position, the longest match of the suffix there with any other suffix, within its string."""
        reach = np.zeros(len(self.text), np.int64)
        for at in (self.tails[:-1], self.heads[1:]):
            np.maximum.at(reach, at, at + self.matches)
        return np.minimum(np.maximum.accumulate(reach) - np.arange(len(self.text)), self.left)

    def repeated(self, number: int, windows: int, length: int) -> np.ndarray:
        """Which of the first `windows` windows of one string start anywhere else."""
        if not hasattr(self, "_long"):
            self._long = self.statistics() >= length
        at = self.starts[number]
        return self._long[at : at + windows]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]


_ITEM = "key binary, start long, windows int, at int, h long, c long"


def _collect(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch.column("text")):
            f = fragments(data, offsets, length)
            arrays = [
                batch.column("key").take(pa.array(f["text"] + rows.start)), pa.array(f["start"] - offsets[f["text"]]), pa.array(f["windows"].astype(np.int32)),
                pa.array(f["at"].astype(np.int32)), pa.array(f["h"].astype(np.int64)), pa.array(f["c"].astype(np.int64)), pa.array(f["times"].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "start", "windows", "at", "h", "c", "times"])


def packed(texts: Column) -> Column:
    """Texts as compressed bytes, with their size before them: half of what a shuffle would write."""

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        raw = values.cast(pa.binary()).to_pylist()
        return pa.array([None if x is None else len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())

    return pack(texts)


def unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _extract(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of listed fragments of texts."""
    for batch in batches:
        for r in range(len(batch)):
            text = unpacked(batch.column("packed")[r].as_py())
            items = batch.column("items")[r].values.flatten()
            start, windows = items[0].to_numpy(), items[1].to_numpy()
            parts = [text[s : s + m - 1 + length] for s, m in zip(start.tolist(), windows.tolist(), strict=True)]
            key = batch.column("key").take(pa.array(np.full(len(parts), r)))
            yield pa.RecordBatch.from_arrays([key, *items, pa.array(parts, pa.binary())], ["key", "start", "windows", "at", "h", "c", "n", "part"])


def _split(batches: Iterator[pa.RecordBatch], size: int, length: int) -> Iterator[pa.RecordBatch]:
    """Cut fragments into parts whose windows start `size` places at most from each other, counted from the anchor. A part's
    anchor is the core that all windows at its places share."""
    for batch in batches:
        out = [[] for _ in range(8)]
        for row in batch.to_pylist():
            at, part = row["at"], row["part"]
            for cell in range((at - row["windows"] + 1) // size, at // size + 1):
                low, high = cell * size, cell * size + size - 1  # distances from a window's start to the anchor
                first, last = at - min(at, high), at - max(at - row["windows"] + 1, low)
                core = part[at - low : at - high + length] if at >= high else part[max(0, at - low) : max(0, at - high + length)]
                own = part[first : last + length]
                pair = np.frombuffer(core, np.uint8), np.frombuffer(own, np.uint8)
                core_hash, own_hash = (int(span_hash(prefix_hash(x), np.zeros(1, np.int64), np.array([len(x)]))[0].astype(np.int64)) for x in pair)
                anchor = int(mix(np.array([row["h"], core_hash, cell], np.int64).astype(np.uint64) * np.array([3, 5, 7], np.uint64)).sum().astype(np.int64))
                for column, value in zip(out, (row["key"], row["start"] + first, last - first + 1, at - first, anchor, own_hash, row["n"], own), strict=True):
                    column.append(value)
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["key", "start", "windows", "at", "h", "c", "n", "part"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, windows): runs of repeated windows of the texts in docs(key, text); equal texts may share a key.

    The runs are a table of their own, so that what reads them next to the texts holds nothing of the search; fragments with their bytes are
    dealt out twice: once to keep one of each content, once to the indexes.
    """
    found = cut(docs.filter(F.octet_length("text") >= length).mapInArrow(lambda b: _collect(b, length), _ITEM + ", times int"))
    # Written, so that a join can split an anchor that very many fragments share.
    anchors = found.groupBy("h").agg(F.sum("times").alias("total"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter(F.col("total") > 1)
    anchors = cut(anchors.select("h", (F.col("c1") == F.col("c2")).alias("pure")))
    shared = cut(found.join(anchors, "h").withColumn("whole", (F.col("windows") * F.col("times"))))
    discard(found, anchors)
    release(docs.sparkSession)
    spans = [shared.filter("pure").select("key", "start", F.col("whole").alias("windows"))]
    mixed = shared.filter(~F.col("pure"))
    contents = mixed.groupBy("h", "c").agg(F.sum("times").alias("n"), F.min(F.struct("key", "start", "windows", "at")).alias("one"))
    contents = cut(contents)
    again = contents.filter("n > 1").select("h", "c")
    spans.append(mixed.join(again, ["h", "c"], "left_semi").select("key", "start", F.col("whole").alias("windows")))
    # One fragment of every different content, with its bytes.
    listed = contents.select("one.*", "h", "c", "n").groupBy("key").agg(F.collect_list(F.struct("start", "windows", "at", "h", "c", "n")).alias("items"))
    schema = _ITEM + ", n long, part binary"
    items = cut(docs.select("key", packed(F.col("text")).alias("packed")).join(listed, "key").mapInArrow(lambda b: _extract(b, length), schema).dropDuplicates(["h", "c"]))
    release(docs.sparkSession)
    written = [shared, contents, items]
    for size in SPLITS:
        # At most one anchor for HOT fragments, so they are sent to the fragments.
        hot = cut(items.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > HOT).select("h"))
        written.append(hot)
        if hot.isEmpty():
            spans.append(_index(items, length))
            break
        spans.append(_index(items.join(F.broadcast(hot), "h", "left_anti"), length))
        parts = cut(items.join(F.broadcast(hot), "h", "left_semi").mapInArrow(lambda b, s=size: _split(b, s, length), schema))
        same = parts.groupBy("h", "c").agg(F.sum("n").alias("all"), F.min(F.struct("key", "start", "windows", "at", "part")).alias("one"))
        same = cut(same)
        repeated = same.filter("all > 1").select("h", "c")
        spans.append(parts.filter("n = 1").join(repeated, ["h", "c"], "left_semi").select("key", "start", "windows"))
        some = same.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1").select("h")
        items = cut(same.join(some, "h", "left_semi").select("one.key", "one.start", "one.windows", "one.at", "h", "c", F.col("all").alias("n"), "one.part"))
        written += [parts, same, items]
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    out = cut(out)
    discard(*written)
    release(docs.sparkSession)
    return out


def _index(items: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the fragments that occur once, by run-length indexes over buckets of anchors."""
    total = items.agg(F.sum(F.length("part"))).first()[0] or 0
    buckets = max(1, -(-total // INDEX_BYTES))

    def search(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        key, start, windows, n = (table.column(c).to_pylist() for c in ("key", "start", "windows", "n"))
        index = RunIndex(parts)
        out = [(key[i], start[i] + s, m) for i in range(len(parts)) if n[i] == 1 for s, m in _runs(index.repeated(i, windows[i], length))]
        del index
        give_back()
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()), strict=True)], ["key", "start", "windows"])

    # Some buckets a task, however few bytes they have on the wire.
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(int(buckets)))).repartition(max(1, -(-buckets // BUCKETS_A_TASK)), "bucket")
    return dealt.groupBy("bucket").applyInArrow(search, "key binary, start long, windows int")


OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept")


def row_key(*columns: str) -> Column:
    """128 bits for the values of columns, as text: each with its length before it, so that no two rows of different values (null among them) are
    written alike."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])))


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """docs, its text packed, with each row's repeated runs, and the name of their column."""
    small_batches(docs.sparkSession)
    key, listed = (unused(c, docs.columns) for c in ("key", "spans"))
    # 128 bits stand for doc_id and text. Rows with one key are one row repeated; each repetition is a place of its own.
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    spans = repeated_spans(keyed.select(F.col(key).alias("key"), "text"), length)
    per_doc = spans.groupBy("key").agg(F.collect_set(F.struct("start", "windows")).alias(listed)).withColumnRenamed("key", key)
    return keyed.withColumn("text", packed(F.col("text"))).join(per_doc, key, "left"), listed


def _covered(text: pa.Scalar, runs: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a packed text, and which of them its repeated runs cover."""
    data = np.frombuffer(unpacked(text.as_py()) if text.is_valid else b"", np.uint8)
    change = np.zeros(len(data) + 1, np.int64)
    if runs.is_valid:
        start, windows = (x.to_numpy() for x in runs.values.flatten())
        np.add.at(change, start, 1)
        np.add.at(change, start + windows - 1 + length, -1)
    return data, np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, ...) plus n_bytes, n_removed, n_spans (long) and kept (binary: the remaining bytes).

    Every byte covered by a string of `length` bytes that also starts anywhere else, in the same document or another, is
    removed; strings are judged on the input. Null text counts as empty; repeated rows repeat each other, with a null doc_id too; a
    table without repeats comes back whole, an empty one empty. Texts of any length are whole, one to a task's block if they are long. Existing
    columns of the four names are replaced.
    """
    base = docs.drop(*OUTPUTS)
    joined, listed = _with_spans(base, length)
    out = unused("out", joined.columns)

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def apply(texts: pa.Array, lists: pa.Array) -> pa.Array:
        size, gone, runs, kept = [], [], [], []
        for text, spans in zip(texts, lists, strict=True):
            data, covered = _covered(text, spans, length)
            size.append(len(data))
            gone.append(int(covered.sum()))
            runs.append(len(_runs(covered)))
            kept.append(data[~covered].tobytes())
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    @F.arrow_udf("string")
    def unpack(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unpacked(x) for x in texts.to_pylist()], pa.binary()).cast(pa.string())

    joined = joined.withColumn(out, apply(F.col("text"), F.col(listed)))
    return joined.select(*[unpack(F.col(c)).alias(c) if c == "text" else F.col(c) for c in base.columns], *[F.col(out)[c].alias(c) for c in OUTPUTS])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text, ...) with what `remove_repeats` leaves of each text, less what is left of characters that were cut in two, plus
    n_removed (long: the bytes that repeats covered). A text without repeats stays as it is, null too. An existing n_removed is replaced.

    One Python worker does it all for a row. The function counts as not deterministic, as a filter on its results would otherwise be pushed below
    them, and every text be unpacked and cut once for the filter and again for its result, in more workers of one task.
    """
    base = docs.drop("n_removed")
    joined, listed = _with_spans(base, length)
    out = unused("out", joined.columns)

    @F.arrow_udf("text string, n_removed long")
    def apply(texts: pa.Array, lists: pa.Array) -> pa.Array:
        gone, left = [], []
        for text, spans in zip(texts, lists, strict=True):
            data, covered = _covered(text, spans, length)
            gone.append(int(covered.sum()))
            rest = data[~covered].tobytes()
            left.append(None if not text.is_valid else rest.decode("utf-8", "ignore").encode() if gone[-1] else rest)
        return pa.StructArray.from_arrays([pa.array(left, pa.binary()).cast(pa.string()), pa.array(gone, pa.int64())], ["text", "n_removed"])

    joined = joined.withColumn(out, apply.asNondeterministic()(F.col("text"), F.col(listed)))
    return joined.select(*[F.col(out)["text"].alias(c) if c == "text" else F.col(c) for c in base.columns], F.col(out)["n_removed"].alias("n_removed"))


#: Every string of 200 bytes, written as 400 hexadecimal digits, with the number of its places; the bytes that repeated ones cover.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (
  SELECT r, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT r, x, unnest(range(greatest(0, len(x) // 2 - {LENGTH - 1}))) AS i FROM d)
), m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w SEMI JOIN m USING (h)),
g AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
spans AS (SELECT r, g, min(i) AS low, max(i) + {LENGTH} AS high FROM g GROUP BY r, g),
gaps AS (
  SELECT r, high AS low, lead(low) OVER (PARTITION BY r ORDER BY g) AS high FROM spans
  UNION ALL SELECT r, 0, min(low) FROM spans GROUP BY r
), kept AS (
  SELECT d.r, string_agg(substr(x, (2 * coalesce(low, 0) + 1)::BIGINT, (2 * (coalesce(high, len(x) // 2) - coalesce(low, 0)))::BIGINT), '' ORDER BY low) AS x
  FROM d LEFT JOIN gaps USING (r) GROUP BY d.r
), sums AS (SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
