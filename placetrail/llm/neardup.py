"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A signature has CHUNKS * LANES minima of LANE_BITS bits, LANES of them packed in one long. Two signatures that differ in
at most 2 * CHUNKS - 1 = 23 lanes agree, by the pigeonhole principle, in some chunk up to one lane; so a document is filed
under every chunk with every one lane left out, and all pairs within that distance meet, so all pairs within MOST_DIFFERENT.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lineage import cut, discard, release
from .textops import fold_case, give_back, mix, per_text, prefix_hash, small_batches, span_hash, text_blocks, word_spans

WORDS, LEAST_PERCENT = 5, 75
CHUNKS, LANES, LANE_BITS = 12, 3, 20
#: Lanes in which a candidate pair may differ; at similarity 0.75, 9 of 36 differ on average, 22 or more in 5 of a million pairs.
MOST_DIFFERENT = 21
#: Members of a bucket's largest component that are tried for every outsider before all pairs are.
PARTNERS = 4
#: Bytes of the finer signature of bucketed documents, and how many of them may differ: at similarity 0.75 a quarter do on
#: average, and more than this in 5 of a million pairs.
FINE, FINE_DIFFERENT = 1024, 318
#: Outsiders of one block, and rows of one task's group on average.
PROBES, GROUP_ROWS = 8192, 4096
#: Rows of one block where a bucket's rows are compared with each other.
BLOCK = 1024
#: Pairs whose signatures are laid side by side at a time.
PAIRS = 4096

_LANE = (1 << LANE_BITS) - 1
_LOW = sum((_LANE >> 1) << (LANE_BITS * i) for i in range(LANES))
_TOP = sum(1 << (LANE_BITS * i + LANE_BITS - 1) for i in range(LANES))
_FACTORS = mix(np.arange(1, CHUNKS * LANES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_FINE_FACTORS = mix(np.arange(1001, 1001 + FINE, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, repeats included, and each text's first one. A text of fewer than
    WORDS words has one shingle, its whole sequence; a text without words has none."""
    low = fold_case(data)
    starts, ends, first = word_spans(low, offsets)
    words = span_hash(prefix_hash(low), starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], sizes)
    length = np.repeat(np.minimum(counts, WORDS), sizes)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    out = length.astype(np.uint64)
    for j in range(WORDS):
        out = np.where(length > j, mix(out * _STEP + padded[at + j]), out)
    return out, bounds


def distinct_sets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, and each text's first one."""
    sets = [np.unique(hashes[s:e]) for s, e in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(sets) if sets else hashes, np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, CHUNKS) packed minima; zeros for a text without shingles."""
    out = np.zeros((len(first) - 1, CHUNKS), np.int64)
    for k, factor in enumerate(_FACTORS):
        least = per_text((hashes ^ (factor >> np.uint64(7))) * factor, first, np.minimum)
        lane = (mix(least) >> np.uint64(64 - LANE_BITS)).astype(np.int64)
        out[:, k // LANES] |= lane << (LANE_BITS * (k % LANES))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch.column("text")):
            own, first = distinct_sets(*shingles(data, offsets))
            low, high = (per_text(mix(own * f), first, np.add).astype(np.int64) for f in _FACTORS[:2])
            packed = signatures(own, first)
            lists = pa.ListArray.from_arrays(np.arange(0, packed.size + 1, CHUNKS, dtype=np.int32), pa.array(packed.ravel()))
            ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(low), pa.array(high), lists], ["doc_id", "n", "low", "high", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks(batch.column("text")):
            own, first = distinct_sets(*shingles(data, offsets))
            lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(own.astype(np.int64)))
            ids = batch.column("doc_id").slice(rows.start, rows.stop - rows.start)
            fine = np.empty((len(first) - 1, FINE), np.uint8)
            for k, factor in enumerate(_FINE_FACTORS):
                fine[:, k] = mix(per_text((own ^ (factor >> np.uint64(7))) * factor, first, np.minimum)) >> np.uint64(56)
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array([f.tobytes() for f in fine], pa.binary())], ["rep", "own", "fine"])


def _cross(table: pa.Table) -> pa.Table:
    """Near pairs (u, v) between the outsiders and the rows of every bucket block: of different components, of close sizes and
    signatures, each pair under the first key that both share."""
    key, block, pblock, rep, part, n, tag = (table.column(c).to_numpy() for c in ("key", "block", "pblock", "rep", "part", "n", "tag"))
    probe = table.column("probe").to_numpy().astype(bool)
    packed = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, CHUNKS)
    lanes = np.stack([(packed[:, k // LANES] >> (LANE_BITS * (k % LANES))) & _LANE for k in range(CHUNKS * LANES)], 1).astype(np.uint32)
    fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE)
    order = np.lexsort((pblock, block, key))
    edge = np.flatnonzero(np.any(np.diff(np.stack([key, block, pblock])[:, order], axis=1) != 0, axis=0)) + 1
    out = [np.zeros((0, 2), np.int64)]
    for rows in np.split(order, edge):
        xs, ys = rows[probe[rows]], rows[~probe[rows]]
        for low in range(0, len(xs), 64):
            x = xs[low : low + 64]
            far = (lanes[x][:, None] != lanes[ys][None]).sum(-1)
            small, large = np.minimum(n[x][:, None], n[ys]), np.maximum(n[x][:, None], n[ys])
            i, j = np.nonzero((far <= MOST_DIFFERENT) & (part[x][:, None] != part[ys]) & (small * 100 >= large * LEAST_PERCENT))
            i, j = x[i], ys[j]
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                differ = (lanes[a] != lanes[b]).reshape(-1, CHUNKS, LANES)
                chunk = (differ.sum(2) <= 1).argmax(1)
                first = chunk * LANES + differ[np.arange(len(a)), chunk].argmax(1)
                a, b = a[first == tag[a]], b[first == tag[a]]
                good = (fine[a] != fine[b]).sum(1) <= FINE_DIFFERENT
                out.append(np.stack([np.maximum(rep[a], rep[b])[good], np.minimum(rep[a], rep[b])[good]], 1))
    pairs = np.unique(np.concatenate(out), axis=0)
    del packed, lanes, fine, out
    give_back()
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _differing(a: Column, b: Column) -> Column:
    """The top bit of every lane in which two packed chunks differ."""
    x = a.bitwiseXOR(b)
    return (x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x).bitwiseAND(F.lit(_TOP))


def different_lanes(a: Column, b: Column) -> Column:
    """Number of lanes in which two packed signatures differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(_differing(a[i], b[i])) for i in range(CHUNKS)])


def _file_keys(sig: Column) -> Column:
    """The keys of a signature: every chunk with every one lane left out."""
    keys = []
    for chunk in range(CHUNKS):
        for lane in range(LANES):
            mask = ((1 << (LANES * LANE_BITS)) - 1) ^ (_LANE << (LANE_BITS * lane))
            keys.append(F.xxhash64(F.lit(chunk * LANES + lane), sig[chunk].bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _near(a: str, b: str) -> Column:
    """Pairs that can be similar enough: by set size, and by signature distance."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * LEAST_PERCENT) & (different_lanes(F.col(f"{a}.sig"), F.col(f"{b}.sig")) <= MOST_DIFFERENT)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    sided = pairs.join(sets.select(F.col("rep").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("rep").alias("v"), F.col("own").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return sided.filter(100 * shared >= LEAST_PERCENT * (F.size("a") + F.size("b") - shared)).select("u", "v")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Documents with equal sets form one class under its smallest doc_id, so copies never meet in pairs. In every
    bucket all classes are first confirmed against its most central one, and the links merged; classes still outside that one's
    component are tried against a few of that one's members; then only classes of one bucket that are still in different
    components are compared with each other, in blocks, so that every near pair of different components has been confirmed or
    refuted on full sets. No link is left out, and a bucket of near copies costs a few comparisons a document. Null and empty texts and
    null doc_ids link with nothing; rows that share a doc_id are one node, so their classes are linked. An empty table gives an empty result. Texts of any length are
    whole, a long one in a block of its own, with its set in one row. Only the two columns named are read, so others cannot clash.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    sketch = cut(texts.mapInArrow(_sketch, "doc_id long, n long, low long, high long, sig array<long>"))
    able = sketch.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut(able.groupBy("low", "high", "n").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    filed = classes.select("rep", F.posexplode(_file_keys(F.col("sig"))).alias("tag", "key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    met = cut(filed.join(shared, "key"))
    # The member that meets the most others over all its buckets is the nearest to what a group was copied from.
    central = met.groupBy("rep").agg(F.struct(F.sum("size"), -F.col("rep")).alias("rank"))
    buckets = cut(met.join(central, "rep").select("key", "tag", "rep", "rank"))
    # From here on: tables go once nothing reads them again, and shuffles before the next large ones are written.
    discard(met)
    release(docs.sparkSession)
    some = buckets.select("rep").distinct()
    sets = cut(texts.join(some, texts["doc_id"] == some["rep"], "left_semi").mapInArrow(_sets, "rep long, own array<long>, fine binary"))
    release(docs.sparkSession)
    sides = classes.select("rep", "n", "sig")

    def links_to(pairs: DataFrame) -> DataFrame:
        """Confirmed links among the distinct pairs (rep, hub)."""
        near = pairs.join(sides.alias("x"), "rep").join(sides.select(F.col("rep").alias("hub_rep"), "n", "sig").alias("y"), (F.col("hub") == F.col("hub_rep")) & _near("x", "y"))
        return cut(_confirm(near.select(F.col("rep").alias("u"), F.col("hub").alias("v")), sets))

    def still_open(parts: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component, with their components and that of the bucket's most central row."""
        labelled = buckets.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "tag", "rep", "rank", F.coalesce("component", "rep").alias("part"))
        several = labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("size"), F.max_by("part", "rank").alias("base")).filter("least <> most")
        return cut(labelled.join(several.select("key", "base", "size"), "key"))

    hubs = buckets.groupBy("key").agg(F.max_by("rep", "rank").alias("hub"))
    first = links_to(buckets.join(hubs, "key").filter("rep <> hub").select("rep", "hub").distinct())
    release(docs.sparkSession)
    opened = still_open(connected_components(first))
    some_of = F.array(F.max_by("rep", "rank"), *[F.min_by("rep", F.xxhash64("rep", F.lit(i))) for i in range(1, PARTNERS)])
    partners = opened.filter("part = base").groupBy("key").agg(F.array_distinct(some_of).alias("hubs"))
    second = links_to(opened.filter("part <> base").join(partners, "key").select("rep", F.explode("hubs").alias("hub")).distinct())
    discard(opened)
    release(docs.sparkSession)
    links = first.unionByName(second)
    opened = still_open(connected_components(links))
    discard(buckets)
    rows = opened.join(sides, "rep").join(sets.select("rep", "fine"), "rep")
    rows = cut(rows.withColumns({"blocks": F.ceil(F.col("size") / F.lit(float(BLOCK))), "pblocks": F.ceil(F.col("size") / F.lit(float(PROBES)))}))
    discard(opened)
    release(docs.sparkSession)
    hashed = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = rows.select("*", hashed("blocks", 1).alias("block"), F.lit(False).alias("probe")).select("*", spread("pblocks").alias("pblock"))
    probes = rows.filter("part <> base").select("*", spread("blocks").alias("block"), F.lit(True).alias("probe")).withColumn("pblock", hashed("pblocks", 2))
    dealt = home.unionByName(probes.select(home.columns)).select("key", "block", "pblock", "probe", "rep", "part", "n", "tag", "sig", "fine")
    groups = max(1, rows.count() // GROUP_ROWS)
    bucket = F.pmod(F.xxhash64("key", "block", "pblock"), F.lit(groups))
    crossed = dealt.groupBy(bucket.alias("bucket")).applyInArrow(_cross, "u long, v long").distinct()
    more = cut(_confirm(crossed, sets))
    discard(rows, sets)
    release(docs.sparkSession)
    # A doc_id with different texts stands in several classes and links them.
    sides_of = ["low", "high", "n"]
    named = sketch.filter(F.col("doc_id").isNotNull())
    differ = F.greatest(*[(F.max(c) != F.min(c)).cast("int") for c in sides_of])
    several = named.groupBy("doc_id").agg(differ.alias("several")).filter("several = 1").select("doc_id")
    same_id = named.filter("n > 0").join(several, "doc_id", "left_semi").join(classes, sides_of).select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).distinct()
    parts = cut(connected_components(links.unionByName(more).unionByName(same_id)))
    discard(first, second, more)

    ends = cut(classes.join(parts, classes["rep"] == parts["node"], "left").select(*sides_of, F.coalesce("component", "rep").alias("component_id")))
    discard(classes)
    release(docs.sparkSession)
    # Copies of one text meet in one key; the skew of that join is split, as its right side has one row a key.
    full = named.filter("n > 0").join(ends, sides_of, "left").select("doc_id", "n", "component_id")
    empty = named.filter("n = 0").join(parts, named["doc_id"] == parts["node"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = sketch.filter(F.col("doc_id").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = full.unionByName(empty).unionByName(nameless).withColumnRenamed("n", "n_shingles")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS own FROM w
), x AS (SELECT doc_id, unnest(own) AS shingle FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT p.u, p.v FROM p JOIN s a ON a.doc_id = p.u JOIN s b ON b.doc_id = p.v
  WHERE 100 * shared >= 75 * (len(a.own) + len(b.own) - shared)
), r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, len(own)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.u = s.doc_id
"""
