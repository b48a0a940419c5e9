"""Mixing sources to target weights: capped water-filling and seeded repetition, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordered import running_sums
from .lineage import cut
from .textops import WORD_PATTERN

#: Rows that one bucket of the sampling order holds on average; only a source's one cut bucket is ordered row by row.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_levels(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Targets for a table (source, source_size, weight).

    All sizes together are shared by weight; a source above `max_epochs` times its size is held there and its
    excess goes to the others by weight, until none is above. The fixed point is min(cap, level * weight): with the
    sources sorted by cap/weight, the level is the largest one that its own source can take. Sums along that order are taken by
    ranges, so a table with as many sources as documents is no single task either; only two totals and the level reach the driver.
    """
    capped = cut(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    total, weights = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filled = running_sums(capped, order, {"held": F.col("cap"), "lighter": F.col("weight")})
    reach = (F.lit(float(total or 0)) - F.col("held")) / (F.lit(float(weights or 0)) - F.col("lighter"))
    reached = filled.withColumn("reach", reach)
    level = reached.agg(F.max(F.when(F.col("reach") * F.col("weight") <= F.col("cap"), F.col("reach")))).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return capped.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source).

    `weights` repeat over the sources in code-point order, null last. A source's documents are taken
    floor(target / source_size) times; the fractional rest goes to the documents that come first in a seeded order
    (md5 of seed and doc_id, then size) and whose middle lies within the wanted words. Rows that tie in that order are one entry of all
    their words, so repeated rows, and rows without a doc_id of one size, are taken alike. The order is cut by hash buckets: bucket totals
    are accumulated per source, and only entries of the bucket that holds the cut are ordered, so a source with a third of all
    rows is never ordered in one task. A source without words has target 0 and takes nothing; an empty table gives an empty result.
    Only doc_id, text and source are read, so further columns cannot clash.
    """
    # Texts are read once; everything below works on this narrow table.
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    turn = running_sums(sources, [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}).select("source", "source_size", (F.col("turn") % len(weights)).alias("turn"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("turn") + 1).cast("int"))
    levels = water_levels(turn.select("source", "source_size", weight.alias("weight")), max_epochs)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(float(BUCKET_ROWS))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(
        sources.alias("s")
        .join(levels.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")))
        .select("s.source", "s.source_size", "l.target", buckets.alias("buckets"))
        .withColumn("whole", F.floor(ratio).cast("long"))
        .withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    place = F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))
    rows = (
        sized.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "p.source_size", "p.target", "p.whole", "p.wanted", "p.buckets", digest.alias("digest"))
        .withColumn("bucket", F.floor(place * F.col("buckets")).cast("long"))
    )
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # One row for BUCKET_ROWS documents, so one source's window stays small.
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    placed = (
        rows.alias("r")
        .join(totals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.bucket") == F.col("t.bucket")))
        .select("r.*", "t.bucket_size", "t.bucket_start")
        .withColumn("inside", F.col("bucket_start") + F.col("bucket_size") <= F.col("wanted"))
        .withColumn("cut", ~F.col("inside") & (F.col("bucket_start") < F.col("wanted")))
    )
    within = W.partitionBy("source", "bucket").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, -1)
    ties = placed.filter("cut").groupBy("source", "bucket", "digest", "size").agg(F.sum("size").alias("words"), F.max("bucket_start").alias("base"), F.max("wanted").alias("most"))
    ties = ties.withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    ties = ties.filter(F.col("start") + F.col("words") / 2 <= F.col("most")).select("source", "digest", "size")
    same = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.digest") == F.col("t.digest")) & (F.col("r.size") == F.col("t.size"))
    at_cut = placed.filter("cut").alias("r").join(ties.alias("t"), same, "left").select("r.*", F.col("t.size").isNotNull().cast("long").alias("more"))
    others = placed.filter(~F.col("cut")).withColumn("more", F.col("inside").cast("long"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(F.lit(0)).cast("long")
    return others.unionByName(at_cut).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """Rows of docs(doc_id, text, source, ...) as often as the mix takes them, all columns kept. Rows that share doc_id,
    source and size are taken equally often there too."""
    taken = mix_sources(docs, max_epochs, weights, seed).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), word_count(F.col("text")).alias("n"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    return sized.join(taken, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sized GROUP BY source
), c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM c
), v AS (SELECT *, max(CASE WHEN reach * weight <= cap THEN reach END) OVER () AS lev FROM l),
p AS (
  SELECT source, source_size, least(cap, coalesce(lev * weight, cap)) AS target FROM v
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p
), r AS (
  SELECT d.doc_id, d.size, q.source, q.source_size, q.target, q.whole, greatest(0, q.target - q.whole * q.source_size) AS wanted,
    md5(concat_ws(':', 'mix', d.doc_id::VARCHAR)) AS digest
  FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, size GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(size) OVER (PARTITION BY source, digest, size) AS words FROM r
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN whole + CASE WHEN start + words / 2 <= wanted THEN 1 ELSE 0 END ELSE 0 END * size)::BIGINT AS taken FROM o
"""
