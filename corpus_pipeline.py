"""A training-corpus pipeline: language, near duplicates, repeated strings, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Each
result is written as Parquet to the shared folder and read again as the next stage's docs. All stages work on whole
tables and whole texts, give an empty result for an empty table, and keep columns beyond those they read, whatever their names and types; where
one has the name of a column that the last stage adds, the new one gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placetrail.llm import langid, mixing, neardup, pieces, repeats
from placetrail.llm.lineage import cut

#: A document stays if its language has at least this mean posterior.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not null, with a letter, and with a mean posterior of SURE or more."""
    return langid.identify_into(docs, langid.train(docs), SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates; of several rows with that doc_id the one with the least text
    (then the least of the other columns, as JSON) stays. Rows without a doc_id link with nothing and stay."""
    kept = cut(neardup.near_duplicates(docs).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    once = docs.join(kept.filter("rows = 1"), "doc_id", "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    several = docs.join(kept.filter("rows > 1"), "doc_id", "left_semi").select("doc_id", row.alias("row"), F.struct("text", F.to_json(row)).alias("order"))
    least = several.groupBy("doc_id").agg(F.min_by("row", "order").alias("least")).select("least.*")
    return once.unionByName(least).unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings of 200 bytes; what is left of a character cut in two goes too, n_chars
    follows the text, and a document of which nothing is left goes."""
    names = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}  # none that the operator adds
    out = repeats.without_repeats(docs.toDF(*names.values())).filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(names["n_chars"]))
    return out.withColumn(names["n_chars"], n_chars).select(*names.values()).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it: not at all, once, or up to three times."""
    return mixing.repeat_documents(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's columns but its text, with its bytes, its pieces in order, the text they decode to and the round trip."""
    return pieces.encode_documents(docs, pieces.read_model())[0]


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("suffix_array", repeated_strings),
    ("mix_sources", mix),
    ("sentence_pieces", sentence_pieces),
]

#: SQL cannot express the learned language model nor the lattice; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
