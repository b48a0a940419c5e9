"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytepairs, langid, mixing, neardup, nearvec, pieces, quality, repeats, topk, toxicity, whitening, wordpiece
from .sampling import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at cosine 0.95."""
    return nearvec.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), least=0.95)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, wordpiece.read_vocabulary()).select("doc_id", "n_words", "n_tokens")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned outside the fold crc32(doc_id) mod 5 = 0."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), mod=5, held=0)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned outside the fold crc32(doc_id) mod 4 = 2."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), mod=4, held=2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, component and representative of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in order, the text they decode to, and whether that is the same text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, pieces.read_model())[0].select("doc_id", "n_bytes", "n_pieces", "ids", "decoded", "round_trip")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every vector whose vec_id is divisible by 100, over all vectors."""
    vectors = topk.to_grid(_table(spark, sf_dir, "embeddings"))
    return topk.nearest_neighbours(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes covered by a 200-byte string that also starts anywhere else."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the fold crc32(doc_id) mod 4 = 2."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, mod=4, held=2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a capped mix takes from every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the text they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bytepairs.encode_documents(docs, bytepairs.read_ranks())
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", F.col("n_pieces").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies in every document, their groups and links, and how often the linked pairs occur in the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align_documents(docs, alignment.read_byte_bpe(), alignment.read_pieces())[0]
    return aligned.select("doc_id", *alignment.OUTPUTS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector, with the exact deviation from the mean and the measured error of the fit."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=8, scale=1024.0, shift=100_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_top_k": op7_top_k,
    "op8_repeats": op8_repeats,
    "op9_language_id": op9_language_id,
    "op10_mix_sources": op10_mix_sources,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op1_near_vectors": nearvec.ORACLE_SQL,
    "op2_token_counts": wordpiece.ORACLE_SQL,
    "op5_near_duplicates": neardup.ORACLE_SQL,
    "op7_top_k": topk.ORACLE_SQL,
    "op8_repeats": repeats.ORACLE_SQL,
    "op10_mix_sources": mixing.ORACLE_SQL,
}
