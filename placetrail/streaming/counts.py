"""Counts over outcome tables that grow: the batch aggregations on a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import mapq_counts, misplaced_kinds


def outcome_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Outcome rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def mapq_counts_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Mapped and wrong reads of every tool and MAPQ so far; the state is one row for each of them."""
    return mapq_counts(outcome_stream(spark, path, schema), ["aligner"])


def misplaced_kinds_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return misplaced_kinds(outcome_stream(spark, path, schema), ["aligner"])
