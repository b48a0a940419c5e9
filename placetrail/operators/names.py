"""Contig names: alias groups and resolution to the reference's own names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import name_spellings


def aliases(groups: DataFrame, reference: DataFrame) -> DataFrame:
    """(alias, canonical): names of groups(group_id, name) that name exactly one sequence of reference(name), directly or, where
    none does directly, by a derived spelling."""
    known = reference.select(F.col("name").alias("hit"))
    direct = groups.join(known, F.col("name") == F.col("hit"))
    derived = groups.select("group_id", F.explode(name_spellings(F.col("name"))).alias("name")).join(known, F.col("name") == F.col("hit"))
    derived = derived.join(direct.select("group_id").distinct(), "group_id", "left_anti")
    hits = direct.unionByName(derived).groupBy("group_id").agg(F.count_distinct("hit").alias("n"), F.min("hit").alias("canonical")).filter("n = 1")
    # A name that several groups claim belongs to the first of them.
    return groups.join(hits, "group_id").groupBy(F.col("name").alias("alias")).agg(F.min_by("canonical", "group_id").alias("canonical"))


def name_table(reference: DataFrame, alias_table: DataFrame | None = None) -> DataFrame:
    """(name, canonical): exact names first, then derived spellings, then aliases."""
    exact = reference.select("name", F.col("name").alias("canonical"), F.lit(0).alias("priority"))
    derived = reference.select(F.explode(name_spellings(F.col("name"))).alias("name"), F.col("name").alias("canonical"), F.lit(1).alias("priority"))
    every = exact.unionByName(derived)
    if alias_table is not None:
        every = every.unionByName(alias_table.select(F.col("alias").alias("name"), "canonical", F.lit(2).alias("priority")))
    return every.groupBy("name").agg(F.min_by("canonical", F.struct("priority", "canonical")).alias("canonical"))


def resolve(rows: DataFrame, names: DataFrame, column: str = "contig") -> DataFrame:
    """rows plus `canonical`, null for unknown names. The name table has a few rows for each contig."""
    return rows.join(names.withColumnRenamed("name", column), column, "left")


def unresolved(rows: DataFrame, names: DataFrame, column: str = "contig", top: int = 8) -> DataFrame:
    """The most frequent unknown names."""
    lost = rows.join(names.select(F.col("name").alias(column)), column, "left_anti")
    return lost.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(top)


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The distinct names that both tables hold."""
    return a.select(column).intersect(b.select(column))


def missing(wanted: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """The distinct names of wanted that present lacks."""
    return wanted.select(column).subtract(present.select(column))
