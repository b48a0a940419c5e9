"""Genomic context: labels of annotation sets, GC, variant density and length for intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cover_bin, gc_bin, length_bin, variant_density_bin
from . import intervals as iv


def _single(annotations: DataFrame) -> dict[str, str]:
    """The sets with one label, and that label; sets are a handful."""
    counted = annotations.groupBy("set_name").agg(F.min("label").alias("only"), F.max("label").alias("last")).filter("only = last").limit(iv.MOST_SETS + 1).collect()
    return {r.set_name: r.only for r in counted}


def _outside(label: Column, only: str | None) -> Column:
    return label if only is None else F.when(label == "none", f"outside_{only}").otherwise(label)


def set_labels(queries: DataFrame, annotations: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, set_name, label, cover): the dominant label of every set, and how much of the query it covers. In a set with
    one label, `none` becomes `outside_<label>`."""
    found = iv.dominant_labels(queries, annotations, key, least)
    label = F.col("label")
    for name, only in _single(annotations).items():
        label = F.when(F.col("set_name") == name, _outside(F.col("label"), only)).otherwise(label)
    return found.select(key, "set_name", label.alias("label"), cover_bin(F.col("fraction")).alias("cover"))


def annotate(queries: DataFrame, annotations: DataFrame, sets: list[str], key: str, points: DataFrame | None = None, long_reads: bool = False, divergence: str | None = None) -> DataFrame:
    """queries(key, contig, start0, end0[, gc]) plus `<set>` and `<set>_cover` for every set, and, where their inputs are
    given, gc_content, var_count, variant_density, read_length and divergence. A set without annotations gives nulls."""
    there, single = set(iv.set_names(annotations)), _single(annotations)
    out = iv.with_dominant(queries, annotations)
    columns = {}
    for name in sets:
        label, fraction = iv.dominant_of(F.lit(name))
        known = name in there
        columns[name] = _outside(label, single.get(name)) if known else F.lit(None).cast("string")
        columns[f"{name}_cover"] = cover_bin(fraction) if known else F.lit(None).cast("string")
    out = out.withColumns(columns).drop("best")
    span = F.greatest(F.col("end0") - F.col("start0"), F.lit(1))
    if "gc" in queries.columns:
        out = out.withColumn("gc_content", gc_bin(F.col("gc")))
    if points is not None:
        counted = iv.count_points(queries, points, key).withColumnRenamed("n_points", "var_count")
        out = out.join(counted, key).withColumn("variant_density", variant_density_bin(F.col("var_count"), span))
    if long_reads:
        out = out.withColumn("read_length", length_bin(span))
    return out if divergence is None else out.withColumn("divergence", F.lit(divergence))


def stratum_columns(columns: list[str], sets: list[str]) -> list[str]:
    """The columns of an annotated table that define strata, in report order."""
    wanted = [c for s in sets for c in (s, f"{s}_cover")] + ["gc_content", "variant_density", "read_length"]
    return [c for c in wanted if c in columns]


def build_strata(parsed: DataFrame, names: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, stats) of parsed(set_name, contig, start0, end0, label): contigs are resolved by names(name, canonical), those
    of other references dropped and counted; an empty or negative interval and one past its contig's end fail."""
    resolved = parsed.join(names.withColumnRenamed("name", "contig"), "contig", "left")
    sized = resolved.join(lengths.select(F.col("contig").alias("canonical"), "length"), "canonical", "left")
    good = (
        F.when(F.col("canonical").isNull(), True)
        .when((F.col("start0") < 0) | (F.col("end0") <= F.col("start0")), F.raise_error(F.lit("empty or negative interval")).cast("boolean"))
        .when(F.col("end0") > F.col("length"), F.raise_error(F.lit("interval ends after its contig: different assembly versions")).cast("boolean"))
        .otherwise(True)
    )
    checked = sized.filter(good)
    kept = F.col("canonical").isNotNull()
    records = checked.filter(kept).select("set_name", F.col("canonical").alias("contig"), "start0", "end0", "label")
    width = F.when(kept, F.col("end0") - F.col("start0"))
    stats = checked.groupBy("set_name").agg(F.count(F.lit(1)).alias("records_in"), F.count_if(kept).alias("records_kept"), F.count_if(~kept).alias("off_reference"), F.coalesce(F.sum(width), F.lit(0)).alias("bases"))
    return records, stats
