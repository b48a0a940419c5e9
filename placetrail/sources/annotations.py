"""Annotation parsers over lines of text: each takes a DataFrame with a `value` column (spark.read.text reads plain and .gz files)
and gives (set_name, contig, start0, end0, label)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .onefile import place, write_lines
from ..functions.scalars import REPEAT_INTERSPERSED, closed_to_bed, repeat_age, repeat_class, segdup_label


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _number(column: Column) -> Column:
    return column.try_cast("double")


def _repeats(rows: DataFrame) -> DataFrame:
    """Two records for interspersed classes (class and age), one for the others."""
    age = F.when(F.col("label").isin(*REPEAT_INTERSPERSED), F.struct(F.lit("repeat_age").alias("set_name"), repeat_age(F.col("divergence")).alias("label")))
    kinds = F.array_compact(F.array(F.struct(F.lit("repeat_class").alias("set_name"), F.col("label")), age))
    return rows.select(F.explode(kinds).alias("k"), "contig", "start0", "end0").select("k.set_name", "contig", "start0", "end0", "k.label")


def repeatmasker_out(text: DataFrame) -> DataFrame:
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = text.select(f.alias("f")).filter((F.size("f") >= 11) & F.col("f")[0].rlike("^[0-9]+$"))
    place = closed_to_bed(F.col("f")[5].cast("long"), F.col("f")[6].cast("long"))
    return _repeats(rows.select(F.col("f")[4].alias("contig"), place.alias("p"), repeat_class(F.col("f")[10]).alias("label"), F.col("f")[1].cast("double").alias("divergence")).select("contig", "p.*", "label", "divergence"))


def ucsc_rmsk(text: DataFrame) -> DataFrame:
    rows = text.select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 13)
    return _repeats(
        rows.select(F.col("f")[5].alias("contig"), F.col("f")[6].cast("long").alias("start0"), F.col("f")[7].cast("long").alias("end0"), repeat_class(F.col("f")[11]).alias("label"), (F.col("f")[2].cast("double") / 10).alias("divergence"))
    )


def ucsc_superdups(text: DataFrame) -> DataFrame:
    rows = text.select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 4)
    identity = _number(F.get("f", F.lit(26)))
    return rows.select(F.lit("segdup").alias("set_name"), F.col("f")[1].alias("contig"), F.col("f")[2].cast("long").alias("start0"), F.col("f")[3].cast("long").alias("end0"), segdup_label(identity).alias("label"))


def bed(text: DataFrame, set_name: str, label: str | None = None, label_col: int | None = None, identity_col: int | None = None) -> DataFrame:
    """Label by identity column (a share, or a percentage above 1), else by label column, else fixed, else the set's name."""
    dropped = (F.trim("value") == "") | F.col("value").rlike("^(#|track|browser)")
    rows = text.filter(~dropped).select(F.split("value", "\t").alias("f")).filter((F.size("f") >= 3) & F.col("f")[1].rlike("^[0-9]+$"))
    fixed = F.lit(label or set_name)
    named = fixed if label_col is None else F.coalesce(F.get("f", F.lit(label_col)), fixed)
    if identity_col is not None:
        given = F.get("f", F.lit(identity_col))
        share = _number(given)
        named = F.when(given.isNull(), named).when(share.isNull(), fixed).otherwise(segdup_label(F.when(share > 1, share / 100).otherwise(share)))
    return rows.select(F.lit(set_name).alias("set_name"), F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("start0"), F.col("f")[2].cast("long").alias("end0"), named.alias("label"))


def gff(text: DataFrame, types: list[str], set_name: str = "feature") -> DataFrame:
    rows = text.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter((F.size("f") >= 9) & F.get("f", F.lit(2)).isin(*types))
    place = closed_to_bed(F.col("f")[3].cast("long"), F.col("f")[4].cast("long"))
    return rows.select(F.lit(set_name).alias("set_name"), F.col("f")[0].alias("contig"), place.alias("p"), F.col("f")[2].alias("label")).select("set_name", "contig", "p.*", "label")


PARSERS: dict[str, Callable[..., DataFrame]] = {"rmsk_out": repeatmasker_out, "ucsc_rmsk": ucsc_rmsk, "ucsc_superdups": ucsc_superdups, "bed": bed, "gff": gff}


def parse(text: DataFrame, kind: str, **options) -> DataFrame:
    if kind not in PARSERS:
        raise ValueError(f"unknown annotation format {kind!r}; known: {sorted(PARSERS)}")
    return PARSERS[kind](text, **options)


def alias_groups(text: DataFrame, ncbi: bool) -> DataFrame:
    """(group_id, name) of an assembly report (its four name columns) or of an alias table (all columns)."""
    rows = text.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.xxhash64("value").alias("group_id"), F.split("value", "\t").alias("f"))
    names = F.array(*[F.get("f", F.lit(i)) for i in (0, 4, 6, 9)]) if ncbi else F.col("f")
    return rows.select("group_id", F.explode(names).alias("name")).select("group_id", F.trim("name").alias("name")).filter("name is not null and name not in ('na', '=', '<>', '')").distinct()


def strata_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every BED of a folder, a file or a folder of parts; its name is its set's name."""
    table = spark.read.option("recursiveFileLookup", True).csv(path, sep="\t", schema="contig string, start0 long, end0 long, label string")
    return table.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.bed(?:\.gz)?(?:/[^/]*)?$", 1).alias("set_name"), "contig", "start0", "end0", "label")


def vcf(text: DataFrame, sample: int = 0) -> DataFrame:
    """(contig, pos1, ref, alts, genotype) of one sample; lines of fewer than ten fields are left out."""
    rows = text.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 10)
    return rows.select(F.col("f")[0].alias("contig"), F.col("f")[1].cast("long").alias("pos1"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alts"), F.get("f", F.lit(9 + sample)).alias("genotype"))


def prepare_vcf(text: DataFrame, order: str, names: DataFrame, lengths: DataFrame) -> DataFrame:
    """(order, value): VCF lines with canonical contig names. Contig headers go, other headers stay; a record of another contig has a null
    value, and one past its contig's end fails, as the file then belongs to another assembly."""
    rows = text.filter(~F.col("value").startswith("##contig"))
    parts = F.split("value", "\t", 3)
    named = rows.withColumn("name", F.when(~F.col("value").startswith("#"), parts[0])).join(names, "name", "left")
    sized = named.join(lengths.select(F.col("contig").alias("canonical"), "length"), "canonical", "left")
    beyond = F.concat(F.lit("variant at "), "name", F.lit(":"), parts[1], F.lit(" lies beyond the end of "), "canonical")
    record = F.when(F.col("canonical").isNull(), None).when(parts[1].cast("long") > F.col("length"), F.raise_error(beyond)).otherwise(F.concat_ws("\t", "canonical", parts[1], F.get(parts, F.lit(2))))
    return sized.select(order, F.when(F.col("name").isNull(), F.col("value")).otherwise(record).alias("value"))


def vcf_stats(prepared: DataFrame) -> DataFrame:
    """One row: variants_kept and variants_on_other_contigs of a prepared VCF."""
    return prepared.agg(F.count_if(~F.col("value").startswith("#")).alias("variants_kept"), F.count_if(F.col("value").isNull()).alias("variants_on_other_contigs"))


def write_vcf(prepared: DataFrame, order: str, path: str, stats_path: str) -> None:
    """A prepared VCF as one gzip file in its order, without the records of other contigs, and its counts as one JSON object. Neither is left if the
    writing fails."""
    write_lines(prepared.filter(F.col("value").isNotNull()), [order], path)
    files, name = place(stats_path)
    with files.open_output_stream(name) as out:
        out.write(json.dumps(vcf_stats(prepared).first().asDict(), indent=2).encode())


def write_bed_file(records: DataFrame, path: str) -> None:
    """BED4 as one gzip file in order of place."""
    columns = ["contig", "start0", "end0", "label"]
    write_lines(records.select(*columns, F.concat_ws("\t", *columns).alias("value")), columns, path)


def write_bed(records: DataFrame, path: str) -> None:
    """BED4 in order of place: range-partitioned, so the files follow each other."""
    records.select("contig", "start0", "end0", "label").orderBy("contig", "start0", "end0").write.mode("overwrite").csv(path, sep="\t")
