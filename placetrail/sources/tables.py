"""Result tables: gathering, benchmark and provenance files, typed writers, checked downloads."""

from __future__ import annotations

import hashlib
import shutil
import urllib.request
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the merged provenance table.
PROVENANCE = ("label", "url", "path", "bytes", "md5", "retrieved", "note")


def gather(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_tsv(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Tables that exist and are not empty, with one explicit schema."""
    there = [p for p in paths if Path(p).is_dir() or (Path(p).exists() and Path(p).stat().st_size > 1)]
    return spark.read.csv(there, sep="\t", header=True, schema=schema) if there else spark.createDataFrame([], schema)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def benchmark_parts(paths: DataFrame, column: str = "path") -> DataFrame:
    """step, tool and target from the last three parts of a benchmark file's path."""
    parts = F.split(F.regexp_replace(column, r"\.tsv$", ""), "/")
    return paths.withColumns({name: F.element_at(parts, -i) for i, name in ((3, "step"), (2, "tool"), (1, "target"))})


def provenance(records: DataFrame) -> DataFrame:
    """Records with the fixed columns as text, absent ones empty, lists joined by `; `."""
    have = dict(records.dtypes)

    def text(name: str):
        if name not in have:
            return F.lit("").alias(name)
        value = F.array_join(name, "; ") if have[name].startswith("array") else F.col(name).cast("string")
        return F.coalesce(value, F.lit("")).alias(name)

    return records.select(*[text(n) for n in PROVENANCE])


def md5_of(files: DataFrame) -> DataFrame:
    """files as spark.read.format("binaryFile") gives them, plus md5."""
    return files.select("path", "length", F.md5("content").alias("md5"))


def download(url: str, target: str, md5: str | None = None) -> dict:
    """Copy or fetch a file, check its MD5 and return its provenance; a file with the right MD5 is not fetched again,
    and a download that broke off goes on where it stopped."""

    def digest() -> str:
        with open(target, "rb") as file:
            return hashlib.file_digest(file, "md5").hexdigest()

    if not (md5 and Path(target).exists() and digest() == md5):
        if "://" in url:
            part = Path(f"{target}.part")
            have = part.stat().st_size if part.exists() else 0
            asked = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
            with urllib.request.urlopen(asked, timeout=60) as source, open(part, "ab" if source.status == 206 else "wb") as file:
                shutil.copyfileobj(source, file)
            part.replace(target)
        else:
            shutil.copyfile(url, target)
    found = digest()
    if md5 and found != md5:
        Path(target).unlink()
        raise ValueError(f"{url}: MD5 is {found}, not {md5}")
    return {"url": url, "path": target, "bytes": Path(target).stat().st_size, "md5": found}


def check_sources(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """(label, url, ok, problem) of every source; a failure does not stop the others."""
    rows = []
    for label, url in sources:
        try:
            if "://" in url:
                with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=60):
                    problem = ""
            else:
                problem = "" if Path(url).exists() else "no such file"
        except Exception as error:  # noqa: BLE001
            problem = str(error)
        rows.append((label, url, not problem, problem))
    return spark.createDataFrame(rows, "label string, url string, ok boolean, problem string")
