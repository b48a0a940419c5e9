"""The experiment's configuration: checked, and spread into its datasets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import with_names


def check(config: dict) -> None:
    """Fail on names, types and links between the parts that cannot work."""
    genomes, platforms, real = (config.get(k) or {} for k in ("genomes", "platforms", "real_reads"))

    def need(good: bool, what: str) -> None:
        if not good:
            raise ValueError(what)

    for name in [*genomes, *platforms, *real]:
        need(re.fullmatch(r"\w+", name, re.ASCII) is not None, f"{name!r}: names are letters, digits and underscores")
    for name, platform in platforms.items():
        source = platform.get("calibrate_on")
        need(platform.get("type") in ("short", "long"), f"platform {name}: its type is neither short nor long")
        need(source in real and real[source].get("platform") == name, f"platform {name}: calibrate_on names no reads of this platform")
    for name, reads in real.items():
        need(reads.get("platform") in platforms, f"reads {name}: no such platform")
        need({reads.get("genome"), *(reads.get("also_align_to") or [])} <= set(genomes), f"reads {name}: no such genome")


def datasets(config: dict) -> list[dict]:
    """One row for each dataset of a checked configuration: simulated, calibration, pilot and real ones."""
    check(config)
    genomes, platforms, real = (config.get(k) or {} for k in ("genomes", "platforms", "real_reads"))
    series = (config.get("simulation") or {}).get("divergence_series") or {}
    rows = []

    def add(dataset: str, kind: str, genome: str, platform: str, reads: str | None = None, divergence: float = 0.0) -> None:
        rows.append({"dataset": dataset, "kind": kind, "genome": genome, "platform": platform, "reads": reads, "divergence": divergence})

    for genome in genomes:
        levels = [0.0, *map(float, series.get("levels") or [])] if genome in (series.get("genomes") or []) else [0.0]
        for platform in platforms:
            for level in levels:
                add(f"sim-{genome}-{platform}-d{level:g}", "sim", genome, platform, divergence=level)
    for name, reads in real.items():
        add(f"calib-{name}", "calib", reads["genome"], reads["platform"], name)
        if platforms[reads["platform"]]["calibrate_on"] == name:
            add(f"pilot-{name}", "pilot", reads["genome"], reads["platform"], name)
        for genome in [reads["genome"], *(reads.get("also_align_to") or [])]:
            add(f"real-{name}-on-{genome}", "real", genome, reads["platform"], name)
    return rows


def dataset_grid(genomes: DataFrame, platforms: DataFrame, levels: list[str]) -> DataFrame:
    """(dataset, genome, platform, divergence) for every genome(genome), platform(platform) and divergence level."""
    each = with_names(genomes, platforms.select("platform"))
    rows = each.withColumn("divergence", F.explode(F.array(*map(F.lit, levels))))
    return rows.select(F.concat_ws("-", F.lit("sim"), "genome", "platform", F.concat(F.lit("d"), "divergence")).alias("dataset"), "genome", "platform", "divergence")
