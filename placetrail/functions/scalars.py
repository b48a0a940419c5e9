"""Column functions: coordinates, contig names, labels, quality scales, confidence limits and verdicts.

Intervals are 0-based and half-open (`start0`, `end0`). Undefined numbers are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054
PHRED_FLOOR = 1e-10

# Classes and labels of the annotation formats and tables.
REPEAT_MAJOR = ("SINE", "LINE", "LTR", "DNA", "Satellite", "Simple_repeat", "Low_complexity", "Retroposon")
REPEAT_RNA = ("rRNA", "tRNA", "snRNA", "scRNA", "srpRNA", "RNA")
REPEAT_INTERSPERSED = ("SINE", "LINE", "LTR", "DNA", "Retroposon")
AGE_STEPS, AGE_LABELS = (5.0, 15.0), ("young_<5%", "middle_5-15%", "old_>15%")
GC_STEPS, GC_LABELS = (0.3, 0.4, 0.5, 0.6, 0.7), ("<30%", "30-40%", "40-50%", "50-60%", "60-70%", ">=70%")
DENSITY_STEPS, DENSITY_LABELS = (2.0, 5.0, 10.0), ("0-2/kb", "2-5/kb", "5-10/kb", ">=10/kb")
LENGTH_STEPS = (500, 1000, 2000, 5000, 10000, 20000, 50000)
LENGTH_LABELS = ("<500", "0.5-1k", "1-2k", "2-5k", "5-10k", "10-20k", "20-50k", ">=50k")
COVER_STEPS, COVER_LABELS = (0.5, 0.95), ("partial_<50%", "mostly_50-95%", "entire_>=95%")


def stepped(value: Column, steps: tuple, labels: tuple) -> Column:
    """The label of the half-open bin that holds value; a value on an edge goes up."""
    out = F.lit(labels[-1])
    for step, label in zip(reversed(steps), reversed(labels[:-1]), strict=True):
        out = F.when(value < F.lit(step), F.lit(label)).otherwise(out)
    return out


def checked(condition: Column, value: Column, message: str) -> Column:
    """value where the condition holds, an error elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def closed_to_bed(start1: Column, end1: Column) -> Column:
    good = (start1 >= 1) & (end1 >= start1)
    return checked(good, F.struct((start1 - 1).alias("start0"), end1.alias("end0")), "not a 1-based closed interval")


def bed_to_closed(start0: Column, end0: Column) -> Column:
    good = (start0 >= 0) & (end0 > start0)
    return checked(good, F.struct((start0 + 1).alias("start1"), end0.alias("end1")), "empty or negative interval")


def vcf_to_bed(pos1: Column, ref: Column) -> Column:
    return F.struct((pos1 - 1).alias("start0"), (pos1 - 1 + F.length(ref)).alias("end0"))


def region_string(contig: Column, start0: Column, end0: Column) -> Column:
    return F.concat(contig, F.lit(":"), (start0 + 1).cast("string"), F.lit("-"), end0.cast("string"))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over the hull of both intervals; 0 for an empty hull."""
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(hull > 0, overlap(start_a, end_a, start_b, end_b).cast("double") / hull).otherwise(F.lit(0.0))


def name_spellings(name: Column) -> Column:
    """The name and its spelling with or without `chr` (mitochondria: chrM and MT)."""
    bare = F.substring(name, 4, 1 << 20)
    other = F.when(name == "chrM", F.lit("MT")).when(name.startswith("chr"), bare).when(name == "MT", F.lit("chrM")).otherwise(F.concat(F.lit("chr"), name))
    return F.array(name, other)


def repeat_class(family: Column) -> Column:
    major = F.rtrim(F.split_part(family, F.lit("/"), F.lit(1)), F.lit("?"))
    return F.when(major.isin(*REPEAT_MAJOR), major).when(major.isin(*REPEAT_RNA), F.lit("RNA")).otherwise(F.lit("Other_repeat"))


def repeat_age(divergence: Column) -> Column:
    return stepped(divergence, AGE_STEPS, AGE_LABELS)


def segdup_label(identity: Column) -> Column:
    return F.when(identity.isNull(), "SD").when(identity >= 0.99, "SD_>=99%").when(identity >= 0.95, "SD_95-99%").otherwise("SD_<95%")


def gc_bin(gc: Column) -> Column:
    return stepped(F.coalesce(F.nanvl(gc.cast("double"), F.lit(0.45)), F.lit(0.45)), GC_STEPS, GC_LABELS)


def variant_density_bin(variants: Column, length: Column) -> Column:
    per_kb = variants.cast("double") / F.greatest(length.cast("double"), F.lit(1.0)) * 1000.0
    return F.when(per_kb <= 0, "0").otherwise(stepped(per_kb, DENSITY_STEPS, DENSITY_LABELS))


def length_bin(length: Column) -> Column:
    return stepped(length, LENGTH_STEPS, LENGTH_LABELS)


def cover_bin(fraction: Column) -> Column:
    return F.when(fraction <= 0, "none").otherwise(stepped(fraction, COVER_STEPS, COVER_LABELS))


def phred(p: Column) -> Column:
    """-10 log10 of a probability held within [PHRED_FLOOR, 1]; null stays null."""
    return F.when(p.isNotNull(), F.lit(-10.0) * F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(PHRED_FLOOR))))


def unphred(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q.cast("double") / 10.0)


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Limits of the 95 % Wilson interval of k of n; exactly 0 and 1 at the ends, null for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    z2 = Z95 * Z95
    share = F.try_divide(k, n)
    middle = F.try_divide(share + F.try_divide(F.lit(z2 / 2), n), 1 + F.try_divide(F.lit(z2), n))
    inner = F.try_divide(share * (1 - share), n) + F.try_divide(F.lit(z2 / 4), n * n)
    half = F.try_divide(F.lit(Z95) * F.sqrt(inner), 1 + F.try_divide(F.lit(z2), n))
    low = F.when(n > 0, F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(middle - half, F.lit(0.0))))
    high = F.when(n > 0, F.when(k == n, F.lit(1.0)).otherwise(F.least(middle + half, F.lit(1.0))))
    return low, high


def ideal_mapq(delta: Column, error_rate: Column, copies: Column) -> Column:
    """Phred-scaled probability that a hit ahead by `delta` mismatches of `copies` equal rivals is wrong."""
    weight = copies * F.pow((error_rate / 3.0) / (1.0 - error_rate), delta)
    return phred(weight / (1.0 + weight))


def outcome(mapped: Column, same_contig: Column, overlap_share: Column, least: float = 0.1) -> Column:
    return F.when(~mapped, "unmapped").when(same_contig & (overlap_share > least), "correct").otherwise("misplaced")


def misplaced_kind(result: Column, same_contig: Column, overlap_share: Column) -> Column:
    kind = F.when(~same_contig, "other_contig").when(overlap_share > 0, "same_locus_low_overlap").otherwise("same_contig_elsewhere")
    return F.when(result == "misplaced", kind).otherwise("")


def verdict(low: Column, high: Column, claim: Column) -> Column:
    """Where a claim lies against an interval: the interval lies above it, at or below it, or around it."""
    return F.when(low > claim, "above").when(high <= claim, "within").otherwise("open")


def per_thousand(k: Column, n: Column) -> Column:
    """`rate [low, high]` per thousand with two decimals, n/a for n = 0."""
    low, high = wilson(k, n)
    text = F.format_string("%.2f [%.2f, %.2f]", F.try_divide(k.cast("double"), n.cast("double")) * 1000, low * 1000, high * 1000)
    return F.when(n > 0, text).otherwise("n/a")


def parse_rate(text: Column) -> Column:
    """(value, low, high) of such a text; nulls where it is none."""
    pattern = r"^([\d.]+) \[([\d.]+), ([\d.]+)\]$"
    return F.struct(*[F.try_to_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("999999.99")).cast("double").alias(name) for i, name in enumerate(("value", "low", "high"), 1)])


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def is_number(text: Column) -> Column:
    return text.rlike(r"^-?\d+(\.\d+)?%?$")


def key_values(text: Column) -> Column:
    """`a=1,b=2` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def hash_swap(contig: Column, start0: Column) -> Column:
    """Whether an unphased heterozygous genotype at a place has its alleles swapped."""
    return F.crc32(F.concat(contig, F.lit(":"), start0.cast("string"))).bitwiseAND(1) == 1


def ena_problems(platform: Column, layout: Column, files: Column, wanted: str, paired: bool) -> Column:
    """What contradicts the wanted platform and layout in a run's metadata."""
    expected = "PAIRED" if paired else "SINGLE"
    return F.array_compact(
        F.array(
            F.when(platform != wanted, F.concat(F.lit("platform "), platform)),
            F.when(layout != expected, F.concat(F.lit("layout "), layout)),
            F.when(files < (2 if paired else 1), F.concat(F.lit("files "), files.cast("string"))),
        )
    )


def general(value: Column) -> Column:
    """A number in six significant digits without trailing zeros, in powers of ten below 1e-4 and from 1e6 on; halves round up."""
    text = F.format_string("%.5e", value)
    sign, digits = F.regexp_extract(text, "^-", 0), F.regexp_replace(F.regexp_extract(text, r"(\d\.\d+)e", 1), r"\.", "")
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    large = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-power - 1, F.lit(0))), digits)
    plain = bare(F.when(power >= 0, large).otherwise(small))
    shifted = F.concat(bare(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.lit(5)))), F.lit("e"), F.regexp_extract(text, r"e([+-]\d+)$", 1))
    return F.concat(sign, F.when((power >= -4) & (power < 6), plain).otherwise(shifted))


def pretty_number(text: Column) -> Column:
    """A number in powers of ten as people write it: whole with thousands from 1 on, else three digits times ten to a raised power."""
    value, mantissa = text.try_cast("double"), F.regexp_extract(F.format_string("%.2e", text.try_cast("double")), r"^(-?[\d.]+)e", 1)
    power = F.regexp_extract(F.format_string("%.2e", value), r"e([+-]\d+)$", 1).cast("int").cast("string")
    raised = F.translate(power, "-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹")
    shown = F.when(F.abs(value) >= 1, F.format_number(value, 0)).otherwise(F.concat(general(mantissa.cast("double")), F.lit(" × 10"), raised))
    return F.when(F.trim(text).rlike(r"(?i)^-?[\d.]+e[+-]?\d+$") & value.isNotNull(), shown).otherwise(text)


def words(text: Column) -> Column:
    """A table cell for readers: signs spaced, underscores as spaces."""
    for sign, shown in ((">=", "≥ "), ("<", "< "), ("_", " "), ("  ", " ")):
        text = F.replace(text, F.lit(sign), F.lit(shown))
    return F.trim(text)
