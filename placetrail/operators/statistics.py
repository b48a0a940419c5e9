"""Statistics as grouped DataFrame operations: distances, correlations, medians, N50, descriptions.

Whatever depends on the order of values works on the distinct values of a group with their counts, and on running sums over ranges of them, so that a group
with most of the rows is neither one task nor one buffer. Nulls in `by` are a group of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sums


def with_totals(df: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """df plus aggregates of each row's group: sums are made before rows meet, and joined back."""
    names = {f"_of_{i}": F.col(c) for i, c in enumerate(by)}
    found = df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]).select(*[c.alias(n) for n, c in names.items()], *totals)
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]
    return (df.join(found, same) if by else df.crossJoin(found)).select(*df.columns, *totals)  # without groups `found` is one row


def ks_distance(samples: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """(by, ks): largest gap of the two samples' distribution functions; `side` is boolean. Null for an empty sample."""
    heights = samples.groupBy(*by, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    below = running_sums(heights, [F.col(value)], {"a_below": F.col("a"), "b_below": F.col("b")}, by=tuple(by))
    whole = with_totals(below, by, {"a_all": F.sum("a"), "b_all": F.sum("b")})
    reached = lambda n: F.try_divide((F.col(f"{n}_below") + F.col(n)).cast("double"), F.col(f"{n}_all"))
    return whole.groupBy(*by).agg(F.max(F.abs(reached("a") - reached("b"))).alias("ks"))


def total_variation(weights: DataFrame, by: list[str], p: str, q: str) -> DataFrame:
    """(by, tv) over aligned categories; null if a side sums to nothing."""
    whole = with_totals(weights, by, {"p_all": F.sum(p), "q_all": F.sum(q)})
    gap = F.abs(F.try_divide(F.col(p).cast("double"), F.col("p_all")) - F.try_divide(F.col(q).cast("double"), F.col("q_all")))
    return whole.groupBy(*by).agg((F.sum(gap) / 2).alias("tv"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 by value, ties sharing their mean; ties are counted, not listed."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties_"))
    ranked = running_sums(ties, [F.col(value)], {name: F.col("ties_")}, by=tuple(by)).withColumn(name, F.col(name) + (F.col("ties_") + 1) / 2.0).drop("ties_")
    return df.join(ranked, [*by, value])


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the exact median of the values that are not null, the mean of the middle two for an even number; null without any."""
    ties = df.groupBy(*by, value).agg(F.count(value).alias("n_"))
    placed = with_totals(running_sums(ties, [F.col(value)], {"below_": F.col("n_")}, by=tuple(by)), by, {"all_": F.sum("n_")})
    holds = lambda place: (F.col("below_") <= place) & (place < F.col("below_") + F.col("n_"))
    low, high = F.floor((F.col("all_") - 1) / 2), F.floor(F.col("all_") / 2)
    middle = lambda place: F.max(F.when(holds(place), F.col(value))).cast("double")
    return placed.groupBy(*by).agg(((middle(low) + middle(high)) / 2).alias(name))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): rank correlation over finite pairs; null below three pairs or for a constant side."""
    finite = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    ranked = average_ranks(average_ranks(finite, by, x, "rank_x"), by, y, "rank_y")
    return pearson(ranked, by, "rank_x", "rank_y").withColumn("rho", F.when(F.col("n") >= 3, F.col("r"))).drop("r")


def pearson(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, r); null for a constant side."""
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(F.col(x).cast("double"), F.col(y).cast("double")).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return sums.select(*by, "n", F.try_divide("c", F.col("sx") * F.col("sy")).alias("r"))


def max_gap(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.abs(F.col(x) - F.col(y))).alias("gap"))


def normalise(df: DataFrame, by: list[str], count: str) -> DataFrame:
    """df plus `share` of each group's sum; equal shares where the sum is 0."""
    whole = with_totals(df, by, {"sum_": F.sum(count), "rows_": F.count(F.lit(1))})
    share = F.coalesce(F.try_divide(F.col(count).cast("double"), F.col("sum_")), F.lit(1.0) / F.col("rows_"))
    return whole.withColumn("share", share).drop("sum_", "rows_")


def n50(lengths: DataFrame, by: list[str], length: str) -> DataFrame:
    """(by, n50): the length from which on longer reads hold half of all bases."""
    pooled = lengths.groupBy(*by, length).agg(F.sum(length).alias("bases"))
    longer = running_sums(pooled, [F.col(length).desc()], {"longer": F.col("bases")}, by=tuple(by))
    reached = with_totals(longer, by, {"all_": F.sum("bases")}).filter(F.col("longer") + F.col("bases") >= F.col("all_") / 2.0)
    return reached.groupBy(*by).agg(F.max(length).alias("n50"))


def describe(reads: DataFrame, by: list[str], length: str, quality: str) -> DataFrame:
    """(by, reads, bases, mean_length, median_length, median_q, n50); nulls in `by` have no medians."""
    out = reads.groupBy(*by).agg(F.count(F.lit(1)).alias("reads"), F.sum(length).alias("bases"), F.avg(length).alias("mean_length"))
    for part in (medians(reads, by, length, "median_length"), medians(reads, by, quality, "median_q"), n50(reads, by, length)):
        out = out.join(part, by, "left") if by else out.crossJoin(part)  # one row each
    return out
