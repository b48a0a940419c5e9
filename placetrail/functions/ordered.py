"""Sums and positions along a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of one range of the order on average, and of a table that is not cut into ranges.
ROWS_A_RANGE, SMALL = 50_000, 10_000


def is_small(table: DataFrame, rows_a_range: int) -> bool:
    """Whether the table is one range; at most SMALL rows and one are counted."""
    most = min(rows_a_range, SMALL)
    return table.select(F.lit(1)).limit(most + 1).count() <= most


def running_sums(table: DataFrame, order: list[Column], sums: dict[str, Column], rows_a_range: int = ROWS_A_RANGE, *, by: tuple[str, ...] = ()) -> DataFrame:
    """table plus, under every name of `sums`, the sum of that column over the rows before in `order` (0 for the first row), with `by` those of one group.

    Rows are dealt out by ranges of the order and summed inside each range; the ranges' totals, one row a range (and group), are summed in
    turn and added, so a group of any size is many tasks. Rows that tie in the whole order stand in one range, so the order should end in a key. `sums` of
    lit(1) numbers the rows. A small table is one range, and nothing is written.
    """
    names, order = list(sums), [*map(F.col, by), *order]
    values = table.withColumns({f"_{n}": c for n, c in sums.items()})
    past = lambda n, w: F.coalesce(F.sum(f"_{n}").over(w), F.lit(0))
    before = lambda at, keys: W.partitionBy(*keys).orderBy(*at).rowsBetween(W.unboundedPreceding, -1)
    if is_small(table, rows_a_range):
        return values.withColumns({n: past(n, before(order, by)) for n in names}).select(*table.columns, *names)
    ranges = max(1, -(-table.count() // rows_a_range))
    ranged = cut(values.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    groups = {f"_by{i}": F.col(c) for i, c in enumerate(by)}
    bases = totals.select(F.col("_range").alias("_r"), *[c.alias(n) for n, c in groups.items()], *[past(n, before(["_range"], by)).alias(f"_base_{n}") for n in names])
    inside = ranged.withColumns({n: past(n, before(order, ("_range", *by))) for n in names})
    same = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    summed = inside.join(bases, same).withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in names})
    return summed.select(*table.columns, *names)
