"""Bounded training samples: which labelled rows a classifier is fitted on.

A classifier is fitted on at most about `per_class` documents of each class. Documents are chosen by a seeded hash of
doc_id, at a rate taken from the class's full count, so the choice is even over the table and the same in every
run; the first document of that order is chosen from every class, however rare. Texts above `max_chars` are left out of the sample (not of
scoring); with about `ALL_CLASSES` documents in all classes, this bounds what the driver holds.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

if TYPE_CHECKING:
    import pandas as pd

UNIT = 1 << 30
#: Documents of a sample in all classes, as long as that leaves each class one; and the most classes that can be learned.
ALL_CLASSES, CLASSES = 6000, 10_000


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo `mod`; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(UNIT)) / F.lit(float(UNIT))


def labelled_sample(docs: DataFrame, keys: DataFrame, label: str, per_class: int, max_chars: int, seed: int, also: tuple[str, ...] = ()) -> pd.DataFrame:
    """About per_class rows at most (doc_id, text, label, `also`) of each label in keys(doc_id, label), and one of each at least, in doc_id order.

    A doc_id counts once, however many rows it has: with the smallest of its sampled labels and its smallest text. `keys` is thinned
    to the sample first; only that bounded table is broadcast against the documents, so no text is shuffled but the sample's. More than CLASSES
    labels are an error.
    """
    import pandas as pd

    place = unit_hash(F.col("doc_id"), seed=seed)
    counts = cut(keys.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    classes = counts.count()
    if not classes:
        return pd.DataFrame({name: pd.Series(dtype=object) for name in ("doc_id", "text", label, *also)})
    if classes > CLASSES:
        raise ValueError(f"{classes} labels; {CLASSES} can be learned")
    most = min(per_class, max(1, ALL_CLASSES // classes))
    rates = counts.select(label, F.greatest(F.lit(most) / F.col("n"), "first").alias("rate"))
    chosen = keys.join(F.broadcast(rates), label).filter(place <= F.col("rate")).groupBy("doc_id").agg(F.min(label).alias(label))
    texts = docs.select("doc_id", "text", *also).filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    one = F.min(F.struct("text", *also)).alias("one")
    out = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(one).select("doc_id", label, "one.*")
    return out.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
