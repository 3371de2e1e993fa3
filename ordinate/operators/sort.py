"""Sorting: all columns, a prefix, a list; with early duplicate removal; and
changing a sort order from (A, B, C) to (A, C, B). Ascending, nulls first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .keys import Split, key_list

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33


def sort(df: DataFrame, keys: Sequence[str] | int | None = None) -> DataFrame:
    """Sorted on all columns, a prefix or a list."""
    return df.orderBy(*key_list(df, keys))


def sort_run(df: DataFrame, keys: Sequence[str] | int | None = None) -> DataFrame:
    """Each partition sorted by itself."""
    return df.sortWithinPartitions(*key_list(df, keys))


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, as they lie: partition after partition and
    row after row. Written once, since sampled ranges must not be made twice; the
    sizes of partitions (one row each) are broadcast."""
    own = written(df.withColumn("__id", F.monotonically_increasing_id()), "places")
    part = F.shiftright("__id", _ROW_BITS)
    sizes = own.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = own.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + within + 1).drop("__id", "__part", "__before")


def sort_distinct(df: DataFrame, keys: Sequence[str] | int | None = None) -> DataFrame:
    """Sorted, one row for each key. With all columns as key, duplicates are
    removed before the shuffle; else the row that is least on all columns stays."""
    names = key_list(df, keys)
    if set(names) == set(df.columns):
        return df.distinct().orderBy(*names)
    rest = [c for c in df.columns if c not in names]
    least = df.groupBy(*names).agg(F.min(F.struct(*rest)).alias("__rest"))
    return least.select(*names, "__rest.*").select(*df.columns).orderBy(*names)


def resort(df: DataFrame, split: Split, strategy: str = "segmented") -> DataFrame:
    """Rows sorted by A, B, C, sorted anew by A, C, B.

    ``segmented`` keeps rows of equal A together and sorts within partitions
    that are ranges of A, so that only A is sampled and compared across
    partitions; ``unsegmented`` sorts on all keys; ``runs_ignored`` ranks within
    each segment, which suits many small segments. All give the same order.
    """
    if strategy == "unsegmented":
        return df.orderBy(*split.acb)
    if strategy == "segmented":
        return df.repartitionByRange(*split.a).sortWithinPartitions(*split.acb)
    if strategy == "runs_ignored":
        place = F.row_number().over(Window.partitionBy(*split.a).orderBy(*split.c, *split.b))
        return df.withColumn("__place", place).orderBy(*split.a, "__place").drop("__place")
    raise ValueError(f"unknown strategy {strategy!r}")


def segment_counts(df: DataFrame, split: Split) -> DataFrame:
    """segments (distinct A) and runs (distinct A, B) of sorted input."""
    runs = df.groupBy(*split.a, *split.b).agg(F.lit(1).alias("__one"))
    return runs.groupBy(*split.a).agg(F.count(F.lit(1)).alias("__runs")).agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("__runs"), F.lit(0)).alias("runs"))
