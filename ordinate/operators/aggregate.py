"""GROUP BY on a key prefix or list with one or more aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate
from .keys import key_list


def group_by(df: DataFrame, keys: Sequence[str] | int, *aggregates: Aggregate, strategy: str = "hash") -> DataFrame:
    """The keys and one column for each aggregate.

    ``hash`` aggregates partially, shuffles and finishes, in no order. ``sort``
    does the same and sorts the groups. ``stream`` finds
    groups in sorted partitions, one after another, without a hash table, first
    in each partition as it comes and again after the partial groups have moved:
    memory doesn't grow with the number of groups. At least one key is
    needed; empty input has no groups. Null keys count as equal. Without aggregates
    the distinct keys are returned.
    """
    names = key_list(df, keys)
    if not names:
        raise ValueError("grouping needs a key")
    if not aggregates:
        return df.select(*names).distinct()
    if strategy in ("hash", "sort"):
        grouped = df.groupBy(*names).agg(*(a.column() for a in aggregates))
        return grouped.orderBy(*names) if strategy == "sort" else grouped
    if strategy == "stream":
        # a buffer that holds text can't be changed in place, so that the planner sorts instead of hashing
        grouped = df.groupBy(*names).agg(*(a.column() for a in aggregates), F.max(F.lit("")).alias("__text"))
        return grouped.filter(F.col("__text").isNotNull()).drop("__text")
    raise ValueError(f"unknown strategy {strategy!r}")

