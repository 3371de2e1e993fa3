"""Duplicate removal by hashing, by sorting, or over sorted input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import codes
from .keys import key_list
from .sort import sort_distinct


def distinct(df: DataFrame, keys: Sequence[str] | int | None = None, strategy: str = "hash", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row for each key.

    ``hash`` keeps any row of a key, ``sort`` the least one, in order,
    ``stream`` the first in sort order. Null keys count as equal.
    """
    names = key_list(df, keys)
    if strategy == "hash":
        return df.distinct() if set(names) == set(df.columns) else df.dropDuplicates(names)
    if strategy == "sort":
        return sort_distinct(df, names)
    if strategy == "stream":
        return codes.distinct(codes.derive(df, names, tiebreak=tiebreak), names).select(*df.columns)
    raise ValueError(f"unknown strategy {strategy!r}")


def duplicates(df: DataFrame, keys: Sequence[str] | int | None = None) -> DataFrame:
    """num_dupes: rows that ``distinct`` removes."""
    groups = df.groupBy(*key_list(df, keys)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("num_dupes"))


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df``, and the observation that has its row count once it has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("count")), seen
