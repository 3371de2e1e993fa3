"""Filter, column-block transpose, row multiplication and random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate is true (not false, not null)."""
    return df.filter(predicate)


def transpose(df: DataFrame, index: int) -> DataFrame:
    """Column block [0, index) changes places with [index, 2 index)."""
    names = df.columns
    if not 0 < 2 * index <= len(names):
        raise ValueError(f"two blocks of {index} columns don't fit into {len(names)}")
    return df.select(*names[index : 2 * index], *names[:index], *names[2 * index :])


def multiply(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times in succession."""
    if times < 1:
        return df.limit(0)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__copy")


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    """A random permutation of the rows, the same for a seed and a layout."""
    return df.orderBy(F.rand(seed))


def hash_partition(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows dealt to partitions by the hash of the keys; empty ones are kept,
    so that two inputs dealt alike stay aligned."""
    return df.repartition(partitions, *keys)
