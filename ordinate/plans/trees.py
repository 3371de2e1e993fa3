"""Trees of left semi joins, and joins under grouping or distinct.

A tree is given as one relation and the relations that restrict it; each shape
gives the same rows, so that a caller may choose what fits the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.aggregates import Aggregate
from ..operators.aggregate import group_by
from ..operators.joins import left_semi

#: (relation, keys) that restricts
Step = tuple[DataFrame, Sequence]


def left_deep(first: DataFrame, steps: Sequence[Step], strategy: str = "auto") -> DataFrame:
    """One restriction after another."""
    for right, on in steps:
        first = left_semi(first, right, on, strategy)
    return first


def right_deep(relations: Sequence[DataFrame], keys: Sequence[Sequence], strategy: str = "auto") -> DataFrame:
    """r0 restricted by (r1 restricted by (r2 ...)); ``keys[i]`` joins i and i + 1."""
    right = relations[-1]
    for left, on in zip(reversed(relations[:-1]), reversed(keys)):
        right = left_semi(left, right, on, strategy)
    return right


def bushy(left: tuple[DataFrame, Sequence[Step]], right: tuple[DataFrame, Sequence[Step]], on: Sequence, strategy: str = "auto") -> DataFrame:
    """Both sides restricted by themselves, then one by the other."""
    return left_semi(left_deep(*left, strategy), left_deep(*right, strategy), on, strategy)


def join_then_group(left: DataFrame, right: DataFrame, on: Sequence, keys: Sequence[str], aggregate: Aggregate, *, join: str = "merge", group: str = "hash") -> DataFrame:
    """Semi join, then group: where the group keys hold the join keys, the
    join's partitioning serves both and only one shuffle of each side is made."""
    return group_by(left_semi(left, right, on, join), keys, aggregate, strategy=group)


def intersect_distinct(left: DataFrame, right: DataFrame, strategy: str = "auto") -> DataFrame:
    """Distinct rows of both sides: distinct, then semi join. Rows with nulls
    match nothing, unlike in SQL's INTERSECT."""
    return left_semi(left.distinct(), right.distinct(), list(zip(left.columns, right.columns, strict=True)), strategy)
