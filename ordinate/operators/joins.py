"""Left semi joins on key columns, and plans made of them.

Left duplicates stay, each left row comes out once at most, and null keys match
nothing. ``merge`` sorts both sides, ``hash`` builds a table of the right side,
``broadcast`` sends the right side to all tasks if the optimizer's size estimate
is within ``BROADCAST_BYTES`` and else leaves the choice open, as ``auto`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
_HINTS = {"merge": "merge", "hash": "shuffle_hash"}


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _joined(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str], how: str, strategy: str) -> DataFrame:
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    if not pairs:
        raise ValueError("a join needs a key")
    keys = right.select(*(F.col(r).alias(f"__r{i}") for i, (_, r) in enumerate(pairs)))
    if strategy == "broadcast":
        keys = F.broadcast(keys) if estimated_bytes(keys) <= BROADCAST_BYTES else keys
    elif strategy in _HINTS:
        keys = keys.hint(_HINTS[strategy])
    elif strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    condition = None
    for i, (k, _) in enumerate(pairs):
        equal = left[k] == keys[f"__r{i}"]
        condition = equal if condition is None else condition & equal
    return left.join(keys, condition, how)


def left_semi(left: DataFrame, right: DataFrame, on: Sequence, strategy: str = "auto") -> DataFrame:
    """Left rows with a match; ``on`` has names or (left, right) pairs."""
    return _joined(left, right, on, "left_semi", strategy)


def left_anti(left: DataFrame, right: DataFrame, on: Sequence, strategy: str = "auto") -> DataFrame:
    """Left rows without a match (an extension)."""
    return _joined(left, right, on, "left_anti", strategy)


def left_semi_prefix(left: DataFrame, right: DataFrame, n: int, strategy: str = "auto") -> DataFrame:
    """Left semi join on the first ``n`` columns of both sides, by position."""
    return left_semi(left, right, list(zip(left.columns[:n], right.columns[:n], strict=True)), strategy)
