"""Lists of key columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


def prefix(df: DataFrame, n: int) -> list[str]:
    """The first ``n`` columns."""
    if not 0 <= n <= len(df.columns):
        raise ValueError(f"a prefix of {n} of {len(df.columns)} columns")
    return df.columns[:n]


def key_list(df: DataFrame, keys: Sequence[str] | int | None) -> list[str]:
    """Names, a prefix length, or all columns."""
    if keys is None:
        return list(df.columns)
    found = prefix(df, keys) if isinstance(keys, int) else list(keys)
    if missing := [k for k in found if k not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return found


@dataclass(frozen=True)
class Split:
    """A sort key cut into A, B and C."""

    a: tuple[str, ...]
    b: tuple[str, ...]
    c: tuple[str, ...] = ()

    @property
    def abc(self) -> list[str]:
        return [*self.a, *self.b, *self.c]

    @property
    def acb(self) -> list[str]:
        return [*self.a, *self.c, *self.b]
