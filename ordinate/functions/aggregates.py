"""Aggregates for ``group_by``: each makes one output column.

Sums raise on overflow of 64 bits instead of wrapping around. ``Avg`` is the
integer quotient of sum and count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class Aggregate:
    """The output column's name, and what makes it: ``make`` is given what turns
    each plain aggregate into one over a window (or leaves it as it is)."""

    name: str
    make: Callable[[Callable[[Column], Column]], Column]

    def column(self, window: WindowSpec | None = None) -> Column:
        return self.make((lambda c: c) if window is None else (lambda c: c.over(window))).alias(self.name)


def Count(name: str = "count") -> Aggregate:
    return Aggregate(name, lambda w: w(F.count(F.lit(1))))


def Sum(column: str, name: str = "sum") -> Aggregate:
    return Aggregate(name, lambda w: w(F.sum(F.col(column).cast("long"))))


def Avg(column: str, name: str = "avg") -> Aggregate:
    return Aggregate(name, lambda w: F.call_function("div", w(F.sum(F.col(column).cast("long"))), w(F.count(column))))


def Max(column: str, name: str = "max") -> Aggregate:
    return Aggregate(name, lambda w: w(F.max(column)))


def Min(column: str, name: str = "min") -> Aggregate:
    return Aggregate(name, lambda w: w(F.min(column)))


def custom(name: str, function: Callable, *columns: str) -> Aggregate:
    """A user's aggregate: ``function`` is a grouped-aggregate pandas UDF."""
    return Aggregate(name, lambda w: w(function(*columns)))
