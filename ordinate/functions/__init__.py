"""Aggregate policies and predicates."""

from .aggregates import Avg, Count, Max, Min, Sum, custom

__all__ = ["Avg", "Count", "Max", "Min", "Sum", "custom"]
