"""Plans of several operators."""

from .trees import bushy, intersect_distinct, join_then_group, left_deep, right_deep

__all__ = ["bushy", "intersect_distinct", "join_then_group", "left_deep", "right_deep"]
