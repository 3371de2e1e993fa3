"""Rows compared with the rows before them, column by column over Arrow arrays.

Nulls are equal to each other and sort first; NaN is equal to itself and sorts
last, as in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _flags(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(values, False).to_numpy(zero_copy_only=False), dtype=bool)


def compare(before: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where two arrays are equal, and where ``before`` is the greater one."""
    if pa.types.is_nested(own.type):
        pairs = list(zip(before.to_pylist(), own.to_pylist()))
        equal = np.fromiter((a == b for a, b in pairs), bool, len(pairs))
        greater = np.fromiter((a != b and a is not None and (b is None or a > b) for a, b in pairs), bool, len(pairs))
        return equal, greater
    left, right = _flags(before.is_null()), _flags(own.is_null())
    equal, greater = _flags(pc.equal(before, own)), _flags(pc.greater(before, own))
    if pa.types.is_floating(own.type):
        x, y = _flags(pc.is_nan(before)), _flags(pc.is_nan(own))
        equal, greater = equal | (x & y), greater | (x & ~y & ~right)
    return equal | (left & right), greater | (right & ~left)


def rows_before(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], list[pa.Array], bool]]:
    """Batches that have rows, their columns, the same columns one row earlier,
    and whether it is the first one: its first row is set beside itself."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if n:
            own = [batch.column(k) for k in names]
            ahead = last or [c.slice(0, 1) for c in own]
            yield batch, own, [pa.concat_arrays([a, c.slice(0, n - 1)]) for a, c in zip(ahead, own)], last is None
            last = [c.slice(n - 1, 1) for c in own]
