"""Data-quality checks; each returns one row with its findings.

Order is checked as it lies: within each partition one row after another, and
from each partition's last row to the next one's first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from . import codes
from .adjacent import compare, rows_before
from .keys import key_list
from .sort import placed


def _rank(row: tuple) -> tuple:
    """Nulls first, NaN last."""
    return tuple((v is not None, v != v, 0 if v is None or v != v else v) for v in row)


def _pairs(names: list[str], strict: bool):
    def run(batches):
        import pickle

        from pyspark import TaskContext

        first = last = None
        count = bad = 0
        for batch, own, before, starts in rows_before(batches, names):
            same, wrong = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for x, y in zip(before, own):
                equal, greater = compare(x, y)
                wrong |= same & greater
                same &= equal
            found = wrong | same if strict else wrong
            bad += int(found[1:].sum() if starts else found.sum())
            if starts:
                first = _rank(tuple(c[0].as_py() for c in own))
            last, count = _rank(tuple(c[-1].as_py() for c in own)), count + batch.num_rows
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [part], "rows": [count], "bad": [bad], "ends": [pickle.dumps((first, last))]}, pa.schema([("part", pa.int64()), ("rows", pa.int64()), ("bad", pa.int64()), ("ends", pa.binary())]))

    return run


def order_violations(df: DataFrame, keys: Sequence[str] | int | None = None, *, strict: bool = False) -> DataFrame:
    """rows and violations: adjacent rows out of order (or equal, if ``strict``).
    One row for each partition comes to the driver."""
    import pickle

    shape = StructType([StructField("part", LongType()), StructField("rows", LongType()), StructField("bad", LongType()), StructField("ends", BinaryType())])
    names = key_list(df, keys)
    found = sorted(df.select(*names).mapInArrow(_pairs(names, strict), shape).collect(), key=lambda r: r.part)
    bad, last = sum(r.bad for r in found), None
    for r in found:
        if r.rows:
            first, own = pickle.loads(bytes(r.ends))
            bad += last is not None and (last > first or (strict and last == first))
            last = own
    return df.sparkSession.createDataFrame([(sum(r.rows for r in found), int(bad))], "rows long, violations long")


def is_sorted(df: DataFrame, keys: Sequence[str] | int | None = None) -> bool:
    return order_violations(df, keys).first().violations == 0


def is_sorted_unique(df: DataFrame) -> bool:
    return order_violations(df, strict=True).first().violations == 0


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """violations: rows that one side has more often than the other."""
    extra = left.exceptAll(right).select(F.lit(1).alias("one")).unionByName(right.exceptAll(left).select(F.lit(1).alias("one")))
    return extra.agg(F.count("one").alias("violations"))


def position_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """violations: places at which the rows of two DataFrames differ, as they
    lie; columns are matched by position. Both are written once with their
    places and joined on them."""
    if len(left.columns) != len(right.columns):
        raise ValueError("different numbers of columns")
    n = len(left.columns)
    x, y = placed(left.toDF(*(f"x{i}" for i in range(n))), "at"), placed(right.toDF(*(f"y{i}" for i in range(n))), "at")
    same = F.col("here") & F.col("there")
    for i in range(n):
        same &= F.col(f"x{i}").eqNullSafe(F.col(f"y{i}"))
    both = x.withColumn("here", F.lit(True)).join(y.withColumn("there", F.lit(True)), "at", "full")
    return both.agg(F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("violations"))


def is_equal(left: DataFrame, right: DataFrame) -> bool:
    """Equal row by row, in order."""
    return len(left.columns) == len(right.columns) and position_differences(left, right).first().violations == 0


def code_violations(coded: DataFrame, keys: Sequence[str], *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """violations: rows whose offset or value isn't what deriving it gives."""
    plain = coded.withColumnsRenamed({"offset": "__offset", "value": "__value"}).drop("part", "code")
    again = codes.derive(plain, keys, tiebreak=tiebreak)
    wrong = ~(F.col("offset").eqNullSafe(F.col("__offset")) & F.col("value").eqNullSafe(F.col("__value")))
    return again.agg(F.count(F.when(wrong, 1)).alias("violations"))
