"""How each row differs from the one before it in sort order.

A coded row has ``offset``, the number of leading keys equal to its
predecessor's, and ``value``, its own key at that place (null for duplicates).
The first row has offset 0. Codes are derived for a DataFrame of any size: rows
are cut into ranges and sorted, each partition is coded as it streams by, and the
first row of each range is coded against the last one of the nearest range before
it that has rows. Input columns named ``part``, ``offset``, ``value`` or ``code``
give way to those of the result and can't be keys.

``code`` is (keys - offset, value): of two rows coded against the same base, the
one with the greater code sorts later, and the greatest code of dropped rows and
of the survivor after them is the survivor's new code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.aggregates import Aggregate
from ..storage import written
from .adjacent import compare, rows_before
from .keys import Split, key_list

VALUE_BITS, ARITY = 25, 32


def _first_difference(keys: Sequence[str], before: str) -> Column:
    """Number of leading keys equal to those in the struct ``before``."""
    out = F.lit(len(keys))
    for i in range(len(keys) - 1, -1, -1):
        out = F.when(~F.col(keys[i]).eqNullSafe(F.col(f"{before}.k{i}")), F.lit(i)).otherwise(out)
    return F.when(F.col(before).isNull(), F.lit(0)).otherwise(out)


def _key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))


def _offsets(names: list[str]):
    def run(batches):
        for batch, own, before, first in rows_before(batches, names):
            same, offset = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, np.int32)
            for x, y in zip(before, own):
                same &= compare(x, y)[0]
                offset += same
            unknown = np.zeros(batch.num_rows, bool)
            unknown[0] = first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset, mask=unknown)], [*batch.schema.names, "__streamed"])

    return run


def applied(df: DataFrame, keys: Sequence[str] | int | None = None) -> DataFrame:
    """``derive`` for input that is sorted on the keys as it lies, from partition
    to partition: no shuffle and no sort. The order isn't checked."""
    names = key_list(df, keys)
    if taken := {"part", "offset", "value", "code"} & set(names):
        raise ValueError(f"keys named as columns of the result: {sorted(taken)}")
    own = df.drop("part", "offset", "value", "code").withColumn("part", F.spark_partition_id())
    shape = StructType([*own.schema, StructField("__streamed", IntegerType())])
    # written: ranges are found by sampling, so they must not be made twice
    placed = written(own.mapInArrow(_offsets(names), shape), "ranges")
    lasts = placed.groupBy("part").agg(F.max(_key_struct(names)).alias("last"))
    # one row for each range: their number doesn't grow with the rows
    carried = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("__carried"))
    offset = F.coalesce("__streamed", _first_difference(names, "__carried"))
    based = placed.join(F.broadcast(carried), "part").withColumn("offset", offset)
    return _with_code(based, names).drop("__streamed", "__carried")


def _with_code(based: DataFrame, names: Sequence[str]) -> DataFrame:
    value = F.lit(None)
    for i in range(len(names) - 1, -1, -1):
        value = F.when(F.col("offset") == i, F.col(names[i])).otherwise(value)
    return based.withColumn("value", value).withColumn("code", F.struct((F.lit(len(names)) - F.col("offset")).alias("left"), F.col("value")))


def derive(df: DataFrame, keys: Sequence[str] | int | None = None, *, tiebreak: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``part`` (its range), ``offset``, ``value`` and ``code``.
    ``tiebreak`` columns order rows with equal keys without being coded; with
    them, rows of one frequent key may lie in several ranges."""
    names = key_list(df, keys)
    order = [*names, *tiebreak]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return applied(ranged.sortWithinPartitions(*order), names)


def packed(arity: int = ARITY) -> Column:
    """Offset and value in one number: (arity - offset) above ``VALUE_BITS`` bits
    of value, 0 for duplicates. Raises where a value doesn't fit."""
    wide = F.when((F.col("value") < 0) | (F.col("value") >= 1 << VALUE_BITS), F.raise_error(F.lit("a value needs more than 25 bits"))).otherwise(F.col("value").cast("long"))
    number = F.shiftleft((F.lit(arity) - F.col("offset")).cast("long"), VALUE_BITS).bitwiseOR(wide)
    return F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(number)


def repaired(coded: DataFrame, kept: Column, keys: Sequence[str], *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The rows for which ``kept`` is true, their codes repaired by the maximum
    rule instead of being derived anew."""
    flagged = coded.withColumn("__kept", F.coalesce(kept, F.lit(False)).cast("int"))
    earlier = Window.partitionBy("part").orderBy(*keys, *tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    grouped = flagged.withColumn("__group", F.coalesce(F.sum("__kept").over(earlier), F.lit(0)))
    runs = grouped.groupBy("part", "__group").agg(F.max("code").alias("__most"), F.max("__kept").alias("__ends"))
    # what is dropped after a range's last survivor counts for the next range's first
    tails = runs.filter("__ends = 0").select("part", F.col("__most").alias("__tail"))
    ranges = runs.groupBy("part").agg(F.max("__ends").alias("any")).join(tails, "part", "left")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranges.withColumn("incl", F.sum("any").over(upto)).withColumn("excl", F.col("incl") - F.col("any"))
    x, y = numbered.select(F.col("part").alias("p"), "excl"), numbered.select(F.col("part").alias("q"), "incl", "__tail")
    carried = x.join(y, (F.col("excl") == F.col("incl")) & (F.col("q") < F.col("p"))).groupBy("p").agg(F.max("__tail").alias("__carry"))
    most = Window.partitionBy("part", "__group")
    joined = grouped.withColumn("__most", F.max("code").over(most)).filter("__kept = 1").join(F.broadcast(carried), F.col("part") == F.col("p"), "left").drop("p")
    new = F.when(F.col("__group") == 0, F.greatest("__most", F.coalesce("__carry", "__most"))).otherwise(F.col("__most"))
    done = joined.withColumn("code", new).withColumn("offset", F.lit(len(keys)) - F.col("code.left")).withColumn("value", F.col("code.value"))
    return done.drop("__kept", "__group", "__most", "__carry")


def distinct(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that aren't duplicates of their predecessor on the coded keys."""
    return coded.filter(F.col("offset") < len(keys))


def boundaries(coded: DataFrame, n: int) -> DataFrame:
    """First rows of groups on the first ``n`` keys: offset < n."""
    return coded.filter(F.col("offset") < n)


def semi(coded: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], keys: Sequence[str], *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Left semi join of coded rows on (left, right) names, its result coded by
    repair. Null keys match nothing."""
    theirs = right.select(*(F.col(r).alias(f"__r{i}") for i, (_, r) in enumerate(on))).distinct().withColumn("__met", F.lit(True))
    condition = None
    for i, (k, _) in enumerate(on):
        equal = coded[k] == theirs[f"__r{i}"]
        condition = equal if condition is None else condition & equal
    flagged = coded.join(theirs, condition, "left").drop(*(f"__r{i}" for i in range(len(on))))
    return repaired(flagged, F.col("__met"), keys, tiebreak=tiebreak).drop("__met")


def _numbered(coded: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Coded rows with the number of their group on the first ``n`` keys in
    ``__group``, and the offset of the group's first row in ``__head``, both from
    the codes alone. Groups may go on over several ranges."""
    starts = F.col("offset") < n
    latest = F.max(F.when(starts, F.struct(_key_struct(order).alias("at"), "offset")))
    ranges = coded.groupBy("part").agg(F.sum(starts.cast("long")).alias("__n"), latest["offset"].alias("__latest"))
    # one row for each range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), F.last("__latest", True).over(earlier).alias("__latest"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = coded.withColumn("__own", F.sum(starts.cast("long")).over(upto)).withColumn("__head", F.last(F.when(starts, F.col("offset")), True).over(upto))
    whole = own.join(F.broadcast(before), "part").withColumn("__group", F.col("__own") + F.col("__n")).withColumn("__head", F.coalesce("__head", "__latest"))
    return whole.drop("__own", "__n", "__latest")


def group_by(coded: DataFrame, keys: Sequence[str], n: int, *aggregates: Aggregate, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Groups on the first ``n`` of the coded keys, found by their codes: a row
    with offset < n starts one, and keys are compared no more. Aggregates are
    partial in each partition before groups of several ranges meet."""
    if not 0 < n <= len(keys):
        raise ValueError(f"{n} of {len(keys)} keys")
    numbered = _numbered(coded, n, [*keys, *tiebreak])
    grouped = numbered.groupBy("__group").agg(*(F.first(k).alias(f"__k{i}") for i, k in enumerate(keys[:n])), *(a.column() for a in aggregates)).drop("__group")
    return grouped.withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys[:n])})


def resort(coded: DataFrame, split: Split, *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Rows coded on A, B, C, sorted and coded anew on A, C, B. Segments come from
    the codes: A is compared no more, and the first row of a segment keeps the
    offset that the segment's first row had."""
    a, rest = len(split.a), [*split.c, *split.b]
    numbered = _numbered(coded, a, [*split.abc, *tiebreak])
    again = derive(numbered, ["__group", *rest], tiebreak=tiebreak)
    offset = F.when(F.col("offset") == 0, F.col("__head")).otherwise(F.col("offset") - 1 + a)
    return _with_code(again.withColumn("offset", offset), split.acb).drop("__group", "__head")


def truncation_cost(coded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """column_comparisons: keys looked at to code each row but the first."""
    n = len(keys)
    total = coded.agg(F.sum(F.least(F.col("offset") + 1, F.lit(n)).cast("long")).alias("s"))
    return total.select(F.coalesce(F.col("s") - 1, F.lit(0)).cast("long").alias("column_comparisons"))
