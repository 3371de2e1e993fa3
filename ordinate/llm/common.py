"""Shared pieces of the text operators: shared storage, batch helpers, row keys."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.storage import discard, release, shared_path, shared_root, written

__all__ = ["as_batch", "components", "crc_bucket", "discard", "large_or_small", "list_array", "modest", "narrowed", "release", "screened", "shared_path", "shared_root", "sliced", "written"]


def crc_bucket(column, modulus: int):
    """crc32 of the id as text, mod ``modulus`` (null stays null)."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


#: Rows of an Arrow batch: with long texts, Spark's 10,000 take much memory on both sides.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS``, if they are larger."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def given_back() -> None:
    """Returns memory that a worker has freed to the system: idle workers stay."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batches, rows: int = 256):
    """Arrow batches cut to few rows, so that a worker's Python copies stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    batch = None
    given_back()


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def large_or_small(array: pa.Array) -> pa.Array:
    """Plain (32-bit offset) strings or binaries, whatever Spark has sent."""
    if pa.types.is_large_string(array.type):
        return array.cast(pa.string())
    if pa.types.is_large_binary(array.type):
        return array.cast(pa.binary())
    return array


def list_array(values, offsets, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Bits of the fixed-size filter of ids that ``narrowed`` sends to all tasks (1 MB as a table of 65,536 rows).
ID_FILTER_BITS = 1 << 22


def screened(rows: DataFrame, ids: DataFrame, column: str, filter_bits: int = ID_FILTER_BITS) -> DataFrame:
    """``rows`` and ``__maybe``: false only where ``column`` is surely not in
    ``ids``. A Bloom filter of fixed size, made of ``ids`` by bit-wise
    aggregation, goes to all tasks; ``rows`` aren't shuffled."""
    place = F.pmod(F.xxhash64(F.lit(7), F.col(column)), F.lit(filter_bits))
    words = ids.select(place.alias("__p")).select(F.shiftright("__p", 6).alias("__word"), F.expr("shiftleft(1L, cast(__p & 63 as int))").alias("__bit"))
    bits = words.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    placed = rows.withColumn("__p", place).withColumn("__word", F.shiftright("__p", 6)).join(F.broadcast(bits), "__word", "left")
    return placed.withColumn("__maybe", F.expr("coalesce((shiftright(__bits, cast(__p & 63 as int)) & 1) = 1, false)")).drop("__p", "__word", "__bits")


def narrowed(rows: DataFrame, ids: DataFrame, column: str, filter_bits: int = ID_FILTER_BITS) -> DataFrame:
    """``rows`` joined with ``ids`` on ``column``; most rows that can't match are
    dropped before the join shuffles them. (An inner join: a semi join would be
    pushed below the filter.)"""
    return screened(rows, ids, column, filter_bits).filter("__maybe").drop("__maybe").join(ids, column)


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _forest(batches):
    """Each batch's edges, as stars of what they connect."""
    for batch in batches:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := above.setdefault(x, x)) != x:
                above[x] = above[up]
                x = above[x]
            return x

        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
        stars = [(x, r) for x in list(above) if (r := root(x)) != x]
        if stars:
            yield as_batch(_EDGES, *(list(x) for x in zip(*stars)))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (a, b) reaches.

    Alternating large and small stars, after each batch of edges has been made
    stars by itself. Each round's edges are written; neither links nor
    components come to the driver, only whether all of them are stars yet.
    """
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    current = written(edges.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    while True:
        ends = current.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(current.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)")
        if open_ends.isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v")
        before, current = current, written(small.distinct(), "edges")
        discard(before)
