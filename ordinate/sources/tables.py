"""Literal rows, Parquet scans and sinks, and replayable results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def literal(spark: SparkSession, rows: Iterable[Sequence[int]], arity: int | None = None) -> DataFrame:
    """Rows of long columns c0, c1, ...; shorter ones are filled with 0."""
    given = [tuple(r) for r in rows]
    width = arity if arity is not None else max((len(r) for r in given), default=1)
    schema = ", ".join(f"c{i} long" for i in range(width))
    return spark.createDataFrame([r + (0,) * (width - len(r)) for r in given], schema)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def replayable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept: later uses don't compute it again."""
    kept = df.persist()
    kept.count()
    return kept
