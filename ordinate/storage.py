"""Intermediate results in the folder that driver and executors share.

``spark.checkpoint.dir`` names it. Where it is empty a temporary folder of this
machine is made and set, in local mode only: on a cluster, executors would write
each to its own disk, so that an error is raised instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths given out by this process and not removed yet.
_GIVEN: dict[str, None] = {}
#: Shuffle files go when the query that made them is done, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="ordinate-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _GIVEN[path] = None
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the
    lineage so that a lost executor costs one re-read, not a recomputation."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(spark: SparkSession, path: str) -> bool:
    _GIVEN.pop(path, None)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Removes what ``written`` returned, once nothing that is still to be
    computed reads it."""
    for df in frames:
        removed(df.sparkSession, df._written_to)


def release(spark: SparkSession) -> int:
    """Removes all that this process has written in the shared folder, once no
    result that is read from it is needed any more. Returns the number of paths."""
    return sum(removed(spark, path) for path in list(_GIVEN))
