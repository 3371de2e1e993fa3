"""Run files: a Spark data source for paged dumps of 64-bit rows.

A page has 4,096 bytes: the number of its rows, then rows of key, tid and 32
columns, all 64-bit numbers in the machine's order. Files split at pages.

    register(spark)
    spark.read.format("runfile").load(path)          # tid, c0 ... c31
    df.write.format("runfile").mode("append").save(folder)
"""

from __future__ import annotations

import glob
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format.
PAGE, ARITY = 4096, 32
ROW = np.dtype([("key", "<u8"), ("tid", "<i8"), ("columns", "<i8", (ARITY,))])
ROWS = (PAGE - 8) // ROW.itemsize
#: Pages of an input partition.
PAGES = 16_384
SCHEMA = "tid long, " + ", ".join(f"c{i} long" for i in range(ARITY))


def pages(data: bytes) -> np.ndarray:
    """The rows of whole pages."""
    count, rest = divmod(len(data), PAGE)
    if rest:
        raise ValueError("a run file ends within a page")
    out = []
    for i in range(count):
        rows = int(np.frombuffer(data, "<u8", 1, i * PAGE)[0])
        if rows > ROWS:
            raise ValueError(f"a page of {rows} rows")
        out.append(np.frombuffer(data, ROW, rows, i * PAGE + 8))
    return np.concatenate(out) if out else np.zeros(0, ROW)


def paged(rows: np.ndarray) -> bytes:
    """Pages with the rows."""
    out = bytearray()
    for at in range(0, len(rows), ROWS):
        part = rows[at : at + ROWS]
        page = np.array([len(part)], "<u8").tobytes() + part.tobytes()
        out += page + bytes(PAGE - len(page))
    return bytes(out)


class _Part(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, missing_is_empty: bool):
        self.path, self.missing = urlparse(path).path, missing_is_empty

    def partitions(self):
        files = sorted(glob.glob(f"{self.path}/*.run")) if os.path.isdir(self.path) else [self.path]
        if not os.path.exists(self.path):
            if not self.missing:
                raise FileNotFoundError(self.path)
            files = []
        found = [_Part(f, at, PAGES) for f in files for at in range(0, -(-os.path.getsize(f) // PAGE), PAGES)]
        return found or [_Part("", 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        with open(partition.path, "rb") as file:
            file.seek(partition.start * PAGE)
            left = partition.count
            while left and (data := file.read(min(left, 512) * PAGE)):
                left -= -(-len(data) // PAGE)
                rows = pages(data)
                names = ["tid", *(f"c{i}" for i in range(ARITY))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["tid"])), *(pa.array(np.ascontiguousarray(rows["columns"][:, i])) for i in range(ARITY))], names=names)


class _Written(WriterCommitMessage):
    def __init__(self, path: str, final: str):
        self.path, self.final = path, final


class _Writer(DataSourceWriter):
    """Each task writes a file of its own; commit gives it its name, so that a
    task that is run again leaves nothing that is read."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = urlparse(path).path, names

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.path}/{uuid.uuid4().hex}"
        columns = [n for n in self.names if n != "tid"]
        with open(f"{name}.part", "wb") as file:
            held = []

            def flush() -> None:
                rows = np.zeros(len(held), ROW)
                for i, r in enumerate(held):
                    rows["tid"][i] = r["tid"] if "tid" in self.names else i
                    rows["columns"][i, : len(columns)] = [r[c] for c in columns]
                file.write(paged(rows))
                held.clear()

            for row in iterator:
                held.append(row)
                if len(held) == 512 * ROWS:
                    flush()
            flush()
        return _Written(f"{name}.part", f"{name}.run")

    def commit(self, messages):
        for m in messages:
            if m:
                os.rename(m.path, m.final)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class RunFiles(DataSource):
    @classmethod
    def name(cls):
        return "runfile"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("missingisempty", "false").lower() == "true")

    def writer(self, schema, overwrite):
        names = [f.name for f in schema.fields]
        if len([n for n in names if n != "tid"]) > ARITY:
            raise ValueError(f"a run file has {ARITY} columns")
        return _Writer(self.options["path"], names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RunFiles)
