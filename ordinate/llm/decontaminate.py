"""Benchmark decontamination by pigeonhole edit matching.

Texts are folded to lower-case words with single spaces. A test item with an
error budget of e edits is split into e + 1 pieces: whatever e edits do, one
piece stays whole. An automaton finds the pieces in the documents, and each hit
is verified with Myers' bit-parallel distance of the whole item to the text
around it. A document holds an item if some span is within the budget.

Items are taken in blocks of at most ``BLOCK_CHARS`` characters (a longer item is
a block by itself). The driver holds one block at a time; each is sent to all
tasks, met by all documents, and taken back once what it found is written, so
that what is sent is bounded however large the benchmark is.

Null and empty texts hold nothing; items that fold to fewer than ``LEAST_CHARS``
characters (also null ones) are held by nothing. Items that repeat are reported
under each id. Of equally near spans the first is reported. Very long texts are
searched whole, by time in proportion to their length and hits. Repeated document
rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, discard, sliced, written

#: Edits allowed for each character of an item; characters an item needs.
ERROR_SHARE, LEAST_CHARS = 0.08, 32
BLOCK_CHARS = 4_000_000

_OTHER = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def budget(item: str) -> int:
    return int(len(item) * ERROR_SHARE)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their places."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Myers:
    """Least edit distance of a pattern to any part of a text, in Python's long
    integers: one bit for each character of the pattern."""

    def __init__(self, pattern: str):
        self.size, self.masks = len(pattern), {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance and the first end (exclusive) that has it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, masks = full, 0, self.size, self.masks
        least, at = score, 0
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            hp, hn = (minus | ~(d0 | plus)) & full, plus & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            if score < least:
                least, at = score, i
                if not least:
                    break
            hp = hp << 1 & full
            plus, minus = (hn << 1 | ~(d0 | hp)) & full, hp & d0
        return least, at


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t) for i, t in items if len(t) >= LEAST_CHARS]
        self.errors = [budget(t) for _, t in self.items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, self.errors[n]):
                by_piece.setdefault(piece, []).append((n, at))
        self.patterns: dict[int, tuple[Myers, Myers]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()

    def pattern(self, n: int) -> tuple[Myers, Myers]:
        if n not in self.patterns:
            self.patterns[n] = Myers(self.items[n][1]), Myers(self.items[n][1][::-1])
        return self.patterns[n]

    def held(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item that the text holds;
        places are in the folded text."""
        flat = folded(text)
        if not self.items or len(flat) < LEAST_CHARS // 2:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(flat):
            for n, at in where:
                starts.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, found in starts.items():
            (item_id, item), errors = self.items[n], self.errors[n]
            windows: list[list[int]] = []
            for s in sorted(found):
                low, high = max(0, s - errors), min(len(flat), s + len(item) + errors)
                if windows and low <= windows[-1][1] - len(item):
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            best = None
            for low, high in windows:
                distance, end = self.pattern(n)[0].best(flat[low:high])
                if distance <= errors and (best is None or distance < best[1]):
                    _, back = self.pattern(n)[1].best(flat[low : low + end][::-1])
                    best = (item_id, distance, low + end - back, low + end)
            if best:
                out.append(best)
        return out


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The folded items, block after block, and whether it is the last one.
    Items reach the driver one by one."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).orderBy("i", "t").toLocalIterator():
        text = folded(r.t)
        if block and size + len(text) > BLOCK_CHARS:
            yield block, False
            block, size = [], 0
        block.append((r.i, text))
        size += len(text)
    yield block, True


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each item that a
    document holds."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block, last in blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(_scan(shared), "doc_id long, item_id long, distance int, start int, end int")
        if not last:
            found = written(found, "hits")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def flagged(docs: DataFrame, benchmark: DataFrame, *, flag_col: str = "__held", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and whether the text holds any item."""
    spark, out, before = docs.sparkSession, docs.withColumn(flag_col, F.lit(False)), None
    at = docs.columns.index(text_col)
    for block, last in blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value)
            for batch in sliced(batches, 512):
                held = [h or bool(matcher.held(t)) for t, h in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.bool_())], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
        if not last:
            out = written(out, "flags")
            shared.destroy()
            if before is not None:
                discard(before)
            before = out
    return out


def _scan(shared):
    def run(batches):
        matcher = Matcher(shared.value)
        for batch in sliced(batches, 512):
            found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.held(t)]
            if found:
                yield as_batch(_HITS, *(list(x) for x in zip(*found)))

    return run


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
