"""Line dedup: two Bloom filters screen the lines, only suspected repeats shuffle.

A first pass sets each line key's bits in a filter of keys seen once and, where
the bits are set already, in a filter of keys seen twice. The filters of all
tasks are merged, piece by piece and in two levels: what two tasks have both seen
once has been seen twice. A second pass sends only those lines on that the second
filter knows, by the SHA-256 of their keys; these are then counted, and the document
that keeps them is chosen. A filter may suspect too many lines, never too few, so that the result
is exact. Only documents that lose a line, and few that a filter of ids mistakes
for them, are shuffled to meet their lost lines; all others stay where they lie.

Defined results: a null or empty text is one empty line; a null text stays null.
Documents are told apart by id; rows that repeat an id are treated alike, and
rows with a null id count as no document and keep nothing that others keep.
Extra columns pass through unchanged, whatever their names (but names that begin
with two underscores). Ties can't happen: a line stays in the largest id that
holds it. Very long texts, also with very many lost lines, take time in
proportion to their lines.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import as_batch, discard, large_or_small, screened, sliced, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Filter bits for each document, and the least and most bits of a filter (16 MB).
BITS_A_DOC, LEAST_BITS, MOST_BITS = 256, 1 << 20, 1 << 27
#: Pieces in which filters are merged.
PIECES = 64


def key_of(line: str) -> str:
    return line.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass").strip(SPACE)


def line_keys(text: str | None, min_chars: int) -> set[str]:
    """Keys of at least ``min_chars`` characters of a text's lines."""
    if not text:
        return set()
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return {key for line in lowered.split("\n") if len(key := line.strip(SPACE)) >= min_chars}


def hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def line_hash(key: str) -> int:
    """A key's hash as a signed number, as the shuffles have it."""
    h = xxhash.xxh3_64_intdigest(key)
    return h - (1 << 64) if h >> 63 else h


def key_digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a filter of ``bits`` (a power of two) bits."""
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)


class Filter:
    """A Bloom filter of two bits a key."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def add(self, h: np.ndarray) -> None:
        for at in bit_places(h, self.bits):
            np.bitwise_or.at(self.data, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = bit_places(h, self.bits)
        return (self.data[a >> 3] >> (a & 7).astype(np.uint8)) & (self.data[b >> 3] >> (b & 7).astype(np.uint8)) & np.uint8(1) == 1


_PIECES = pa.schema([("piece", pa.int32()), ("part", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _fill(bits: int, min_chars: int):
    def run(batches):
        once, twice, any_row = Filter(bits), Filter(bits), False
        for batch in sliced(batches, 1024):
            any_row = True
            own, counts = np.unique(hashes(k for t in batch.column(0).to_pylist() for k in line_keys(t, min_chars)), return_counts=True)
            twice.add(own[(counts > 1) | once.has(own)])
            once.add(own)
        if any_row:
            # mostly empty, so that they pack well
            parts = [[zstandard.compress(x.tobytes(), 1) for x in np.array_split(f.data, PIECES)] for f in (once, twice)]
            yield as_batch(_PIECES, list(range(PIECES)), [TaskContext.get().partitionId()] * PIECES, *parts)

    return run


def _merge(table: pa.Table) -> pa.Table:
    once = twice = None
    for packed in zip(table.column("once"), table.column("twice")):
        a, b = (np.frombuffer(zstandard.decompress(x.as_py()), np.uint8) for x in packed)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pa.Table.from_pydict({"piece": [table.column("piece")[0].as_py()], "part": [table.column("part")[0].as_py()], "once": [zstandard.compress(once.tobytes(), 1)], "twice": [zstandard.compress(twice.tobytes(), 1)]}, _PIECES)


def seen_twice(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that more than one document may hold (``bits`` bits,
    so the driver gets at most ``MOST_BITS``). Each task's pieces meet those of
    a few other tasks first, so that no task merges those of all."""
    kind = "piece int, part int, once binary, twice binary"
    filled = texts.mapInArrow(_fill(bits, min_chars), kind)
    few = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    met = filled.withColumn("part", F.pmod("part", F.lit(few))).groupBy("piece", "part").applyInArrow(_merge, kind)
    rows = {r.piece: zstandard.decompress(r.twice) for r in met.groupBy("piece").applyInArrow(_merge, kind).select("piece", "twice").collect()}
    sizes = [len(x) for x in np.array_split(np.zeros(bits // 8, np.uint8), PIECES)]
    return np.concatenate([np.frombuffer(rows[i], np.uint8) if i in rows else np.zeros(n, np.uint8) for i, n in enumerate(sizes)])


_SUSPECTS = pa.schema([("doc_id", pa.int64()), ("ref", pa.int64()), ("line", pa.int64()), ("key", pa.binary())])


def _screen(twice, bits: int, min_chars: int):
    def run(batches):
        known = Filter(bits, twice.value)
        for batch in sliced(batches, 1024):
            rows, keys = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = list(line_keys(text, min_chars))
                rows += [i] * len(own)
                keys += own
            h = hashes(keys)
            at = np.flatnonzero(known.has(h))
            if len(at):
                docs = pa.array(np.array(rows)[at])
                yield as_batch(_SUSPECTS, batch.column(0).take(docs), batch.column(1).take(docs), h[at].view(np.int64), [key_digest(keys[i]) for i in at])

    return run


def filter_bits(n_docs: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n_docs * BITS_A_DOC - 1).bit_length()))


def _ref(id_col: str, text_col: str):
    """What a row's lost lines are joined on: its id or, without one, its text's hash."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))


def repeated_lines(docs: DataFrame, *, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """key (its digest), doc_id, ref, line (the key's hash), keeper: documents that
    lose a line, and who keeps it; and what that is read from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _ref(id_col, text_col).alias("ref"), F.col(text_col).alias("text"))
    bits = filter_bits(rows.count())
    twice = spark.sparkContext.broadcast(seen_twice(rows.select("text"), bits, min_chars))
    suspects = written(rows.mapInArrow(_screen(twice, bits, min_chars), "doc_id long, ref long, line long, key binary"), "suspects")
    # written, so that the join below can split a key that very many documents hold
    confirmed = written(suspects.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs).select("key", "keeper"), "confirmed")
    return suspects.join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))), [suspects, confirmed]


#: Level at which texts are packed that are shuffled.
LEVEL = 3


def _packed(at: int):
    """Texts (column ``at``) packed, each by itself."""

    def run(batches):
        packer = zstandard.ZstdCompressor(LEVEL)
        for batch in sliced(batches, 256):
            columns = [large_or_small(c) for c in batch.columns]
            columns[at] = pa.array([None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _without(at: int, names: list[str]):
    """Packed texts (column ``at``), unpacked and without the lines whose hashes
    the last column holds."""

    def run(batches):
        for batch in sliced(batches, 256):
            texts, counts, dropped = [], [], []
            for packed, lost in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                text = None if packed is None else zstandard.decompress(packed).decode("utf-8", "surrogatepass")
                lines, own = (text or "").split("\n"), set(lost or ())
                kept = [x for x in lines if not own or line_hash(key_of(x)) not in own]
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [large_or_small(c) for c in batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=names)

    return run


def drop_repeated_lines(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """All columns of ``docs``, the text without lines that its document loses,
    and ``lines_col`` (before) and ``dropped_col``, which replace columns so named."""
    lost, read = repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, id_col=id_col, text_col=text_col)
    drops = written(lost.groupBy(F.col("doc_id").isNull().alias("__none"), F.col("ref").alias("__ref")).agg(F.collect_set("line").alias("__lost")), "drops")
    discard(*read)
    own = docs.drop(lines_col, dropped_col)
    names = [*own.columns, lines_col, dropped_col]
    seen = screened(own.withColumns({"__none": F.col(id_col).isNull(), "__ref": _ref(id_col, text_col)}), drops.select("__ref"), "__ref")
    n_lines = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long")
    whole = seen.filter("NOT __maybe").select(*own.columns, n_lines.alias(lines_col), F.lit(0).cast("long").alias(dropped_col))
    shape = StructType([*own.schema.fields, StructField(lines_col, LongType()), StructField(dropped_col, LongType())])
    at = own.columns.index(text_col)
    met = seen.filter("__maybe").drop("__maybe")
    # texts are most of what is shuffled
    packed = StructType([StructField(f.name, BinaryType()) if i == at else f for i, f in enumerate(met.schema.fields)])
    maybe = met.mapInArrow(_packed(at), packed).join(drops, ["__none", "__ref"], "left").select(*own.columns, "__lost")
    return whole.unionByName(maybe.mapInArrow(_without(at, names), shape))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, (p.key IS NOT NULL AND k.doc_id IS DISTINCT FROM p.keeper) AS lost FROM keyed k LEFT JOIN repeated p ON k.key = p.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r
"""
