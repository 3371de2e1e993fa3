"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap; every chunk is pre-tokenised by itself,
in parallel, and neighbours are stitched at the first boundary on which both
agree. The pattern never looks back, so from one common boundary on, the two
chunks make the same pre-tokens. The pieces are then encoded one by one and the
ids joined. Decoding joins the bytes of the ids.

Null text is encoded as the empty text: no ids, no bytes. Repeated rows give
repeated results; an empty table gives an empty result; other columns of the
input are left out, so their names can't clash.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, large_or_small, sliced

#: Characters of a chunk, and how many of them the next chunk has too.
CHUNK, OVERLAP = 65_536, 2_048
#: Distinct units whose ids a worker keeps.
CACHE = 60_000


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file at ``path``, as an encoding without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """Each id's bytes, at the id's place."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return pa.array([ranks.get(i) for i in range(max(ranks) + 1)], pa.binary())


class Encoder:
    """Ids of pieces, looked up by the unit of text they come from.

    A unit runs from one lone space to the next: the pattern always starts a
    pre-token at a space that has non-spaces on both sides, so that units are
    independent and a table of units already met saves matching them again.
    """

    def __init__(self, path: str, pattern: str):
        self.encoding, self.pattern = vocabulary(path, pattern), regex.compile(pattern)
        self.ragged = regex.compile(r"\s \S|  | \s|^ | $")
        self.forget()

    def forget(self) -> None:
        owner = self

        class Table(dict):
            def __missing__(self, unit):
                self[unit] = number = len(self)
                owner.fresh.append(owner.encode_pieces(owner.pattern.findall(unit)))
                return number

        self.table, self.fresh = Table(), []
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_pieces(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            out += self.encoding._encode_single_piece(piece)
        return out

    def units(self, text: str) -> list[str]:
        """Independent units that joined give the text."""
        if self.ragged.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else self.pattern.findall(text)

    def encode(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of texts that are given as units."""
        if len(self.table) > CACHE:
            self.forget()
        get, counts = self.table.__getitem__, [len(p) for p in parts]
        numbers = np.fromiter((get(u) for p in parts for u in p), np.int64, sum(counts))
        if self.fresh:
            lengths = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in self.fresh for i in ids), np.int32, int(lengths.sum()))])
            self.fresh = []
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return bounds, self.flat[where]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def chunk_starts(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the chunks of a text begin; the last one reaches the end."""
    step = chunk - overlap
    return [0, *range(step, length - overlap, step)]


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Where the pre-tokens of ``text`` begin, and its end."""
    return np.array([*(m.start() for m in regex.finditer(pattern, text)), len(text)], np.int64)


def stitch(chunks: list[tuple[int, str]], cuts: list[np.ndarray], pattern: str) -> list[str]:
    """Pre-tokens of the text of which ``chunks`` (start, text) are the parts.

    ``cuts`` are the boundaries in each chunk. A boundary at a chunk's end, and
    the pre-token before it, depend on what follows, so only boundaries that a
    later boundary of the same chunk follows are trusted. Where two chunks agree
    nowhere in the overlap (one endless word), the left one is carried on.
    """
    pieces: list[str] = []
    start, text = chunks[0]
    at = cuts[0]
    for (next_start, next_text), next_at in zip(chunks[1:], cuts[1:]):
        both = np.intersect1d(at[:-2] + start, next_at[:-2] + next_start)
        if len(both):
            meet = int(both[0])
            own = at[at + start <= meet]
            pieces += [text[a:b] for a, b in zip(own[:-1], own[1:])]
            start, text = next_start, next_text
            at = next_at[next_at + next_start >= meet]
        else:
            trusted = at[:-2]
            pieces += [text[a:b] for a, b in zip(trusted[:-1], trusted[1:])]
            cut = int(trusted[-1]) if len(trusted) else int(at[0])
            text = text[cut:] + next_text[start + len(text) - next_start :]
            start += cut
            at = boundaries(text, pattern)
    return pieces + [text[a:b] for a, b in zip(at[:-1], at[1:])]


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


_BOTH = _IDS.append(pa.field("decoded", pa.binary()))


def decoded_bytes(lists: pa.ListArray, path: str) -> pa.Array:
    """The joined bytes of each list of ids."""
    offsets = lists.offsets.to_numpy()
    joined = pc.take(token_bytes(path), lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    at = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[offsets - offsets[0]] if len(joined) else np.zeros(len(offsets), np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(at)), joined.buffers()[2] if len(joined) else pa.py_buffer(b"")])


def _coded(path: str, decode: bool, doc_ids, counts, lists: pa.ListArray) -> pa.RecordBatch:
    """Encoded texts, with the bytes of their ids if ``decode``."""
    if decode:
        return as_batch(_BOTH, doc_ids, counts, lists, decoded_bytes(lists, path))
    return as_batch(_IDS, doc_ids, counts, lists)


def _encode_short(path: str, pattern: str, decode: bool):
    def run(batches):
        own = encoder(path, pattern)
        for batch in sliced(batches, 128):
            bounds, ids = own.encode([own.units(t) if t else [] for t in batch.column(1).to_pylist()])
            yield _coded(path, decode, batch.column(0).cast(pa.int64()), np.diff(bounds), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))

    return run


_CUTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("part", pa.string()), ("cuts", pa.list_(pa.int32()))])


def _pretokenise(pattern: str):
    def run(batches):
        for batch in sliced(batches, 16):
            cuts = [boundaries(t, pattern).astype(np.int32) for t in batch.column(3).to_pylist()]
            yield as_batch(_CUTS, batch.column(0), batch.column(1), batch.column(2), large_or_small(batch.column(3)), cuts)

    return run


def _stitch_group(path: str, pattern: str, decode: bool):
    def run(table: pa.Table) -> pa.Table:
        own, rows, seen = encoder(path, pattern), sorted(table.to_pylist(), key=lambda r: r["start"]), {}
        for r in rows:
            seen.setdefault(r["start"], r)
        copies = sum(r["start"] == 0 for r in rows)
        parts = list(seen.values())
        pieces = stitch([(r["start"], r["part"]) for r in parts], [np.array(r["cuts"], np.int64) for r in parts], pattern)
        bounds, ids = own.encode([pieces])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
        one = _coded(path, decode, [rows[0]["doc_id"]], [len(ids)], lists)
        return pa.Table.from_batches([one] * copies, one.schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """Ids of every text: doc_id long, n_tokens long, ids array<int>; with
    ``decoded`` also the bytes that the ids decode to, in the same pass.

    Texts of up to ``chunk`` characters are one chunk each and need no shuffle.
    Longer ones go out as one row for each chunk, so that one very long text is
    pre-tokenised by many tasks; only its chunks meet again to be stitched.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = "doc_id long, n_tokens long, ids array<int>" + ", decoded binary" * decoded
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.filter(size <= chunk).mapInArrow(_encode_short(path, pattern, decoded), out)
    step = chunk - overlap
    parts = (
        rows.filter(size > chunk)
        .withColumn("text_hash", F.xxhash64("text"))
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.length("text") - 1 - overlap, F.lit(step))))
        .select("doc_id", "text_hash", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {chunk})").alias("part"))
    )
    cut = parts.repartition("doc_id", "text_hash", "start").mapInArrow(_pretokenise(pattern), "doc_id long, text_hash long, start long, part string, cuts array<int>")
    return short.unionByName(cut.groupBy("doc_id", "text_hash").applyInArrow(_stitch_group(path, pattern, decoded), out))


def decode(ids: DataFrame, path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``decoded`` (binary): the bytes of the ids, joined.
    Null ids decode to no bytes. The bytes need not be UTF-8 if ids were cut."""
    kept = ids.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], decoded_bytes(batch.column(batch.num_columns - 1), path)], names=[*keep, "decoded"])

    schema = kept.select(*keep).schema.add("decoded", "binary")
    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(docs, path, pattern, decoded=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary")
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
