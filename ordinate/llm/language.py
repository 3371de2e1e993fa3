"""Language identification by compression.

Every language has a raw-content zstandard dictionary made of sample texts; a
text is compressed with each, and the language whose dictionary makes it
smallest is chosen. Texts are folded to lower-case letters and single spaces
first. Where the two best languages are within ``NARROW`` of each other the text
is encoded again with a deeper match search; where that leaves them within
``MARGIN`` the choice is marked ``rejected``, but still named.

The dictionaries are fitted on at most ``SAMPLE_DOCS`` training documents of
each language (those with the smallest hash of id), ``DICT_BYTES`` in all. Every
sampled document has the same share of these bytes (what short ones leave goes to
the others), in pieces of about ``PIECE`` bytes from places spread over its whole
text, one in each of as many equal stretches, chosen there by hash.
Null texts and texts without any letter are ``und`` with score 0 and rejected.
Without any training row every text is ``und``. Equal sizes go to the language
with more training documents, then to the smaller name. Repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, crc_bucket, sliced, written

#: Bounds of the fitted sample.
SAMPLE_DOCS, DICT_BYTES, PIECE = 400, 65_536, 64
#: Parts in which the sample of a language is chosen before it is chosen of all.
PARTS = 32
NARROW, MARGIN, TEMPERATURE = 0.06, 0.005, 24.0
#: Both searches keep matches of four bytes, about a syllable.
_COMMON = {"window_log": 19, "hash_log": 16, "min_match": 4, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
QUICK = _COMMON | {"strategy": zstandard.STRATEGY_GREEDY, "chain_log": 16, "search_log": 2}
DEEP = _COMMON | {"strategy": zstandard.STRATEGY_BTLAZY2, "chain_log": 17, "search_log": 3}

_OTHER = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


_SAMPLE = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("data", pa.binary()), ("size", pa.int64())])


def _folded_rows(batches):
    for batch in sliced(batches, 64):
        data = [f"{folded(t)} ".encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
        yield as_batch(_SAMPLE, batch.column(0), batch.column(1), data, [len(d) for d in data])


def _share(sizes: list[int], total: int) -> int:
    """The most bytes of a document so that all together have ``total``."""
    left = total
    for i, size in enumerate(sorted(sizes)):
        if size > (share := left // (len(sizes) - i)):
            return share
        left -= size
    return max(sizes)


def _pieces(data: bytes, share: int, seed: int) -> bytes:
    """At most ``share`` bytes from places over all of ``data``."""
    if len(data) <= share:
        return data
    k = max(1, share // PIECE)
    size, out = share // k - 1, []
    for i in range(k):
        start, end = len(data) * i // k, len(data) * (i + 1) // k
        at = start + xxhash.xxh3_64_intdigest(b"%d %d" % (seed, i)) % (max(end - start - size, 0) + 1)
        out.append(data[at : at + max(size, 0)])
    return b" ".join([*out, b""])


def fit(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, the commonest language first. ``train`` is
    a condition on the rows to learn from."""
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # first within parts of each language, so that none meets whole in one task
    chosen = known.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS)
    chosen = chosen.select("id").distinct()
    texts = rows.join(F.broadcast(chosen), rows[id_col] == chosen["id"], "left_semi").select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
    sampled = written(texts.mapInArrow(_folded_rows, "lang string, h long, data binary, size long"), "sample")
    lengths: dict[str, list] = {}
    for r in sampled.select("lang", "size").collect():
        lengths.setdefault(r.lang, []).append(r["size"])
    shares = {lang: _share(found, DICT_BYTES) for lang, found in lengths.items()}

    def cut(batches):
        for batch in batches:
            langs, seeds, data, _ = (c.to_pylist() for c in batch.columns)
            out = [_pieces(d, shares[lang], h) for lang, h, d in zip(langs, seeds, data)]
            yield as_batch(_SAMPLE, batch.column(0), batch.column(1), out, [len(d) for d in out])

    samples: dict[str, list] = {}
    for r in sampled.mapInArrow(cut, "lang string, h long, data binary, size long").collect():
        samples.setdefault(r.lang, []).append((r.h, bytes(r.data)))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    ranked = sorted(samples, key=lambda lang: (-sizes.get(lang, 0), lang))
    return [(lang, b"".join(t for _, t in sorted(samples[lang]))) for lang in ranked]


@functools.lru_cache(maxsize=2)
def _compressors(model: tuple) -> list:
    """(language, quick compressor, deep compressor), as in ``model``."""

    def made(data: bytes, settings: dict) -> zstandard.ZstdCompressor:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters(**settings)
        content.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=content)

    return [(lang, made(data, QUICK), made(data, DEEP)) for lang, data in model]


def _ranked(sizes: list[int]) -> tuple[int, float]:
    """The smallest's place and how far behind the second is, by its own size."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
    return best, (second - sizes[best]) / second


def classify(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """Language, score and whether the margin is too narrow."""
    letters = folded(text) if text else ""
    if not compressors or not any(map(str.isalpha, letters)):
        return "und", 0.0, True
    data = f"{letters} ".encode("utf-8", "replace")
    sizes = [len(quick.compress(data)) for _, quick, _ in compressors]
    best, margin = _ranked(sizes)
    if margin < NARROW:
        sizes = [len(deep.compress(data)) for _, _, deep in compressors]
        best, margin = _ranked(sizes)
    score = 1 / sum(math.exp((sizes[best] - s) * 8 / TEMPERATURE) for s in sizes)
    return compressors[best][0], score, margin < MARGIN


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, model: list[tuple[str, bytes]], held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        compressors = _compressors(shared.value)
        for batch in sliced(batches, 512):
            found = [classify(t, compressors) for t in batch.column(2).to_pylist()]
            yield as_batch(_OUT, batch.column(0), batch.column(1), *(list(x) for x in zip(*found)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    remainder = crc_bucket(F.col("doc_id"), 5)
    return predict(docs.select("doc_id", "text"), fit(docs, remainder != 0), remainder == 0)
