import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ordinate.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
ALPHABET = "ab c  d\n\t'sé9²_ .!ß \x1c\x00ЖA漢"


def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 300))) for _ in range(120)]
    return [*made, "a" * 900, "", "   ", " a", "a ", "x" * 100 + " " + "y" * 300, "it's we'll 's", None, None]


@pytest.mark.parametrize("chunk, overlap", [(65_536, 2_048), (64, 16), (40, 8)])
def test_ids_are_the_librarys(spark, chunk, overlap):
    given = list(enumerate(texts()))
    df = spark.createDataFrame(given, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(0)})
    coded = bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    found = {r.doc_id: list(r.ids) for r in coded.collect()}
    encoding = bpe.vocabulary(RANKS, P.PATTERN)
    assert found == {i: encoding.encode_ordinary(t or "") for i, t in given}
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode(coded, RANKS).collect()}
    assert decoded == {i: (t or "").encode() for i, t in given}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "b " * 60), (1, "b " * 60), (None, "b " * 60), (1, "c " * 60)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encode(df, RANKS, P.PATTERN, chunk=32, overlap=8).collect()) == [61] * 4
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).collect() == []


def test_decoding_null_and_cut_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, bpe.vocabulary(RANKS, P.PATTERN).encode_ordinary("漢字")[:1])], "doc_id long, ids array<int>")
    found = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, RANKS).collect()}
    assert found[1] == found[2] == b"" and "漢字".encode().startswith(found[3])


def test_stitching_an_endless_word():
    text = "a" * 200 + " b c"
    starts = bpe.chunk_starts(len(text), 50, 10)
    chunks = [(s, text[s : s + 50]) for s in starts]
    cuts = [bpe.boundaries(t, P.PATTERN) for _, t in chunks]
    assert bpe.stitch(chunks, cuts, P.PATTERN) == bpe.regex.findall(P.PATTERN, text)
    assert isinstance(cuts[0], np.ndarray)


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in bpe.op1_bpe(spark, sf_dir).collect()}
    encoding = bpe.vocabulary(RANKS, P.PATTERN)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert rows[r.doc_id][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
