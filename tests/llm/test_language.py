import random

from pyspark.sql import functions as F

from ordinate.llm import language as m
from ordinate.llm.common import crc_bucket

SYLLABLES = {"xx": "ka lo mi tu re sa".split(), "yy": "bron drif stel gurk vamp".split(), "zz": "ñu éa öl ış çe".split()}


def made(n=240):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append((i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(20, 60))), lang))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    remainder = crc_bucket(F.col("doc_id"), 5)
    return m.predict(df.select("doc_id", "text"), m.fit(df, remainder != 0), remainder == 0).collect()


def test_held_out_texts(spark):
    rows = made()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in run(spark, rows) if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_no_letters_null_long_and_repeated(spark):
    extra = [(1000, None, "xx"), (1001, "", None), (1002, "12 !? ²", "yy"), (1003, "bron drif " * 60_000, None), (1003, "bron drif " * 60_000, None), (None, "ka lo mi tu", "xx")]
    found = {}
    for r in run(spark, made() + extra):
        found.setdefault(r.doc_id, []).append(r)
    for i in (1000, 1001, 1002):
        assert [(r.lang_pred, r.score, r.rejected) for r in found[i]] == [("und", 0.0, True)]
    assert [r.lang_pred for r in found[1003]] == ["yy", "yy"]
    assert found[None][0].held_out is False


def test_nothing_to_learn_from(spark):
    assert [r.lang_pred for r in run(spark, [(1, "words", None)])] == ["und"]
    assert run(spark, []) == []


def test_query(spark):
    rows = m.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_samples_come_from_whole_texts(spark):
    banner = "every page of this source begins with the same foreign words " * 40
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        own = "own" + "".join(rnd.choice("abcdefghij") for _ in range(9))
        rows.append((i, banner + " ".join([own, *(rnd.choice(SYLLABLES["yy"]) for _ in range(4))] * 300), "yy"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    [(lang, data)] = m.fit(df, F.lit(True))
    assert lang == "yy" and len(data) <= m.DICT_BYTES
    assert sum(text.split()[440].encode() in data for _, text, _ in rows) == len(rows)
    assert data.count(b"foreign") * 61 < 0.3 * len(data)


def test_shares_fit():
    assert m._share([5, 100, 100], 105) == 50 and m._share([5, 6], 100) == 6
    assert all(len(m._pieces(b"x" * n, share, 3)) <= share for n in (10, 1000, 5000) for share in (10, 163, 999))
