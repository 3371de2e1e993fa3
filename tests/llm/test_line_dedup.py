import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import line_dedup as m


def brute(rows, min_docs, min_chars):
    """(id, n_lines, n_dropped, text) of each (id, text) row."""
    lower = str.maketrans(m.UPPER, m.LOWER)
    key = lambda line: line.strip(m.SPACE).translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return out


def made():
    rnd = random.Random(6)
    lines = ["short", "", " ", "É" * 12, "a line of words %d", "A Line Of Words %d", "\ta line of words %d \x0b", "x" * 50]
    rows = []
    for i in range(120):
        text = "\n".join((line % rnd.randint(0, 12)) if "%d" in line else line for line in (rnd.choice(lines) for _ in range(rnd.randint(0, 8))))
        rows.append((i, text))
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, "x" * 50 + "\nkeep"), (3, "x" * 50), (3, "x" * 50)]


@pytest.mark.parametrize("min_docs, min_chars", [(5, 10), (2, 16), (1000, 10)])
def test_against_brute_force(spark, min_docs, min_chars):
    df = spark.createDataFrame(made(), "doc_id long, text string").withColumns({"key": F.lit("clash"), "n_lines": F.lit(-1), "keeper": F.lit(0)})
    found = m.drop_repeated_lines(df, min_docs=min_docs, min_chars=min_chars)
    assert found.columns.count("n_lines") == 1 and {"key", "keeper"} <= set(found.columns)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == sorted(brute(made(), min_docs, min_chars), key=str)


def test_a_text_of_very_many_lost_lines(spark):
    lines = [f"line number {i} of a passage" for i in range(30_000)]
    rows = [(i, "\n".join(lines)) for i in range(2)]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in m.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, min_chars=5).collect()}
    assert found == {0: (30_000, 30_000, ""), 1: (30_000, 0, rows[1][1])}


def test_empty_table(spark):
    assert m.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filters_miss_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    own = m.Filter(1 << 14)
    own.add(h)
    assert own.has(h).all()
    assert not m.Filter(1 << 20).has(h).any()


def test_crowded_filters_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(m, "filter_bits", lambda n: 1 << 9)
    df = spark.createDataFrame(made(), "doc_id long, text string").repartition(5)
    found = m.drop_repeated_lines(df, min_docs=3, min_chars=8)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == sorted(brute(made(), 3, 8), key=str)


def test_digests_are_shuffled_and_suspects_go(spark):
    from ordinate import storage

    line = "a line that is much longer than its digest " * 50
    df = spark.createDataFrame([(i, f"{line}\n{i}") for i in range(6)], "doc_id long, text string")
    lost, read = m.repeated_lines(df, min_docs=5, min_chars=40)
    assert {(len(r.key), r.keeper) for r in lost.collect()} == {(32, 5)} and lost.count() == 5
    m.discard(*read)
    before = set(storage._GIVEN)
    found = m.drop_repeated_lines(df)
    assert len(set(storage._GIVEN) - before) == 1
    assert {(r.doc_id, r.text) for r in found.collect()} == {(i, f"{line}\n{i}" if i == 5 else str(i)) for i in range(6)}


def test_texts_that_meet_their_lost_lines_are_packed(spark):
    text = "the same words over and over " * 200
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in df.mapInArrow(m._packed(1), "doc_id long, text binary").collect()}
    assert rows[2] is None and len(rows[1]) < len(text) // 20 and m.zstandard.decompress(bytes(rows[3])) == b""


def test_query(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf_dir, 'documents.parquet')}'")
    assert sorted(map(tuple, m.op8_line_dedup(spark, sf_dir).collect())) == sorted(connection.sql(m.OP8_SQL).fetchall())


def test_release(spark):
    from ordinate.llm.common import release, written

    release(spark)
    path = written(spark.range(5), "r").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and release(spark) == 1 and not os.path.exists(path) and release(spark) == 0
