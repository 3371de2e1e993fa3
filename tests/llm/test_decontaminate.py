import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordinate.llm import decontaminate as m


def nearest(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (p != c)))
    return min(row), row.index(min(row))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_bit_parallel_distance(pattern, text):
    assert m.Myers(pattern).best(text) == nearest(pattern, text)


def spoiled(text, edits, rnd):
    out = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        out[at : at + 1] = rnd.choice([[], ["x"], [out[at], "y"]])
    return "".join(out)


def made():
    rnd = random.Random(11)
    sentence = lambda n: " ".join("".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(i, sentence(30)) for i in range(6)] + [(6, "too short"), (7, None), (8, None)]
    docs = []
    for i in range(90):
        item = items[i % 6][1]
        docs.append((i, f"{sentence(20)}, {spoiled(item, i // 3, rnd).upper()}. {sentence(20)}" if i % 2 else sentence(60)))
    return items, [*docs, (200, None), (201, ""), (202, items[0][1]), (202, items[0][1]), (None, items[1][1]), (203, items[2][1] + " " + items[3][1])]


def test_all_hits_of_brute_force(spark):
    items, docs = made()
    expected = set()
    for i, t in docs:
        for n, item in items:
            own = m.folded(item)
            if len(own) >= m.LEAST_CHARS and t and (best := nearest(own, m.folded(t))[0]) <= m.budget(own):
                expected.add((i, n, best))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = m.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in found} == expected and len(found) == len(expected) + 1
    assert any(r.distance > 3 for r in found)
    for r in found:
        own = dict(items)[r.item_id]
        assert nearest(m.folded(own), m.folded(dict(docs)[r.doc_id])[r.start : r.end])[0] == r.distance
    flags = m.flagged(df, bench, flag_col="held").filter("held")
    assert flags.columns == [*df.columns, "held"] and flags.count() == len({r.doc_id for r in found}) + 1


def test_blocks_of_items(spark, monkeypatch):
    items, docs = made()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, m.contaminated(df, bench).collect()), key=str)
    monkeypatch.setattr(m, "BLOCK_CHARS", 300)
    assert len(list(m.blocks(bench, "item_id", "text"))) > 2
    assert sorted(map(tuple, m.contaminated(df, bench).collect()), key=str) == whole
    held = {str(r.doc_id) for r in m.flagged(df, bench).filter("__held").collect()}
    assert held == {str(r[0]) for r in whole}


def test_long_texts_and_items():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randint(2, 8)))
    item = " ".join(word() for _ in range(700))
    text = " ".join(word() for _ in range(40_000)) + " " + spoiled(item, 60, rnd) + " " + " ".join(word() for _ in range(40_000))
    (hit,) = m.Matcher([(5, m.folded(item))]).held(text)
    assert hit[0] == 5 and hit[1] <= 120


def test_matchers_are_not_kept():
    import gc
    import weakref

    own = m.Matcher([(1, "x" * 40 + " some words here")])
    assert own.held("a " + "x" * 40 + " some words here b")
    gone = weakref.ref(own)
    del own
    gc.collect()
    assert gone() is None


def test_empty_tables(spark):
    items, docs = made()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert m.contaminated(df.limit(0), bench).collect() == m.contaminated(df, bench.limit(0)).collect() == []
    assert m.flagged(df, bench.limit(0)).filter("__held").count() == 0


def test_query(spark):
    path = "/root/testdata/sf0.01"
    bench = [(r.item_id, m.folded(r.text)) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    exact = {(r.doc_id, i) for r in spark.read.parquet(f"{path}/documents.parquet").collect() for i, t in bench if t in m.folded(r.text)}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in m.op6_decontaminate(spark, path).collect()}
