import random

from pyspark.sql import functions as F

from ordinate.llm import toxicity as m


def test_folding():
    assert m.folded("1d10t, ІDІОТ! and i.d.") == " idiot idiot and i d "
    assert m.folded("сlоwn $cum") == " clown scum "
    assert m.folded("ｔｒａｓｈ") == " trash "
    assert m.folded(None) == m.folded("") == " "
    assert m.folded("end! 42") == m.folded("end") == " end "
    assert m.folded("345 units, 100% of 4.55 or 1d10t") == " units of or idiot "
    assert m.folded("a" * 300_000 + " 1") == f" {'a' * 300_000} "


def made(n=600):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ba ke lo mi nu".split()) for _ in range(rnd.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rnd.randint(5, 80))], i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grunk", "Grunk!", "gr0sk", "blorfen", "blorfik"]))
        elif i % 31 == 0:
            words.insert(2, "brave grunk")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def model(spark, docs, labels):
    return m.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learned_lexicon(spark):
    docs, labels = made()
    own = model(spark, docs[:400], labels[:400])
    found = [(own.score(t) >= m.THRESHOLD, bool(y)) for (_, t), (_, y) in zip(docs[400:], labels[400:])]
    assert sum(p == y for p, y in found) > 0.97 * len(found)
    assert " brave grunk " in own.phrases
    assert own.score("brave grunk") < 0.5 < own.score("GRUNK")
    assert 0 <= own.score("") < 0.5 and own.score(None) == own.score("")


def test_odd_labels_and_tables(spark):
    docs, labels = made(60)
    one_kind = model(spark, docs, [(i, 0) for i, _ in docs])
    assert one_kind.score("grunk") == 0.0
    assert model(spark, docs, [(None, 1), (5, None)]).score("grunk") == 0.0
    assert model(spark, [], labels).score("grunk") == 0.0
    df = spark.createDataFrame([(1, None), (1, None), (None, "a")], "doc_id long, text string").withColumns({"score": F.lit("clash"), "label": F.lit(0)})
    found = m.scored(df, model(spark, docs, labels), score_col="score")
    assert found.columns == ["doc_id", "text", "label", "score"] and found.count() == 3


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in m.op7_toxicity(spark, path).collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    held = [(rows[r.doc_id].predicted, r.toxic) for r in labels if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held) and not sum(p for p, y in held if not y)
