import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordinate.llm import suffix_tree as m
from ordinate.llm.common import crc_bucket


def base_scores(rows):
    """The base score of each (id, text) row, counted by hand."""
    counts = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def scores(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "uid": F.lit(2)})
    return m.Scorer(df, crc_bucket(F.col("doc_id"), 7) == 2).scores()


def test_base_scores(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"Wö{rnd.randint(0, 30) ** 2}" for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\x1fodd\tRARE words " * 3), (None, "some null id"), (7, rows[7][1])]
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in scores(spark, rows).collect()), key=str)
    for got, want in zip(found, sorted(base_scores(rows), key=str), strict=True):
        assert got[:4] == want[:4] and got[4] == pytest.approx(want[4], abs=1e-9)


def test_contexts_help(spark):
    rnd = random.Random(4)
    after = {w: f"w{rnd.randint(0, 60)}" for w in (f"w{i}" for i in range(61))}
    def text():
        out = ["w0"]
        for _ in range(40):
            out.append(after[out[-1]] if rnd.random() < 0.7 else f"w{rnd.randint(0, 60)}")
        return " ".join(out)
    held = [r for r in scores(spark, [(i, text()) for i in range(400)]).collect() if r.held_out]
    assert held and all(r.score > r.base_score for r in held)


def test_distributions_sum_to_one():
    grams = m.Grams(["a", "b", "c"], [("a", "b"), ("a", "c"), ("\n", "a"), ("b", "c")], [("a", "b", "c"), ("a", "b", "\n")])
    import numpy as np

    tree = m.Tree(grams, 4000, 9, [np.array([{"\n": 500, "a": 2000, "b": 1000, "c": 490}[w] for w in grams.words]), np.array([900] * len(grams.two)), np.array([700] * len(grams.three))])
    assert tree.states
    rest = (4000 + 9 + 1 - sum(10 ** tree.logs)) / (4000 + 9 + 1)  # words that aren't common
    floor = math.log10(4010)
    for context in ([], [b"a"], [b"a", b"b"], [b"b"], [b"zz"]):
        total = 0.0
        s = grams.numbered(context)[:-1]
        for w in range(grams.k):
            two, three = grams.places(np.array([*s, w]))
            i, j = int(two[-1]), int(three[-1])
            pair = int(two[-2]) if len(two) > 1 and s[-1] != 0 else -1
            left = tree.left_two[pair] if pair >= 0 else 0.0
            one = tree.two[i] if i >= 0 and not np.isnan(tree.two[i]) else (tree.left_one[s[-1]] if s[-1] >= 0 else 0.0)
            added = tree.three[j] if j >= 0 and not np.isnan(tree.three[j]) else one + left
            total += 10 ** (tree.logs[w] - floor + added)
        pair = int(grams.places(s)[0][-1]) if len(s) > 1 else -1
        total += rest * 10 ** ((tree.left_one[s[-1]] if s[-1] >= 0 else 0.0) + (tree.left_two[pair] if pair >= 0 else 0.0))
        assert total == pytest.approx(1, abs=1e-9)


def test_blocks_find_what_is_frequent(monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 3000)
    rnd = random.Random(3)
    texts = [" ".join(f"w{min(rnd.randint(0, 40), rnd.randint(0, 40))}" for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    found, tokens, exact = Counter(), 0, Counter()
    for batch in m._candidates([pa.RecordBatch.from_pydict({"text": texts})]):
        for r in batch.to_pylist():
            found[r["size"], r["gram"]] += r["count"]
            tokens += r["tokens"]
    for t in texts:
        w = [*t.split(), "\n"]
        exact.update((1, x) for x in w)
        exact.update((2, " ".join(x)) for x in zip(["\n", *w], w))
        exact.update((3, " ".join(x)) for x in zip(["\n", *w], w, w[1:]))
    assert tokens == sum(c for (n, _), c in exact.items() if n == 1)
    assert all(found[k] >= c - tokens // 1500 for k, c in exact.items() if k[0] == 1)
    assert all(c <= exact[k] for k, c in found.items())


def test_nothing_to_learn_from(spark):
    assert scores(spark, [(1, "a")]).limit(0).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = scores(spark, [(alone, "a b")]).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert scores(spark, [(1, "a")]).filter("doc_id > 5").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.Scorer(empty, F.lit(False)).scores().collect() == []


def whole_tree(rows):
    """The tree in one process, of all counts of the training texts."""
    import numpy as np

    texts = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    sums = Counter()
    for batch in m._candidates([pa.RecordBatch.from_pydict({"text": texts})]):
        for r in batch.to_pylist():
            sums[r["size"], r["gram"]] += r["count"]
    grams = m.Grams([g for s, g in sums if s == 1], [tuple(g.split(" ")) for s, g in sums if s == 2], [tuple(g.split(" ")) for s, g in sums if s == 3])
    name = lambda *ids: " ".join(grams.words[i] for i in ids)
    two = [(c // grams.k, c % grams.k) for c in grams.two.tolist()]
    counts = [[sums[1, w] for w in grams.words], [sums[2, name(*p)] for p in two], [sums[3, name(*two[c // grams.k], c % grams.k)] for c in grams.three.tolist()]]
    return m.Tree(grams, sum(counts[0]), grams.k, [np.array(c, np.int64) for c in counts])


def test_rare_ngrams_count_wherever_they_are(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(f"w{min(rnd.randint(0, 300), rnd.randint(0, 300))}" for _ in range(rnd.randint(1, 50))) for _ in range(300)]
    # each rare pair and triple once in a document, in four documents far apart
    for j in range(60):
        for i in range(j, 300, 75):
            texts[i] += f" x{j} y{j} z{j}"
    rows = list(enumerate(texts))
    tree = whole_tree(rows)
    assert tree.states > 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, block in ((1, 1_000_000), (24, 500)):
        monkeypatch.setattr(m, "BLOCK", block)
        found = {r.doc_id: r for r in m.Scorer(df.repartition(parts), crc_bucket(F.col("doc_id"), 7) == 2).scores().collect()}
        for i, text in rows:
            assert found[i].score - found[i].base_score == pytest.approx(tree.score(m.words_of(text))[2], abs=1e-8)


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, f"a{i} b{i} " + ("p q" if i % 10 == 0 else f"c{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r for r in m.Scorer(df.repartitionByRange(parts, "doc_id"), F.lit(False)).scores().collect()} for parts in (1, 40))
    assert one[0].score > one[0].base_score
    assert all(one[i].score == pytest.approx(many[i].score, abs=1e-9) for i, _ in rows)
