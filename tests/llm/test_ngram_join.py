import random

import pytest
from pyspark.sql import functions as F

from ordinate.llm import ngram_join as m


def brute(texts, width, num, den):
    """Component number of each text, by comparing all pairs."""
    def grams(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def families(seed):
    """Copies, near copies at all distances, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: f"w{min(rnd.randint(0, 300), rnd.randint(0, 300))}"
    out = [None, "", " \n", "a", "A", "a b", "b a", "a b c"]
    for _ in range(8):
        base = [word() for _ in range(rnd.choice([4, 9, 12, 40, 150, 400]))]
        for _ in range(10):
            other = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                other[rnd.randrange(len(other))] = word()
            out.append(" ".join(other + [word()] * rnd.randint(0, 1)))
        out.append(" ".join(base))
        out.append("  ".join(base).upper())
    return out


@pytest.mark.parametrize("seed, width, num", [(1, 3, 90), (2, 5, 80), (3, 3, 50)])
def test_components_are_brute_forces(spark, seed, width, num):
    texts = families(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit(1), "n": F.lit(2), "mark": F.lit(3)})
    found = sorted(m.similar(df, width=width, num=num, den=100).collect(), key=lambda r: r.doc_id)
    roots, sizes = brute(texts, width, num, 100)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert [r.n_shingles for r in found] == sizes
    assert [r.component_id for r in found] == [least[r] for r in roots]


def test_nulls_repeats_and_empty_tables(spark):
    base = " ".join(f"w{i}" for i in range(42))
    rows = [(1, base), (2, base + " zz"), (3, None), (4, ""), (None, base + " qq"), (None, "x1 x2 x3"), (9, "un"), (9, base), (9, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in m.similar(df, width=3, num=90, den=100).collect())
    assert found == sorted([("1", 40, 1), ("2", 41, 1), ("3", 0, 3), ("4", 0, 4), ("None", 41, 1), ("None", 1, None), ("9", 1, 9), ("9", 40, 1), ("9", 40, 1)])
    assert m.similar(df.limit(0)).collect() == []


@pytest.mark.parametrize("num", [50, 80, 90, 99, 100])
def test_bounds(num):
    bounds = m.Bounds(num, 100)
    for n in range(1, 400, 7):
        for k in range(n, 450, 3):
            if 100 * n < num * k:
                break
            need = bounds.needed(n, k)
            assert 100 * need >= num * (n + k - need) and 100 * (need - 1) < num * (n + k - need + 1)
            # what linked classes leave out of their prefixes can't hold the whole overlap
            assert n - bounds.prefix(n) < need and k - bounds.prefix(k) < need
            # the smaller class meets the larger in the earlier half of its prefix
            assert all((num + 100) * (n - r) >= 2 * num * n for r in range(n - need + 1))


def test_bitmaps_and_blocks():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**64, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 800))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        apart = sum(int(x).bit_count() for x in (m.bitmap(a) ^ m.bitmap(b)).view(np.uint64))
        assert apart <= len(a) + len(b) - 2 * common
        for blocks in (1, 2, 8, 64):
            parts = [np.split(x, m.blocks_of(x, blocks)[:-1]) for x in (a, b)]
            assert all(len(p) == blocks for p in parts) and sum(len(np.intersect1d(x, y)) for x, y in zip(*parts)) == common


def template(rnd, n, words, kept):
    """Texts that share a template but for words of their own."""
    base = [f"t{i}" for i in range(words)]
    return [" ".join(w if rnd.random() < kept else f"x{i}.{j}" for j, w in enumerate(base)) for i in range(n)]


@pytest.mark.parametrize("kept, num", [(0.93, 90), (0.985, 90), (0.97, 80)])
def test_templates_are_brute_forces(spark, monkeypatch, kept, num):
    """Groups far above ``HOT``, some of whose pairs are linked."""
    monkeypatch.setattr(m, "HOT", 5)
    rnd = random.Random(kept)
    texts = template(rnd, 60, 150, kept) + families(5)[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in m.similar(df, width=3, num=num, den=100).collect()}
    roots, _ = brute(texts, 3, num, 100)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert found == {i: least[r] for i, r in enumerate(roots)}


def test_boilerplate_is_brute_forces(spark, monkeypatch):
    """Texts all of whose columns are shared by many."""
    monkeypatch.setattr(m, "HOT", 4)
    rnd = random.Random(8)
    lines = [" ".join(f"l{i}.{j}" for j in range(12)) for i in range(14)]
    texts = [" ".join(rnd.sample(lines, rnd.choice([3, 9, 10]))) for _ in range(60)]
    texts += [" ".join(sorted(rnd.sample(lines, rnd.choice([9, 10, 11, 12])))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in m.similar(df, width=3, num=80, den=100).collect()}
    roots, _ = brute(texts, 3, 80, 100)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert found == {i: least[r] for i, r in enumerate(roots)}


def test_pairs_of_a_template_grow_with_its_texts(spark):
    """Texts of one template that differ enough meet in no column."""
    sizes = []
    for n in (200, 600):
        df = spark.createDataFrame(list(enumerate(template(random.Random(1), n, 120, 0.9))), "doc_id long, text string")
        join = m.Join(df, width=3, num=90, den=100)
        entries = join.prefixes()
        rows = entries.join(entries.groupBy("col").agg(F.count("*").alias("size"), F.max("early").alias("some")).filter("some AND size > 1"), "col")
        sizes.append(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    assert sizes[1] <= 6 * max(sizes[0], 50)


def test_a_very_long_text_is_cut_into_blocks(spark):
    base = [f"w{i}" for i in range(9000)]
    near, far = list(base), list(base)
    near[100:200] = [f"n{i}" for i in range(100)]
    far[::12] = [f"f{i}" for i in range(len(far[::12]))]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(map(tuple, m.similar(df, width=3, num=90, den=100).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1), (3, 3)]


def test_components(spark):
    from ordinate.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}
    assert components(df.limit(0)).collect() == []


def test_sketches_tell_long_texts_apart_and_lose_no_link(spark):
    rnd, texts = random.Random(11), []
    shared = [f"s{i}" for i in range(2000)]
    for i in range(6):
        # half of the words in common: far under the bound, but beyond what 512 bits can tell
        texts.append(" ".join(shared + [f"u{i}_{j}" for j in range(2000)]))
    for size in (700, 1020, 1030, 2040, 2100, 4090, 4150):
        base = [f"v{size}_{rnd.randrange(10**9)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[: size - size // 12]), " ".join(base[size // 9 :]), " ".join(base + [f"x{j}" for j in range(size // 11)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(m.similar(df, width=3, num=90, den=100).collect(), key=lambda r: r.doc_id)
    roots, _ = brute(texts, 3, 90, 100)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert [r.component_id for r in found] == [least[r] for r in roots]
    join = m.Join(df, width=3, num=90, den=100)
    classes = join.classes.select("key", "n", "ref").collect()
    long = [c for c in classes if c.n > 3900 and c.ref < 6]
    assert len(long) == 6
    names = "root_a root_b a b na nb ra rb"
    met = spark.createDataFrame([(a.key, b.key, a.key, b.key, a.n, b.n, 0, 0) for a in long for b in long if a.key < b.key], ", ".join(f"{x} long" for x in names.split()))
    assert join.pairs(met).count() == 0
    assert join.rows.filter("n > 1000 AND 4 * size(cols) > n").isEmpty()
    join.close()


def test_a_group_of_near_copies_first_meets_the_text_they_stem_from(spark):
    rnd = random.Random(5)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(300):
        # two changed words: near the base, yet too far from each other
        other = list(base)
        for at in (rnd.randrange(2, 70), rnd.randrange(75, 148)):
            other[at] = f"c{i}_{at}"
        texts.append(" ".join(other))
    texts.append(" ".join(base))
    join = m.Join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=3, num=90, den=100)
    left = join.write(join.prefixes().withColumn("root", F.col("key")), "left")
    links = join.links(join.pairs(join.met_one(left, 0)))
    assert links.count() >= 295
    join.close()
