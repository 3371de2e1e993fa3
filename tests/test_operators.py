"""Literal fixtures and properties of the relational operators."""

import random

import pytest
from pyspark.sql import functions as F

from ordinate.functions import Avg, Count, Max, Min, Sum
from ordinate.operators import checks, codes, joins, metrics, reshape
from ordinate.operators.aggregate import group_by
from ordinate.operators.distinct import counted, distinct, duplicates
from ordinate.operators.keys import Split, key_list, prefix
from ordinate.operators.sort import placed, resort, segment_counts, sort, sort_distinct, sort_run
from ordinate.plans import intersect_distinct, join_then_group
from ordinate.sources import generate
from ordinate.sources.tables import literal, replayable
from ordinate.storage import written

STRATEGIES = ("hash", "stream", "sort")


def rows(df):
    return [tuple(r) for r in df.collect()]


def uniform(spark, n, columns=4, domain=6):
    return generate.with_domains(spark, n, [domain] * columns, 1337).drop("tid")


def test_filter(spark):
    assert rows(reshape.keep(literal(spark, [(0,), (1,)]), "c0 % 2 = 0")) == [(0,)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_group_one_key(spark, strategy):
    df = literal(spark, [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7)])
    found = rows(group_by(df, 1, Count(), Sum("c1"), Avg("c1"), Max("c1"), Min("c1"), strategy=strategy))
    assert sorted(found) == [(0, 2, 3, 1, 2, 1), (1, 3, 12, 4, 5, 3), (2, 2, 13, 6, 7, 6)]
    if strategy == "sort":
        assert found == sorted(found)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_group_two_keys(spark, strategy):
    df = literal(spark, [(0, 1, 5), (0, 1, 5), (1, 2, 1), (1, 3, 4), (1, 3, 7), (2, 7, 2), (2, 7, 9)])
    assert sorted(rows(group_by(df, ["c0", "c1"], Count(), strategy=strategy))) == [(0, 1, 2), (1, 2, 1), (1, 3, 2), (2, 7, 2)]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_group_conserves_rows(spark, strategy):
    df = generate.with_bits(spark, 10_000, [5] * 4, 3)
    assert group_by(df, 2, Count(), strategy=strategy).agg(F.sum("count")).first()[0] == 10_000


def test_group_empty_null_and_no_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), (1, None)], "c0 long, c1 long")
    assert sorted(rows(group_by(df, 1, Count(), Avg("c1"))), key=str) == [(1, 1, None), (None, 2, 2)]
    assert rows(group_by(df.limit(0), 1, Count())) == []
    with pytest.raises(ValueError):
        group_by(df, 0, Count())
    assert sorted(rows(group_by(df, 1)), key=str) == [(1,), (None,)]


def test_sum_overflow_raises(spark):
    df = literal(spark, [(0, 2**63 - 1), (0, 1)])
    with pytest.raises(Exception, match="OVERFLOW"):
        group_by(df, 1, Sum("c1")).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 256, 1024, 4096])
def test_sort_equals_pythons(spark, n):
    df = uniform(spark, n)
    assert rows(sort(df)) == sorted(rows(df))
    assert checks.order_violations(sort(df)).first() == (n, 0)


def test_sort_prefix_and_runs(spark):
    df = uniform(spark, 2000)
    assert [r[:2] for r in rows(sort(df, 2))] == sorted(r[:2] for r in rows(df))
    assert sorted(rows(sort_run(df))) == sorted(rows(df))


def test_sort_checks_find_faults(spark):
    assert not checks.is_sorted(literal(spark, [(1, 0), (0, 0)]).coalesce(1))
    assert not checks.is_sorted_unique(literal(spark, [(0, 0), (0, 1), (0, 1), (0, 2)]).coalesce(1))
    assert checks.is_sorted_unique(literal(spark, []).filter("c0 > 0"))
    # the fault lies between two partitions
    assert checks.order_violations(literal(spark, [(5,), (6,), (1,), (2,)]).repartition(1).coalesce(1).union(literal(spark, [(0,)]))).first().violations >= 1


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_distinct(spark, strategy):
    df = uniform(spark, 3000)
    assert sorted(rows(distinct(df, strategy=strategy))) == sorted(set(rows(df)))
    assert sorted(r[0] for r in rows(distinct(df, 1, strategy))) == list(range(6))
    assert rows(distinct(df.limit(0), strategy=strategy)) == []


def test_distinct_keeps_the_first_and_counts(spark):
    df = literal(spark, [(1, 5), (1, 3), (2, 9), (2, 9)])
    assert sorted(rows(distinct(df, 1, "stream", tiebreak=["c1"]))) == [(1, 3), (2, 9)]
    assert rows(sort_distinct(df, 1)) == [(1, 3), (2, 9)]
    assert duplicates(df).first()[0] == 1
    watched, seen = counted(df)
    watched.collect()
    assert seen.get["count"] == 4
    assert metrics.run(df) == 4


@pytest.mark.parametrize("strategy", ["merge", "hash", "broadcast", "auto"])
def test_left_semi(spark, strategy):
    left = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1), (3, 3)], "a long, b long")
    right = spark.createDataFrame([(1,), (1,), (None,), (3,)], "k long")
    assert sorted(rows(joins.left_semi(left, right, [("a", "k")], strategy))) == [(1, 1), (1, 2), (3, 3)]
    assert sorted(rows(joins.left_anti(left, right, [("a", "k")], strategy)), key=str) == [(2, 1), (None, 1)]
    assert rows(joins.left_semi(left, right.limit(0), [("a", "k")], strategy)) == []


def test_strategies_make_their_nodes(spark):
    left, right = uniform(spark, 100), uniform(spark, 100).toDF("a", "b", "c", "d")
    assert "SortMergeJoin" in metrics.plan_nodes(joins.left_semi_prefix(left, right, 2, "merge"))
    assert "ShuffledHashJoin" in metrics.plan_nodes(joins.left_semi_prefix(left, right, 2, "hash"))
    assert "BroadcastHashJoin" in metrics.plan_nodes(joins.left_semi_prefix(left, right, 2, "broadcast"))
    grouped = join_then_group(left, right, [("c0", "a")], ["c0"], Count())
    assert metrics.plan_nodes(grouped).count("Exchange") == 2  # one for each side, none for the groups


def test_intersect_distinct(spark):
    left, right = literal(spark, [(1,), (1,), (2,)]), literal(spark, [(2,), (2,), (3,)])
    assert rows(intersect_distinct(left, right)) == [(2,)]


def test_reshape(spark):
    df = literal(spark, [(1, 2, 3, 4, 5)])
    assert reshape.transpose(df, 2).columns == ["c2", "c3", "c0", "c1", "c4"]
    with pytest.raises(ValueError):
        reshape.transpose(df, 3)
    assert rows(reshape.multiply(df, 2)) == rows(df) * 2
    assert rows(reshape.multiply(df, 0)) == []
    many = uniform(spark, 500)
    assert sorted(rows(reshape.shuffle(many, 1))) == sorted(rows(many))
    assert reshape.hash_partition(many, 7, "c0").rdd.getNumPartitions() == 7
    assert prefix(df, 2) == ["c0", "c1"] and key_list(df, None) == df.columns
    with pytest.raises(ValueError):
        key_list(df, ["nothing"])


SPLITS = [Split(("c0",), ("c1",), ("c2",)), Split(("c0", "c1"), ("c2", "c3"), ("c4", "c5")), Split(("c0",), ("c1", "c2"), ("c3", "c4", "c5"))]


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("strategy", ["segmented", "unsegmented", "runs_ignored"])
def test_resort(spark, split, strategy):
    df = sort(uniform(spark, 1024, 6, 4), split.abc)
    again = resort(df, split, strategy)
    assert checks.order_violations(again, split.acb).first() == (1024, 0)
    assert checks.differences(df, again).first()[0] == 0


def test_segment_counts(spark):
    df = uniform(spark, 1000, 3, 4)
    assert segment_counts(df, SPLITS[0]).first() == (4, 16)


def coded_by_hand(ordered, n):
    out, before = [], None
    for r in ordered:
        offset = 0 if before is None else next((i for i in range(n) if r[i] != before[i]), n)
        out.append((*r, offset, r[offset] if offset < n else None))
        before = r
    return out


def of_codes(df):
    return [tuple(r) for r in df.collect()]


def test_codes_are_derived(spark):
    df = uniform(spark, 3000, 3, 5)
    keys = ["c0", "c1", "c2"]
    found = of_codes(codes.derive(df, keys, partitions=5).orderBy(*keys, F.desc("code")).select(*keys, "offset", "value"))
    by_hand = coded_by_hand(sorted(rows(df)), 3)
    assert sorted(found, key=str) == sorted(by_hand, key=str)


def test_codes_null_first_row_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), (3, None)], "a long, b long")
    found = sorted(of_codes(codes.derive(df, ["a", "b"]).select("a", "b", "offset", "value")), key=str)
    assert found == sorted([(None, 1, 0, None), (None, 1, 2, None), (None, 2, 1, 2), (3, None, 0, 3)], key=str)
    assert codes.derive(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 9])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_maximum_rule(spark, partitions, share):
    random.seed(5)
    keys = ["c0", "c1", "c2"]
    df = uniform(spark, 600, 3, 5).withColumn("id", F.monotonically_increasing_id())
    df = written(df, "ids")
    kept = F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000)
    coded = codes.derive(df, keys, tiebreak=["id"], partitions=partitions)
    repaired = of_codes(codes.repaired(coded, kept, keys, tiebreak=["id"]).select(*keys, "offset", "value"))
    derived = of_codes(codes.derive(df.filter(kept), keys, tiebreak=["id"]).select(*keys, "offset", "value"))
    assert sorted(repaired, key=str) == sorted(derived, key=str)


def test_code_laws(spark):
    keys = ["c0", "c1", "c2"]
    df = uniform(spark, 2000, 3, 6)
    coded = codes.derive(df, keys).persist()
    assert codes.distinct(coded, keys).count() == df.distinct().count()
    assert codes.boundaries(coded, 1).count() == df.select("c0").distinct().count()
    assert codes.boundaries(coded, 2).count() == df.select("c0", "c1").distinct().count()
    by_hand = coded_by_hand(sorted(rows(df)), 3)
    assert codes.truncation_cost(coded, keys).first()[0] == sum(min(r[3] + 1, 3) for r in by_hand[1:])
    assert checks.code_violations(coded, keys).first()[0] == 0
    assert checks.code_violations(coded.withColumn("offset", F.lit(0)), keys).first()[0] > 0
    packed = coded.select("offset", "value", codes.packed().alias("p")).filter("offset < 3").limit(50).collect()
    assert all(p == (32 - o) << 25 | v for o, v, p in packed)
    with pytest.raises(Exception, match="25 bits"):
        codes.derive(literal(spark, [(1 << 25,)]), 1).select(codes.packed()).collect()
    # inside a run of equal (A, B), taking B out of the key shifts the offset by its width
    a_c = {(r.c0, r.c1, r.c2): r.offset for r in codes.derive(df.filter("c1 = 2"), ["c0", "c2"]).collect()}
    a_b_c = {(r.c0, r.c1, r.c2): r.offset for r in codes.distinct(codes.derive(df.filter("c1 = 2"), keys), keys).collect()}
    assert all(a_c[k] in (o, o - 1, 2) for k, o in a_b_c.items())


def with_gaps(spark, n=400):
    """Rows with nulls, repeated rows and few values."""
    return uniform(spark, n, 3, 5).select(*(F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ("c0", "c1", "c2")))


@pytest.mark.parametrize("partitions", [1, 6])
def test_codes_of_sorted_input_need_no_shuffle(spark, partitions):
    df, keys = with_gaps(spark), ["c0", "c1", "c2"]
    ordered = written(sort(df.repartition(partitions)), "ordered")
    found = of_codes(codes.applied(sort(ordered), keys).select(*keys, "offset", "value"))
    assert sorted(found, key=str) == sorted(of_codes(codes.derive(df, keys, partitions=5).select(*keys, "offset", "value")), key=str)
    assert codes.applied(ordered.limit(0), keys).count() == 0
    with pytest.raises(ValueError):
        codes.applied(df.withColumnRenamed("c0", "offset"), 2)


def test_one_frequent_key_lies_in_several_ranges(spark):
    df = spark.range(2000).select(F.lit(7).alias("a"), F.col("id").alias("b"))
    coded = codes.derive(df, ["a"], tiebreak=["b"], partitions=4)
    assert coded.select("part").distinct().count() == 4
    assert coded.filter("offset = 0").count() == 1


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("partitions", [1, 7])
def test_groups_of_codes(spark, n, partitions):
    df, keys = with_gaps(spark), ["c0", "c1", "c2"]
    coded = codes.derive(df, keys, partitions=partitions)
    found = rows(codes.group_by(coded, keys, n, Count(), Sum("c2"), Avg("c1"), Max("c2")))
    assert sorted(found, key=str) == sorted(rows(group_by(df, n, Count(), Sum("c2"), Avg("c1"), Max("c2"))), key=str)
    assert rows(codes.group_by(coded.limit(0), keys, n, Count())) == []
    with pytest.raises(ValueError):
        codes.group_by(coded, keys, 0, Count())


@pytest.mark.parametrize("split", [Split(("c0",), ("c1",), ("c2",)), Split(("c0", "c1"), ("c2",)), Split(("c0",), (), ("c1", "c2"))])
@pytest.mark.parametrize("partitions", [1, 7])
def test_codes_of_another_order(spark, split, partitions):
    df = with_gaps(spark)
    again = codes.resort(codes.derive(df, split.abc, partitions=partitions), split)
    expected = codes.derive(df, split.acb)
    assert sorted(of_codes(again.select(*split.acb, "offset", "value", "code")), key=str) == sorted(of_codes(expected.select(*split.acb, "offset", "value", "code")), key=str)
    assert codes.resort(codes.derive(df.limit(0), split.abc), split).count() == 0


def test_semi_join_of_codes(spark):
    df, keys = with_gaps(spark), ["c0", "c1", "c2"]
    right = spark.createDataFrame([(1, 2), (1, 2), (3, 4), (None, 1), (2, None)], "a long, b long")
    on = [("c0", "a"), ("c1", "b")]
    found = codes.semi(codes.derive(df, keys, partitions=5), right, on, keys)
    expected = codes.derive(joins.left_semi(df, right, on), keys)
    assert sorted(of_codes(found.select(*keys, "offset", "value")), key=str) == sorted(of_codes(expected.select(*keys, "offset", "value")), key=str)


def test_order_of_nulls_and_nan(spark):
    df = spark.createDataFrame([(None,), (None,), (-1.0,), (0.5,), (float("nan"),), (float("nan"),)], "x double").coalesce(1)
    assert checks.order_violations(df).first() == (6, 0)
    assert checks.order_violations(df, strict=True).first() == (6, 2)
    back = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double").coalesce(1)
    assert checks.order_violations(back).first() == (3, 2)
    text = spark.createDataFrame([("b", [1]), ("b", [0]), ("a", None)], "s string, l array<int>").coalesce(1)
    assert checks.order_violations(text).first() == (3, 2)
    coded = codes.derive(df, ["x"])
    assert sorted(r.offset for r in coded.collect()) == [0, 0, 0, 0, 1, 1]


def test_streamed_groups_sort_and_partial_groups_move(spark):
    nodes = metrics.plan_nodes(group_by(uniform(spark, 100), 2, Count(), strategy="stream"))
    assert nodes.count("SortAggregate") == 2 and nodes.count("Exchange") == 1 and "HashAggregate" not in nodes


def test_places_are_of_rows_as_they_lie(spark):
    df = uniform(spark, 1000)
    assert [r[:-1] for r in sorted(rows(placed(sort(df))), key=lambda r: r[-1])] == sorted(rows(df))
    back = df.orderBy(*(F.desc(c) for c in df.columns))
    assert [r[:-1] for r in sorted(rows(placed(back)), key=lambda r: r[-1])] == sorted(rows(df), reverse=True)
    assert placed(df.limit(0)).count() == 0


def test_run_metrics(spark):
    found = metrics.run_metrics(sort(uniform(spark, 1000))).first()
    assert (found.rows, found.rows_written, found.rows_read) == (1000, 1000, 1000) and found.bytes_written > 0
    assert metrics.run_metrics(uniform(spark, 10)).first() == (10, 0, 0, 0, 0)
    assert metrics.columns_hashed(10, 3) == 30


def test_equality(spark):
    unsorted = spark.createDataFrame([(2,), (1,), (None,)], "a long").coalesce(1)
    assert checks.position_differences(unsorted, sort(unsorted)).first()[0] == 2
    assert checks.is_equal(unsorted, unsorted) and not checks.is_equal(unsorted, sort(unsorted))
    df = sort(uniform(spark, 200))
    assert checks.is_equal(df, df)
    assert not checks.is_equal(df, df.limit(199))
    assert checks.differences(df, df.limit(199)).first()[0] == 1
    assert replayable(df).count() == 200
