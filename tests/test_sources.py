"""Generators, run files and the command line."""

import numpy as np
import pytest

from ordinate import cli
from ordinate.sources import generate, runfile
from ordinate.sources.tables import literal, scan, write, write_csv


def test_generators_keep_their_domains(spark):
    df = generate.increasing_ranges(spark, 2000, 1)
    assert [df.select(f"c{i}").distinct().count() for i in range(8)] == [1, 2, 4, 8, 16, 32, 64, 100]
    assert df.agg({"tid": "min"}).first()[0] == 0
    assert generate.with_domains(spark, 10, [3], 1).agg({"tid": "min"}).first()[0] == 1
    assert generate.with_upper(spark, 100, 4, 3, 1, 1).select("c0").distinct().count() == 1
    assert generate.with_bits_below(spark, 1000, 8, 2, 1, 1).select("c1").distinct().count() == 8
    assert generate.with_bits(spark, 100, [40, 40, 8], 1).filter("c2 <> 0 or c1 >= 16777216 or c0 < 0").count() == 0


def test_generators_repeat(spark):
    df = generate.with_domains(spark, 500, [1000] * 3)
    assert sorted(df.collect()) == sorted(df.repartition(7).collect())


@pytest.mark.parametrize("n, domains", [(1000, [10, 100]), (1000, [100, 10, 1]), (997, [997]), (1, [1]), (0, [5])])
def test_unique_rows(spark, n, domains):
    df = generate.unique_rows(spark, n, domains, seed=3).drop("tid")
    assert df.distinct().count() == n
    assert all(0 <= v < d for r in df.collect() for v, d in zip(r, domains))


def test_unique_rows_need_room(spark):
    with pytest.raises(ValueError):
        generate.unique_rows(spark, 11, [5, 2])


def test_duplicates(spark):
    df = generate.duplicates(spark, 1000, 6, 4, 3, 1, 2).drop("tid")
    assert (df.count(), df.distinct().count()) == (1000, 250)
    with pytest.raises(ValueError):
        generate.duplicates(spark, 1000, 2, 1, 2, 1)


def test_about_distinct(spark):
    found = generate.about_distinct(spark, 5000, 1000, 2, 4).drop("tid").distinct().count()
    assert abs(found - 1000) < 30
    assert generate.domain_for(100, 100) > 100


def test_segments(spark):
    rows = generate.segments(spark, 100, (5, 3, 2), (1, 1, 1), 1).orderBy("tid").collect()
    assert [r.c0 for r in rows] == sorted(r.c0 for r in rows)
    assert {sum(r.c0 == a for r in rows) for a in range(5)} == {20}


def test_run_file_round_trip(spark, tmp_path):
    runfile.register(spark)
    df = literal(spark, [(i % 7, i) for i in range(1024)]).selectExpr("*", "c1 AS tid")
    df.repartition(3).write.format("runfile").mode("append").save(str(tmp_path / "runs"))
    again = spark.read.format("runfile").load(str(tmp_path / "runs"))
    assert sorted((r.tid, r.c0, r.c1, r.c31) for r in again.collect()) == [(i, i % 7, i, 0) for i in range(1024)]


def test_run_file_pages(spark, tmp_path):
    rows = np.zeros(1024, runfile.ROW)
    rows["tid"] = np.arange(1024)
    data = runfile.paged(rows)
    assert len(data) == -(-1024 // 15) * 4096 and runfile.ROWS == 15
    assert (runfile.pages(data) == rows).all()
    with pytest.raises(ValueError):
        runfile.pages(data[:-1])
    (tmp_path / "one").write_bytes(data)
    runfile.register(spark)
    assert spark.read.format("runfile").load(str(tmp_path / "one")).count() == 1024
    missing = spark.read.format("runfile").option("missingIsEmpty", "true").load(str(tmp_path / "none"))
    assert missing.count() == 0


def test_tables(spark, tmp_path):
    df = literal(spark, [(1, 2)], 3)
    write(df, str(tmp_path / "t"))
    write_csv(df, str(tmp_path / "c"))
    assert scan(spark, str(tmp_path / "t")).collect() == [(1, 2, 0)]
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_command_line(spark, tmp_path, capsys):
    path, bad = str(tmp_path / "g"), str(tmp_path / "bad")
    assert cli.main(["gen", path, "50"], spark) == 0
    assert cli.main(["count", path], spark) == 0
    assert cli.main(["cat", path], spark) == 0
    spark.read.parquet(path).drop("tid").orderBy("c7", ascending=False).coalesce(1).write.parquet(bad)
    assert cli.main(["check", bad], spark) == 1
    assert cli.main([], spark) == 2
    assert "50" in capsys.readouterr().out
