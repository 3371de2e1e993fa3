"""Every relational query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from ordinate import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    tidy = [df[columns].sort_values(columns).reset_index(drop=True) for df in (found, expected)]
    pd.testing.assert_frame_equal(*tidy, check_dtype=False)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, oracle, name):
    same(queries.queries()[name](spark, SF).toPandas(), oracle.sql(queries.oracle_sql()[name]).df())


def test_queries_without_sql(spark):
    for name in queries.queries().keys() - queries.oracle_sql().keys():
        assert queries.queries()[name](spark, SF).count() > 0


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert entry.entry(spark).count() > 0
