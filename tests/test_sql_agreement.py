"""Every registered query with SQL agrees with it, on names, types, rows and values."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    # Text operators without SQL are tested beside their code.
    assert all(name == "pipeline" or name.startswith("op") for name in set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, SQL[name]) == []


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["cust_id", "create_date"]
    assert result.count() == 130
