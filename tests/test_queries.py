"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from oracle import SF, duck, same  # noqa: E402

from corpuslens import queries  # noqa: E402

queries.load()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    # all columns are computed, not only counted
    assert df.columns and len(df.collect()) > 0


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
