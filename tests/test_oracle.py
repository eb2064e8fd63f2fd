"""Every core query with SQL gives the rows that DuckDB gives; the others at least run."""

import pytest

from loomtrail.plans import catalogue

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, data_dir, con, name):
    assert compare(catalogue.QUERIES[name](spark, data_dir), con, catalogue.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, data_dir, name):
    assert catalogue.QUERIES[name](spark, data_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
