"""Every query with SQL gives DuckDB's rows."""

import pytest
from conftest import same_rows

import loomstat.plans.production  # noqa: F401 (adds its queries)
from loomstat.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
