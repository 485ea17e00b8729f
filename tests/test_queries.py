"""Every query of the engine against DuckDB."""

import pytest

from sylvagraph.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck):
    found, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        QUERIES[name](spark, sf_dir).count()


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
