import pytest
from oracle import same

from dossier.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLE_SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
