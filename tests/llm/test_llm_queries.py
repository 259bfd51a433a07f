import pytest

from conftest import DATA
from kildespor.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(name, spark):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert len({repr(r) for r in rows}) == len(rows)
