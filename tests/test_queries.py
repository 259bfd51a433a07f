import subprocess
import sys

import pytest

from conftest import DATA
from kildespor import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(name, spark):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_the_rest_needs_no_llm_package():
    code = "import sys; sys.modules['kildespor.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('p1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
