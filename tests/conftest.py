import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Whether a query's rows and columns are those of its SQL."""

    def check(query, sql):
        df = query(spark, DATA)
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(names)
        assert _rows(df.columns, df.collect()) == _rows(names, result.fetchall())

    return check


@pytest.fixture
def rows():
    """The rows of a DataFrame as sorted tuples, or of the named columns."""

    def collect(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)

    return collect
