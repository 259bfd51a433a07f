"""Cutting lineage with tables written to the folder that all executors share.

A table written here survives the loss of any executor, unlike a cached or
locally checkpointed one, and is columnar, so later steps read only the
columns they use.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_used: dict[str, tuple[SparkSession, str]] = {}
_tables: set[str] = set()
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is missing and the session runs in a single process
    (``local[n]``), a temporary folder is set for it. On a cluster a missing
    setting is an error: a folder of one machine would be lost with it.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kildespor-")
        spark.conf.set(_SETTING, root)
    return root.rstrip("/")


def fresh(spark: SparkSession, outer: int = 0) -> str:
    """A new path in the shared folder, deleted at the end of the ``outer``-next scope it is made in, or of the process."""
    base = f"{shared_dir(spark)}/kildespor-{spark.sparkContext.applicationId}"
    if not _used:
        atexit.register(_clean)
    _used[base] = (spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    if len(_scopes) > outer:
        _scopes[-1 - outer].append(path)
    return path


def written(df: DataFrame, outer: int = 0) -> DataFrame:
    """df, computed once and stored as Parquet in the shared folder."""
    spark = df.sparkSession
    path = fresh(spark, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, buckets: int, outer: int = 0) -> DataFrame:
    """As ``written``, in buckets by ``key``, so that grouping by it, also beside rows of another table, shuffles none of its rows again.

    Spark takes buckets only from tables of its catalog, where it has the name of its folder until that is deleted.
    """
    spark = df.sparkSession
    path = fresh(spark, outer)
    name = _name(path)
    _tables.add(path)
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _name(path: str) -> str:
    return "kildespor_" + path.rpartition("/")[2]


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a local relation, for which no Python worker is started."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [[] for _ in kinds]
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kinds)], schema=kinds))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables written within are deleted at its end, so a long session keeps only what is still used.

    What it gives writes a table that outlives it, in buckets where a key and their number are given.
    """
    _scopes.append([])
    try:
        yield lambda df, *by: written_by(df, *by, outer=1) if by else written(df, outer=1)
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run within are deleted at its end, not when the driver happens to collect its garbage. Not for calls that run at the same time."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def together(*makes: Callable[[], object]) -> list:
    """What each of the calls gives; they run at the same time, so their Spark jobs share the executors instead of waiting for one another."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(makes)) as pool:
        return [f.result() for f in [pool.submit(inherit(make)) for make in makes]]


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        _tables.remove(path)
        spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, base in _used.values():
        try:
            for path in [p for p in _tables if p.startswith(base + "/")]:
                _delete(spark, path)
            _delete(spark, base)
        except Exception:  # the session may have ended before
            pass
