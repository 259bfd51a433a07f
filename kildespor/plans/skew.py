"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys, with their rows of the smaller table, are broadcast.
HEAVY_KEYS = 1000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", least: int = 20_000) -> DataFrame:
    """Join rows with a table that has one row per key and the key's row count, ``weight``.

    The up to HEAVY_KEYS keys with the most rows, of those with over ``least``,
    are joined where the rows are: their rows of ``table`` are broadcast and
    rows of theirs are never shuffled. Only the others are; any such key holds
    under a thousandth of the rows, or at most ``least``. Key and payload must be
    short (numbers, hashes, words). how: inner, left or left_semi. Both inputs are
    read twice where there is a heavy key, so they should be written ones.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    spark = rows.sparkSession
    hot = table.where(F.col(weight) > least).orderBy(F.col(weight).desc(), *keys).limit(HEAVY_KEYS).select(*keys).collect()
    if not hot:
        return rows.join(table, keys, how)
    heavy = F.broadcast(spark.createDataFrame(hot, table.select(*keys).schema))
    near = rows.join(F.broadcast(table.join(heavy, keys, "left_semi")), keys, "left_semi" if how == "left_semi" else "inner")
    far = rows.join(heavy, keys, "left_anti").join(table.join(heavy, keys, "left_anti"), keys, how)
    return near.unionByName(far)
