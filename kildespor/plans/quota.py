"""Taking rows in hash order up to a quota per group, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kildespor.plans.shared import small

BUCKETS = 4096
_LEVELS = 4


def place(*parts) -> Column:
    """A place in [0, 2**48) for hash order, from columns or strings."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 16)


def cuts(df: DataFrame, group: list[str], size: str, place_col: str, quota: dict[tuple, float]) -> dict[tuple, int]:
    """For each group the place before which the summed sizes stay within its quota.

    Sizes are summed per hash bucket and added up on the executors, over at most
    BUCKETS rows a group; the driver sees one row per group and level. The
    bucket that the quota falls into is split again, down to single places.
    """
    low = {g: 0 for g in quota}
    left = {g: float(v) for g, v in quota.items()}
    done: dict[tuple, int] = {}
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in group)
    upto = Window.partitionBy(*group).orderBy("_b")
    for level in range(1, _LEVELS + 1):
        width = 2 ** (48 - 12 * level)
        open_groups = [g for g in quota if g not in done]
        if not open_groups:
            break
        spans = small(
            df.sparkSession, [(*g, low[g], low[g] + width * BUCKETS, left[g]) for g in open_groups], f"{kinds}, _low bigint, _high bigint, _left double"
        )
        sums = (
            df.join(F.broadcast(spans), group)
            .where((F.col(place_col) >= F.col("_low")) & (F.col(place_col) < F.col("_high")))
            .withColumn("_b", F.floor((F.col(place_col) - F.col("_low")) / F.lit(width)))
            .groupBy(*group, "_b", "_left")
            .agg(F.sum(size).cast("double").alias("_s"))
            .withColumn("_before", F.sum("_s").over(upto) - F.col("_s"))
        )
        over = F.col("_before") + F.col("_s") > F.col("_left")
        reached = sums.where(over).groupBy(*group).agg(F.min(F.struct("_b", "_before")).alias("_at")).collect()
        at = {tuple(r[c] for c in group): r["_at"] for r in reached}
        for g in open_groups:
            if g not in at:
                done[g] = low[g] + width * BUCKETS
                continue
            low[g] += int(at[g]["_b"]) * width
            left[g] -= at[g]["_before"]
            if level == _LEVELS:
                done[g] = low[g]
    return {g: done.get(g, low[g]) for g in quota}
