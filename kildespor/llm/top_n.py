"""The N first rows of every group, however large a group is.

Method: one global sort by range on (group, score, identifier). Within each
partition a row's position in its group is a running count; only the group at
a partition's end can go on in the next one, so the counts to carry over are
one row per partition. Their prefix sums turn positions into exact ones.
A row whose position in its own partition is over N can't be among the first
N, so each partition keeps at most N rows per group.

Ties are broken by the identifier, so results are the same on every run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kildespor.plans.shared import written


#: Rows of a partition that is sorted, at most about.
SORTED = 2_000_000


def _positions(n: int):
    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = None, 0

        def out(group, ident, position, end):
            k = len(group)
            return pa.RecordBatch.from_arrays(
                [group, ident, pa.array(position, pa.int64()), pa.array(np.full(k, part), pa.int64()), pa.array(np.full(k, end), pa.bool_())],
                ["grp", "ident", "position", "part", "tail"],
            )

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, ident = batch.column(0), batch.column(1)
            kind = ident.type
            code = group.dictionary_encode().indices.to_numpy()
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            size = np.diff(np.r_[start, len(code)])
            position = np.arange(1, len(code) + 1) - np.repeat(start, size)
            if group[0].as_py() == last:
                position[: size[0]] += count
            last, count = group[-1].as_py(), int(position[-1])
            keep = position <= n
            if keep.any():
                mask = pa.array(keep)
                yield out(pc.filter(group, mask), pc.filter(ident, mask), position[keep], False)
        if count:
            yield out(pa.array([last], pa.string()), pa.nulls(1, kind), [count], True)

    return positions


def top_n(df: DataFrame, group: str, scores: list[str], ident: str, n: int) -> DataFrame:
    """(group, ident, position) of the first n rows of every group, position from 1.

    Rows come in the order of ``scores`` ascending with nulls last, then
    ``ident``; rows with a null group or without any score are left out.
    """
    some = F.coalesce(*[F.col(s) for s in scores]).isNotNull()
    rows = df.where(F.col(group).isNotNull() & some).select(
        F.col(group).cast("string").alias("grp"), F.col(ident).alias("ident"), *[F.col(s).alias(f"s{i}") for i, s in enumerate(scores)]
    )
    order = [F.col("grp").asc(), *[F.col(f"s{i}").asc_nulls_last() for i in range(len(scores))], F.col("ident").asc_nulls_last()]
    rows = written(rows)  # read twice: for the ranges, and to be sorted
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / SORTED))
    kind = rows.schema["ident"].dataType.simpleString()
    kept = written(
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("grp", "ident")
        .mapInArrow(_positions(n), f"grp string, ident {kind}, position bigint, part bigint, tail boolean")
    )
    # one row per partition
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = kept.where("tail").select("grp", "part", F.sum("position").over(before).alias("sum"))
    carried = tails.select("grp", "part", "sum", F.lead("part").over(Window.partitionBy("grp").orderBy("part")).alias("until"))
    heads = kept.where("not tail")
    joined = heads.alias("h").join(
        F.broadcast(carried).alias("c"),
        (F.col("h.grp") == F.col("c.grp")) & (F.col("c.part") < F.col("h.part")) & (F.col("h.part") <= F.coalesce("c.until", F.lit(2**62))),
        "left",
    )
    position = F.col("h.position") + F.coalesce(F.col("c.sum"), F.lit(0))
    return joined.select(F.col("h.grp").alias(group), F.col("h.ident").alias(ident), position.alias("position")).where(F.col("position") <= n)


def best_candidates(pool: DataFrame, n: int = 3) -> DataFrame:
    """(annotation_id, pair_id, position): a reference's n best candidates by either rank.

    Rows with a null annotation_id or pair_id are left out; of the others a pair_id
    counts once, with its latest ``loaded_at`` (null is the earliest; of rows of
    one time the one with the greatest annotation_id and ranks, so the choice is
    always the same). A rank that is null or 0 is none; a pair without any is left out. First come the smaller of the two ranks, then the
    larger (none last), then pair_id.
    """
    latest = (
        pool.where(F.col("annotation_id").isNotNull() & F.col("pair_id").isNotNull())
        .groupBy("pair_id")
        .agg(F.max(F.struct("loaded_at", "annotation_id", "bm25_lemstem_rank", "dfm_ft_rank")).alias("l"))
        .select("pair_id", "l.annotation_id", *[F.nullif(F.col(f"l.{c}"), F.lit(0)).alias(c) for c in ("bm25_lemstem_rank", "dfm_ft_rank")])
    )
    both = F.col("bm25_lemstem_rank").isNotNull() & F.col("dfm_ft_rank").isNotNull()
    ranked = latest.select(
        "pair_id",
        "annotation_id",
        F.least("bm25_lemstem_rank", "dfm_ft_rank").alias("best"),
        F.when(both, F.greatest("bm25_lemstem_rank", "dfm_ft_rank")).alias("other"),
    ).where("best is not null")
    return top_n(ranked, "annotation_id", ["best", "other"], "pair_id", n)
