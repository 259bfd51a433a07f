r"""How often every term of a collection occurs, and in how many records.

Method: heavy-light aggregation. A frequent-items sketch over the whole
collection names up to HEAVY terms; their list, of that fixed bound, is
broadcast, and each task counts them exactly in two counter arrays. The other
terms are counted per batch and shuffled. Both tables are then one: a term is
in exactly one of them, as every task uses the same list. The sketch decides
only which way a term takes, never its count.

Terms are runs of two or more of [\p{L}\p{N}_] in the lower-cased text. A
record is a row with non-null text, also an empty one. Repeated rows count
each. An empty table gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Bound of the broadcast list of heavy terms.
HEAVY = 256
_TRACKED = 20_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def heavy_terms(tokens: DataFrame, heavy: int = HEAVY) -> list[str]:
    """Up to ``heavy`` frequent terms of the array column t, by a sketch over all rows."""
    top = tokens.select(F.explode("t").alias("term")).agg(
        F.expr(f"approx_top_k(term, {heavy}, {max(_TRACKED, heavy)})").alias("top")
    ).head()
    return [x["item"] for x in (top["top"] or [])] if top else []


def _counter(heavy: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(heavy, pa.string())
        h = max(1, len(heavy))
        times, records = np.zeros(h, np.int64), np.zeros(h, np.int64)

        def made(term, tf, df):
            return pa.RecordBatch.from_arrays([term, pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"])

        def in_records(row, code, n):
            return np.bincount(np.unique(row * np.int64(n) + code) % n, minlength=n)

        for batch in batches:
            column = batch.column(0)
            flat, row = pc.list_flatten(column), pc.list_parent_indices(column).to_numpy()
            slot = pc.index_in(flat, names)
            is_heavy = slot.is_valid().to_numpy(zero_copy_only=False)
            at = slot.drop_null().to_numpy().astype(np.int64)
            if len(at):
                times += np.bincount(at, minlength=h)
                records += in_records(row[is_heavy], at, h)
            light = flat.filter(pa.array(~is_heavy)).dictionary_encode()
            if n := len(light.dictionary):
                code = light.indices.to_numpy().astype(np.int64)
                yield made(light.dictionary, np.bincount(code, minlength=n), in_records(row[~is_heavy], code, n))
        seen = times > 0
        if len(heavy) and seen.any():
            yield made(names.filter(pa.array(seen)), times[seen], records[seen])

    return count


def term_counts(texts: DataFrame, text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(term, tf, df): occurrences of every term and the records it is in."""
    tokens = texts.where(F.col(text).isNotNull()).select(terms(F.col(text)).alias("t"))
    counted = tokens.mapInArrow(_counter(heavy_terms(tokens, heavy)), "term string, tf bigint, df bigint")
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def marked_terms(texts: DataFrame, text: str = "text", rare: int = 2, common_share: float = 0.05) -> DataFrame:
    """(term, tf, df, mark): mark is 'rare' up to ``rare`` records, else 'common' above the share of records, else null."""
    records = texts.where(F.col(text).isNotNull()).count()
    return term_counts(texts, text).withColumn(
        "mark",
        F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.lit(records * common_share), "common"),
    )
