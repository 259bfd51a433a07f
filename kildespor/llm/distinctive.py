r"""How characteristic each term is of its record.

Method: divergence from randomness. ``dfr`` is the information content of the
term under a geometric model of the collection, times Laplace's after-effect
gain, with a length-normalised term frequency:

    tfn = tf * log2(1 + average length / length)
    dfr = (log2(1 + F/N) + tfn * log2(1 + N/F)) / (1 + tfn)

with F the term's occurrences and N the records. The same pass gives
``tfidf`` = tf * ln(N / df), which is what the data's statement of the problem
ranks by; see the README.

Terms are as in term_counts; N counts records with non-null text, average
length is over those, lengths are in terms. Ties go to the smaller term by code
points. Records without a term have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kildespor.plans.shared import written
from kildespor.plans.skew import attach

from .term_counts import terms


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (keys…, tokens) to rows (keys…, term, tf, dl)."""
    for batch in batches:
        keys, tokens = batch.columns[:-1], batch.columns[-1]
        row = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
        words = pc.list_flatten(tokens).dictionary_encode()
        n = len(words.dictionary)
        if not n:
            continue
        code, tf = np.unique(row * n + words.indices.to_numpy(), return_counts=True)
        at, length = code // n, np.bincount(row, minlength=batch.num_rows)
        columns = [k.take(pa.array(at)) for k in keys]
        columns += [words.dictionary.take(pa.array(code % n)), pa.array(tf, pa.int64()), pa.array(length[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "term", "tf", "dl"])


def postings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf, dl): counted within each batch of rows, so without a shuffle."""
    rows = df.where(F.col(text).isNotNull()).select(*keys, terms(F.col(text)).alias("t"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_count, f"{kinds}, term string, tf bigint, dl bigint")


def term_weights(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf, df, dfr, tfidf) of every term of every record. Texts are split once; all counts come from the written postings."""
    records = df.where(F.col(text).isNotNull()).count()
    found = written(postings(df, keys, text))
    counts = written(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    average = (counts.agg(F.sum("cf")).head()[0] or 0) / max(1, records)
    rows = attach(found, counts.hint("shuffle_hash"), ["term"], "df")  # a partition of the vocabulary fits in memory, and postings needn't be sorted
    double: dict[str, Column] = {c: F.col(c).cast("double") for c in ("tf", "df", "cf", "dl")}
    n = F.lit(float(records))
    tfn = double["tf"] * F.log2(F.lit(1.0) + F.lit(float(average)) / double["dl"])
    dfr = (F.log2(F.lit(1.0) + double["cf"] / n) + tfn * F.log2(F.lit(1.0) + n / double["cf"])) / (F.lit(1.0) + tfn)
    return rows.select(*keys, "term", "tf", "df", dfr.alias("dfr"), (double["tf"] * F.log(n / double["df"])).alias("tfidf"))


def best_terms(weights: DataFrame, keys: list[str], by: str, least_records: int = 2) -> DataFrame:
    """(keys, term): each record's one term with the highest weight, to 6 digits."""
    return (
        weights.where(F.col("df") >= least_records)
        .groupBy(*keys)
        .agg(F.min(F.struct((-F.round(by, 6)).alias("w"), "term")).alias("best"))
        .select(*keys, "best.term")
    )


def record_key(tbl: Column, row_id: Column) -> Column:
    """One number for a record of either table: shorter to shuffle and faster to sort than both columns."""
    return F.shiftleft(row_id, 1) + F.when(tbl == "verses", 0).otherwise(1)


def of_record(key: Column) -> list[Column]:
    """(tbl, row_id) of a record_key."""
    return [F.when(key.bitwiseAND(F.lit(1)) == 0, "verses").otherwise("split_annotations").alias("tbl"), F.shiftright(key, 1).alias("row_id")]


def verse_and_reference_texts(verses: DataFrame, references: DataFrame) -> DataFrame:
    """(tbl, row_id, text) of both tables."""
    return verses.select(F.lit("verses").alias("tbl"), F.col("verse_index").alias("row_id"), "text").unionByName(
        references.select(F.lit("split_annotations").alias("tbl"), F.col("ord").alias("row_id"), F.col("quote_from_work").alias("text"))
    )
