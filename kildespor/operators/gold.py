"""The gold set: references with the documents they cite, their band and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kildespor.functions.books import BANDS
from kildespor.operators.corpus import spans
from kildespor.plans.rendezvous import deal
from kildespor.plans.shared import written
from kildespor.plans.skew import attach


def bands_of(labels: DataFrame) -> DataFrame:
    """(id, band, jaccard, citation): one row per id.

    Where labels have their place in the file, ``ord``, the last one of an id
    holds. A table without an order gives the first by (band, jaccard,
    reference), nulls last.
    """
    if "ord" in labels.columns:
        order = [F.col("ord").desc()]
    else:
        order = [F.col(c).asc_nulls_last() for c in ("jaccard_group", "jaccard", "reference")]
    first = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return (
        labels.where(F.col("id").isNotNull())
        .withColumn("_r", first)
        .where("_r = 1")
        .select("id", F.col("jaccard_group").alias("band"), "jaccard", F.col("reference").alias("citation"))
    )


def assemble(refs: DataFrame, corpus: DataFrame, labels: DataFrame, strict: bool = False, gold: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, gold): references that cite a document in the corpus, and (ord, doc_id).

    References without such a document are left out. One without a label has
    a null band; with ``strict`` that is an error when the result is computed.
    ``gold``: of ``spans``, if there.
    """
    gold = spans(refs, corpus) if gold is None else gold
    kept = refs.join(gold.select("ord").distinct(), "ord", "left_semi").join(bands_of(labels), "id", "left")
    if strict:
        kept = kept.withColumn("band", F.when(F.col("band").isNull(), F.raise_error(F.concat(F.lit("no band for "), F.col("id")))).otherwise(F.col("band")))
    return kept, gold


def sibling_gold(references: DataFrame, gold: DataFrame) -> DataFrame:
    """(ord, doc_id): the gold documents of all references of the same commentary entry.

    References with a null annotation_id have only their own.
    """
    entry = references.select("ord", F.coalesce("annotation_id", F.concat(F.lit("\u0001"), F.col("ord").cast("string"))).alias("entry"))
    of_entry = gold.join(entry, "ord").select("entry", "doc_id").distinct()
    return entry.join(of_entry, "entry").select("ord", "doc_id")


def by_id(references: DataFrame, *ids: str) -> DataFrame:
    """The references with one of these ids."""
    return references.where(F.col("id").isin(*ids))


def part(references: DataFrame, start: int, stop: int) -> DataFrame:
    """References start to stop - 1 in the order of ord, counted from 0."""
    first = references.select("ord").orderBy("ord").limit(stop).select("ord", F.row_number().over(Window.orderBy("ord")).alias("_n"))
    return references.join(first.where(F.col("_n") > start).select("ord"), "ord", "left_semi")


def queries_of(references: DataFrame) -> DataFrame:
    """(ord, text)."""
    return references.select("ord", "text")


def band_counts(references: DataFrame) -> DataFrame:
    """(band, n) of the known bands, also those without references."""
    known = references.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    counts = references.where(F.col("band").isin(*BANDS)).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def band_indices(references: DataFrame) -> DataFrame:
    """(band, ord, position): place of each reference within its band, by ord."""
    at = F.row_number().over(Window.partitionBy("band").orderBy("ord")) - 1
    return references.where(F.col("band").isin(*BANDS)).select("band", "ord", at.cast("bigint").alias("position"))


def hash_group_folds(references: DataFrame, n_splits: int = 5) -> DataFrame:
    """(ord, fold) by a hash of the commentary entry alone; null entries are in fold 0."""
    digits = F.conv(F.substring(F.md5(F.col("annotation_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return references.select("ord", F.coalesce(F.pmod(digits, F.lit(n_splits)), F.lit(0)).cast("int").alias("fold"))


def stratified_group_folds(references: DataFrame, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """(ord, fold): each reference in one test fold, a commentary entry never in two, bands spread evenly.

    An entry's stratum is the band with most of its references (of equal ones
    the last by name); entries are dealt to folds of equal shares within their
    stratum, see ``plans.rendezvous``. Another seed gives other folds.
    References without an annotation_id are each a group of their own.
    """
    entry = F.coalesce("annotation_id", F.concat(F.lit("\u0001"), F.col("ord").cast("string")))
    rows = written(references.select("ord", entry.alias("entry"), F.coalesce("band", F.lit("")).alias("band")))
    per = rows.groupBy("entry", "band").agg(F.count(F.lit(1)).alias("n"))
    entries = per.groupBy("entry").agg(F.sum("n").alias("size"), F.max(F.struct("n", "band")).alias("m"))
    entries = written(entries.select(F.col("entry").alias("unit"), F.col("m.band").alias("stratum"), "size"))
    width = len(str(n_splits - 1))
    dealt = deal(entries, {f"{f:0{width}d}": 1 / n_splits for f in range(n_splits)}, seed)
    folds = entries.select(F.col("unit").alias("entry"), "size").join(dealt.withColumnRenamed("unit", "entry"), "entry")
    folds = written(folds.select("entry", "size", F.col("name").cast("int").alias("fold")))
    return attach(rows.select("ord", "entry"), folds, ["entry"], "size").select("ord", "fold")
