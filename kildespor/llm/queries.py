"""The queries of the operators in this package, and the SQL some are compared with."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kildespor.plans.shared import written

from . import copies, distinctive, encode, lookalike, mixing, neighbours, splits, term_counts, top_n, truncation

Query = Callable[[SparkSession, str], DataFrame]

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("KILDESPOR_TOKENIZERS", "/opt/tokenizers")
BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = copies.verse_rows(_table(spark, sf, "verses"), _table(spark, sf, "verse_lines"))
    return copies.copies_found(rows, "id", F.col("text"), F.col("scope")).select(copies.table_of().alias("tbl"), "first_id", "copy_id")


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = copies.verse_rows(_table(spark, sf, "verses"), _table(spark, sf, "verse_lines"))
    return copies.collapsed(rows, "id", F.col("text"), F.col("scope")).select(copies.table_of().alias("tbl"), F.col("id").alias("first_id"), "copies")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.same_entry(_table(spark, sf, "split_annotations"))


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.reference_splits(*[_table(spark, sf, t) for t in ("split_annotations", "relation_labeling", "split_targets")])


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of p2_splits: references, entries in more than one split, and splits that have none."""
    refs, targets = _table(spark, sf, "split_annotations"), _table(spark, sf, "split_targets")
    got = written(p2_splits(spark, sf))
    entry = refs.where("annotation_id is not null").select(F.coalesce("id", F.concat(F.lit("\u0001"), F.col("ord").cast("string"))).alias("ref"), splits.entry_of(F.col("annotation_id")).alias("entry"))
    parted = got.join(entry, "ref").groupBy("entry").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    missing = targets.where("share > 0").join(got.select(F.col("split").alias("split_name")), "split_name", "left_anti").count()
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("refs")).select("n", "refs", F.lit(parted).cast("bigint").alias("parted_entries"), F.lit(missing).cast("bigint").alias("empty_splits"))


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    texts = distinctive.verse_and_reference_texts(_table(spark, sf, "verses"), _table(spark, sf, "split_annotations"))
    return lookalike.consistent(texts.withColumnRenamed("row_id", "id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_to_the_reader(_forms(spark, sf))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    return _forms(spark, sf).select("tbl", "id", "form")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.marked_terms(_table(spark, sf, "verses")).where("mark is not null").select("term", "mark")


def p4_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.marked_terms(_table(spark, sf, "verses"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.best_candidates(_table(spark, sf, "build_pool")).select("annotation_id", "pair_id")


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.best_candidates(_table(spark, sf, "build_pool"))


def _nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "text_vectors"), "vec_id", "embedding")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(_nearest(spark, sf)).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), "position", "cosine")


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    texts = distinctive.verse_and_reference_texts(_table(spark, sf, "verses"), _table(spark, sf, "split_annotations"))
    texts = texts.select(distinctive.record_key(F.col("tbl"), F.col("row_id")).alias("key"), "text")
    return distinctive.term_weights(texts, ["key"], "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return distinctive.best_terms(_weights(spark, sf), ["key"], "tfidf").select(*distinctive.of_record(F.col("key")), "term")


def p7_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select(*distinctive.of_record(F.col("key")), "term", "tf", "df", F.round("dfr", 6).alias("dfr"), F.round("tfidf", 6).alias("tfidf"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = encode.encoded(_table(spark, sf, "documents"), "doc_id", "text", f"{TOKENIZERS}/{BPE}")
    return ids.withColumnRenamed("id", "doc_id")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, sources, n_tokens) of the documents, written once: counting tokens is the costly part."""
    rows = _table(spark, sf, "documents").select(F.struct("doc_id", F.array(mixing.plain(F.col("source"))).alias("sources")).alias("row"), "text")
    return written(encode.encoded(rows, "row", "text", f"{TOKENIZERS}/{BPE}", True).select("id.*", "n_tokens"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.short_sources(_sized(spark, sf), _table(spark, sf, "mix_targets"), F.col("sources"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(_sized(spark, sf), _table(spark, sf, "mix_targets"), F.col("sources"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(_sized(spark, sf), _table(spark, sf, "mix_targets"), F.col("sources"))[1]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_documents(spark, sf)).select(F.col("id").alias("doc_id"))


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(_documents(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_records, p2_found, p2_splits, p2_checks, p3_found, p3_forms, p4_found, p4_terms, p5_found, p5_ranked, p6_found, p6_neighbours, p7_found, p7_weights, p8_ids, p9_found, p9_mix, p9_shares, p10_found, p10_rates)
}

_COPIES = r"""
rows AS (
  SELECT 'verses' AS tbl, '' AS place, verse_index AS id, text FROM verses
  UNION ALL
  SELECT 'verse_lines', lower(json_extract_string(payload, '$.book')) || chr(1)
    || CAST(CAST(json_extract_string(payload, '$.chapter') AS DECIMAL(18,3)) AS VARCHAR) || chr(1)
    || CAST(CAST(json_extract_string(payload, '$.verse') AS DECIMAL(18,3)) AS VARCHAR),
    line_id, json_extract_string(payload, '$.text') FROM verse_lines
), keyed AS (
  SELECT tbl, place, id, regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS k FROM rows
  WHERE place IS NOT NULL AND text IS NOT NULL
), firsts AS (
  SELECT tbl, id, min(id) OVER (PARTITION BY tbl, place, k) AS first_id, count(*) OVER (PARTITION BY tbl, place, k) AS n FROM keyed WHERE k <> ''
)"""

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_VERSE_TERMS = f"""
tokens AS (SELECT verse_index AS id, unnest({_TERMS}) AS term FROM verses WHERE text IS NOT NULL),
counts AS (SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT id) AS BIGINT) AS df FROM tokens GROUP BY term),
marked AS (SELECT term, tf, df, CASE WHEN df <= 2 THEN 'rare' WHEN df > 0.05 * (SELECT count(*) FROM verses WHERE text IS NOT NULL) THEN 'common' END AS mark FROM counts)"""

_RANKED = """
latest AS (
  SELECT pair_id, annotation_id, nullif(bm25_lemstem_rank, 0) AS a, nullif(dfm_ft_rank, 0) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST) AS r FROM build_pool
    WHERE annotation_id IS NOT NULL AND pair_id IS NOT NULL) WHERE r = 1
), ranked AS (
  SELECT annotation_id, pair_id, CAST(row_number() OVER (PARTITION BY annotation_id
    ORDER BY least(a, b), CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END NULLS LAST, pair_id) AS BIGINT) AS position
  FROM latest WHERE a IS NOT NULL OR b IS NOT NULL
)"""

_WEIGHTS = f"""
texts AS (
  SELECT 'verses' AS tbl, verse_index AS row_id, text FROM verses WHERE text IS NOT NULL
  UNION ALL SELECT 'split_annotations', ord, quote_from_work FROM split_annotations WHERE quote_from_work IS NOT NULL
), tokens AS (SELECT tbl, row_id, unnest({_TERMS}) AS term FROM texts),
one AS (SELECT tbl, row_id, term, CAST(count(*) AS BIGINT) AS tf FROM tokens GROUP BY tbl, row_id, term),
tfs AS (SELECT *, CAST(sum(tf) OVER (PARTITION BY tbl, row_id) AS DOUBLE) AS dl FROM one),
dfs AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS DOUBLE) AS cf FROM tfs GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM texts),
av AS (SELECT (SELECT count(*) FROM tokens) / (SELECT n FROM n) AS av),
raw AS (SELECT tbl, row_id, term, tf, df, cf, n, tf * log2(1 + av / dl) AS tfn, tf * ln(n / df) AS tfidf FROM tfs JOIN dfs USING (term), n, av),
weights AS (SELECT tbl, row_id, term, tf, df, round((log2(1 + cf / n) + tfn * log2(1 + n / cf)) / (1 + tfn), 6) AS dfr, round(tfidf, 6) AS tfidf FROM raw)"""

_ENTRY = r"regexp_replace(regexp_replace(lower(annotation_id), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '^(\P{N}*)0+(\p{N})', '\1\2')"

_NEAREST = """
units AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM text_vectors WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
lengths AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM units),
ranked AS (SELECT vec_id, neighbour_id, cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour_id) AS position FROM (
  SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) AS cosine FROM lengths a JOIN lengths b ON a.vec_id <> b.vec_id))"""

ORACLES: dict[str, str] = {
    "p2_checks": "SELECT count(DISTINCT coalesce(id, chr(1) || ord)) AS n, count(DISTINCT coalesce(id, chr(1) || ord)) AS refs, CAST(0 AS BIGINT) AS parted_entries, CAST(0 AS BIGINT) AS empty_splits FROM split_annotations",
    "p6_found": f"WITH {_NEAREST} SELECT DISTINCT least(vec_id, neighbour_id) AS vec_a, greatest(vec_id, neighbour_id) AS vec_b FROM ranked WHERE position <= 5",
    "p6_neighbours": f"WITH {_NEAREST} SELECT vec_id, neighbour_id, CAST(position AS INTEGER) AS position, cosine FROM ranked WHERE position <= 5",
    "p1_found": f"WITH {_COPIES} SELECT DISTINCT tbl, first_id, id AS copy_id FROM firsts WHERE id <> first_id",
    "p1_records": f"WITH {_COPIES} SELECT DISTINCT tbl, first_id, n AS copies FROM firsts WHERE id = first_id",
    "p2_found": f"WITH names AS (SELECT DISTINCT annotation_id, {_ENTRY} AS entry FROM split_annotations WHERE annotation_id IS NOT NULL) "
    "SELECT a.annotation_id AS annotation_id_a, b.annotation_id AS annotation_id_b FROM names a JOIN names b ON a.entry = b.entry AND a.annotation_id < b.annotation_id",
    "p4_found": f"WITH {_VERSE_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": f"WITH {_VERSE_TERMS} SELECT * FROM marked",
    "p5_found": f"WITH {_RANKED} SELECT annotation_id, pair_id FROM ranked WHERE position <= 3",
    "p5_ranked": f"WITH {_RANKED} SELECT * FROM ranked WHERE position <= 3",
    "p7_found": f"WITH {_WEIGHTS} SELECT tbl, row_id, term FROM (SELECT *, row_number() OVER (PARTITION BY tbl, row_id ORDER BY tfidf DESC, term) AS r FROM weights WHERE df >= 2) WHERE r = 1",
    "p7_weights": f"WITH {_WEIGHTS} SELECT * FROM weights",
}
