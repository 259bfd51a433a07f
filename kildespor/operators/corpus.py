"""Lookups in a corpus of keyed verses: (doc_id, book, chapter, verse, text).

Of several documents under one key the last, with the greatest doc_id, is the
one that a lookup finds. Null keys match nothing. Empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kildespor.functions.text import normalized, verse_label
from kildespor.plans.shared import written

KEY = ["book", "chapter", "verse"]


def corpus_of(verses: DataFrame) -> DataFrame:
    return verses.select(F.col("verse_index").alias("doc_id"), *KEY, "text")


def keyed(corpus: DataFrame) -> DataFrame:
    """(book, chapter, verse, doc_id), one row per key."""
    return corpus.groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"))


def lookup(keys: DataFrame, corpus: DataFrame) -> DataFrame:
    """keys with the doc_id of their verse, null if there is none."""
    return keys.join(keyed(corpus), KEY, "left")


def spans(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(ord, doc_id): the documents from ``verse`` to ``verse_end`` of a reference's chapter.

    A verse_end that is null or 0 is the verse itself; one before it gives nothing;
    holes in the numbering are passed over.
    """
    asked = refs.select("ord", "book", "chapter", F.col("verse").alias("first"), F.coalesce(F.nullif("verse_end", F.lit(0)), "verse").alias("last"))
    return (
        asked.join(keyed(corpus), ["book", "chapter"])
        .where((F.col("verse") >= F.col("first")) & (F.col("verse") <= F.col("last")))
        .select("ord", "doc_id")
    )


def same_text(corpus: DataFrame) -> DataFrame:
    """(doc_id, h): documents with one normalised text have one hash, of 256 bits.

    Null texts have none, empty ones one of their own. It is written once, as
    composing accents is the costly part, and only hashes are shuffled.
    """
    return written(corpus.where(F.col("text").isNotNull()).select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("h")))


def duplicates_of(gold: DataFrame, corpus: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(ord, doc_id): for (ord, doc_id), all documents of the same text, itself included. ``classes``: of ``same_text``, if there."""
    classes = same_text(corpus) if classes is None else classes
    gold = gold.select("ord", "doc_id")
    wanted = gold.join(classes, "doc_id").select("ord", "h").distinct()
    return wanted.join(classes, "h").select("ord", "doc_id").unionByName(gold).distinct()


def adjacent(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(ord, doc_id): the verse before the first gold document and the one after the last, of the same chapter.

    First and last are by doc_id; where the numbering has a hole there is none.
    """
    docs = gold.join(corpus.select("doc_id", *KEY), "doc_id")
    place = F.struct("doc_id", *KEY)
    ends = docs.groupBy("ord").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    before = ends.select("ord", "a.book", "a.chapter", (F.col("a.verse") - 1).alias("verse"))
    after = ends.select("ord", "b.book", "b.chapter", (F.col("b.verse") + 1).alias("verse"))
    return before.unionByName(after).join(keyed(corpus), KEY).select("ord", "doc_id").distinct()


def labels(corpus: DataFrame, books: DataFrame) -> DataFrame:
    """(doc_id, label): 'Book name chapter:verse'; a code without a name stands for itself."""
    names = books.groupBy("book").agg(F.min("book_name").alias("book_name"))
    return corpus.join(names, "book", "left").select(
        "doc_id", verse_label(F.col("book_name"), F.col("book"), F.col("chapter"), F.col("verse")).alias("label")
    )
