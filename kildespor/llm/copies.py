"""Records that are copies of one another but for layout, case, punctuation or field order.

Method: progressive partition refinement. Rows are first grouped by cheap
invariants of the stripped text (its length and counts of frequent letters),
one number; a class of one member is done. Only classes with several members are
split further, by a 64-bit hash, and what is left of those by another, 128 bits
together. The scan gives all three, so no text is ever written or shuffled.

Defined cases: null texts and texts without a letter, mark or digit take no
part; ``first_id`` is the smallest id of all copies; repeated rows with one id
count as one copy each but give one row; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kildespor.plans.shared import written
from kildespor.plans.skew import attach

_HISTOGRAM = "enrsdtag"


def stripped(text: Column) -> Column:
    """The lower-cased letters, marks and digits of a text, in their order."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "")


def _invariants(text: Column) -> Column:
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c))) for c in _HISTOGRAM]
    return F.xxhash64(F.length(text), *counts)


_KEYS = ("key_1", "key_2", "key_3")


def _rows(df: DataFrame, id_col: str, text: Column, scope: Column | None) -> DataFrame:
    """(scope, id, keys) of the rows with a text and a scope."""
    rows = df.select((F.lit("") if scope is None else scope).alias("scope"), F.col(id_col).alias("id"), F.explode(F.array(stripped(text))).alias("s"))  # a generated column is computed once
    rows = rows.where(F.col("scope").isNotNull() & (F.col("s") != ""))
    return written(rows.select("scope", "id", _invariants(F.col("s")).alias("key_1"), F.xxhash64("s").alias("key_2"), F.xxhash64(F.lit("\u0001"), "s").alias("key_3")))


def _refined(rows: DataFrame):
    """For each level (keys, rows still in a class with several members, classes (keys, copies, first_id))."""
    keys = ["scope"]
    for level in _KEYS:
        keys = [*keys, level]
        classes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")))
        yield keys, rows, classes
        if level != _KEYS[-1]:
            rows = written(attach(rows, classes.where("copies > 1"), keys, "copies", "left_semi"))


def copies_found(df: DataFrame, id_col: str, text: Column, scope: Column | None = None) -> DataFrame:
    """(scope, first_id, copy_id): one row per copy but the first. Rows are compared within a scope; a null scope takes no part."""
    keys, rows, classes = list(_refined(_rows(df, id_col, text, scope)))[-1]
    members = attach(rows, classes.where("copies > 1"), keys, "copies")
    return members.where("id <> first_id").select("scope", "first_id", F.col("id").alias("copy_id")).distinct()


def collapsed(df: DataFrame, id_col: str, text: Column, scope: Column | None = None) -> DataFrame:
    """(scope, id, copies): one record per text, with the number of its copies. A class of one member leaves at its level."""
    levels = list(_refined(_rows(df, id_col, text, scope)))
    done = [classes.where("copies = 1") for _, _, classes in levels[:-1]] + [levels[-1][2]]
    return reduce(DataFrame.unionByName, [d.select("scope", F.col("first_id").alias("id"), "copies") for d in done])


#: What a line's payload must hold to be compared.
LINE_SCHEMA = "book string, chapter string, verse string, text string"


def verse_rows(verses: DataFrame, lines: DataFrame) -> DataFrame:
    """(scope, id, text) of both tables; a line's scope holds its book, chapter and verse.

    A payload that is null, is no JSON object, or lacks one of the three or has
    what is no number there, has a null scope, so it is no one's copy.
    """
    line = F.from_json("payload", LINE_SCHEMA)
    number = lambda c: F.col(f"line.{c}").try_cast("decimal(30,6)").cast("string")
    sep = F.lit("\u0001")
    return verses.select(
        F.lit("verses").alias("scope"), F.col("verse_index").alias("id"), "text"
    ).unionByName(
        lines.select(F.col("line_id").alias("id"), line.alias("line")).select(
            F.concat(F.lit("verse_lines"), sep, F.lower("line.book"), sep, number("chapter"), sep, number("verse")).alias("scope"),
            "id",
            F.col("line.text").alias("text"),
        )
    )


def table_of(scope: str = "scope") -> Column:
    return F.substring_index(F.col(scope), "\u0001", 1)
