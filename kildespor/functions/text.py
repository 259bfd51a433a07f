r"""Normalising, tokenising and stemming texts, as Column expressions.

A word is a run of [\p{L}\p{N}_]; white space is Unicode's together with
U+001C to U+001F. Everything runs in the JVM but for composing accents (NFC),
for which only the texts that may need it are sent to Python.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_SPACE = r"[\s\x1c-\x1f]"
#: Characters that NFC never changes and that never change another.
_STABLE = r"^[\x{0}-\x{2FF}\x{2010}-\x{2027}\x{2030}-\x{205E}]*\z"

# Quotation marks, speech verbs and pronouns that query cleaning removes,
# the text that a scraper left after a chapter, stop words, and suffixes in the order they are tried.
QUOTES = "«»“”‘’„‟\"'`"
SPEECH_VERBS = "sagde tænkte spurgte svarede raabte hviskede udbrød mente smilede".split()
PRONOUNS = "han hun de jeg du I".split()
LEFTOVER = "Status for dette kapitel"
STOPWORDS = (
    "og i at det en den til er som på de med han af for ikke der var et har om vi "
    "min så jeg du men kan vil sig nu hans hun være have over efter ved mod eller "
    "fra op ud da kun man mig dig os jer dem sin sit deres vor vore denne dette "
    "disse hvor hvad hvem hvilken alle alt ingen nogen noget meget mere mest jo nej "
    "ja her hen ham hende the saa skal vilde skulde havde blev ere vare thi dog"
).split()
SUFFIXES = "ernes erne ende enes ene ens ets en et er es e s t".split()


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    return F.coalesce(_nfc(F.when(~text.rlike(_STABLE), text)), text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def even_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def normalized(text: Column) -> Column:
    """White space made even, accents composed; null stays null."""
    return nfc(even_spaces(text))


def ortho(text: Column) -> Column:
    """Old spelling to new: aa becomes å, Aa becomes Å; what a scraper left is cut. Null becomes ''."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s){LEFTOVER}.*", "")
    return F.replace(F.replace(strip(nfc(text)), F.lit("aa"), F.lit("å")), F.lit("Aa"), F.lit("Å"))


def clean_query(text: Column) -> Column:
    """Without quotation marks and 'said he' clauses, white space made even. Null becomes ''."""
    bare = F.translate(F.coalesce(text, F.lit("")), QUOTES, "")
    said = rf"(?iU),?{_SPACE}*(?:{'|'.join(SPEECH_VERBS)}){_SPACE}+(?:{'|'.join(PRONOUNS)})(?![\p{{L}}\p{{N}}_])[^,.;]*"
    return even_spaces(nfc(F.regexp_replace(bare, said, "")))


def prepare_document(text: Column, use_ortho: bool = True) -> Column:
    return ortho(text) if use_ortho else text


def prepare_query(text: Column, use_ortho: bool = True, clean: bool = True) -> Column:
    """Cleaning comes first: its verbs are in old spelling."""
    text = clean_query(text) if clean else text
    return ortho(text) if use_ortho else text


def stem(word: Column) -> Column:
    """Without the first suffix that leaves three characters, only one."""
    return F.regexp_replace(word, rf"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")


def raw_tokens(text: Column) -> Column:
    """Words of two characters or more in lower case, in order. Null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def stemmed_tokens(text: Column) -> Column:
    """Stems of the words that aren't stop words. Null gives null."""
    return F.transform(F.filter(raw_tokens(text), lambda w: ~w.isin(*STOPWORDS)), stem)


def split_tokens(text: Column) -> Column:
    """Tokens of a blank-separated string."""
    return F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared of all distinct elements; 0 of two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union.cast("double"))


def verse_label(name: Column, book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(F.coalesce(name, book), F.lit(" "), chapter.cast("string"), F.lit(":"), verse.cast("string"))


def pair_id(ref: Column, book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat(ref, F.lit("__"), book, chapter.cast("string"), F.lit("."), verse.cast("string"))


@F.pandas_udf(StringType())
def three_digits(x: pd.Series) -> pd.Series:
    """'%.3f' as Python rounds, which the JVM's formatting differs from."""
    return x.map(lambda v: None if pd.isna(v) else "%.3f" % v)


def tuple_id(number: Column) -> Column:
    return F.format_string("T%04d", number)


def prefixes_for(model: str) -> tuple[str, str]:
    """What an encoder of this name wants before (queries, passages)."""
    return ("query: ", "passage: ") if "e5" in model.lower() else ("", "")


def run_label(model: str, use_ortho: bool) -> str:
    return model.rstrip("/").split("/")[-1] + ("__ortho" if use_ortho else "__noortho")


def query_prefix(model: Column) -> Column:
    """As prefixes_for, of a column of names."""
    return F.when(F.lower(model).contains("e5"), "query: ").otherwise("")


def passage_prefix(model: Column) -> Column:
    return F.when(F.lower(model).contains("e5"), "passage: ").otherwise("")


def run_labels(model: Column, use_ortho: bool) -> Column:
    """As run_label, of a column of names."""
    return F.concat(F.substring_index(F.rtrim(model, F.lit("/")), "/", -1), F.lit("__ortho" if use_ortho else "__noortho"))
