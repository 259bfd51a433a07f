import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kildespor.functions import text as T


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).head()[0]


@pytest.mark.parametrize(
    "make, given_, wanted",
    [
        (T.ortho, "Han raabte paa Gud.", "Han råbte på Gud."),
        (T.ortho, "AA Aa aA Aaa aaa aaaa", "AA Å aA Aå åa åå"),
        (T.ortho, "Et vers.\nStatus for dette kapitel: x\ny", "Et vers."),
        (T.ortho, None, ""),
        (T.ortho, "　å \x1c", "å"),
        (T.clean_query, "»Mange Vande«, sagde han til dem, kan ikke slukke", "Mange Vande, kan ikke slukke"),
        (T.clean_query, "Hun besvarede hun ham. Ja", "Hun be. Ja"),
        (T.clean_query, "Nej TÆNKTE HUN længe; ja", "Nej; ja"),
        (T.clean_query, "sagde henne", "sagde henne"),
        (T.clean_query, None, ""),
        (T.normalized, " a \n b ", "a b"),
        (T.normalized, None, None),
        (T.stem, "Himmelen", "Himmel"),
        (T.stem, "hus", "hus"),
        (T.raw_tokens, "Å ja, ΛΟΓΟΣ x_1!", ["ja", "λογος", "x_1"]),
        (T.stemmed_tokens, "Og Himmelen er stor og store", ["himmel", "stor", "stor"]),
        (T.split_tokens, " a  b\tc ", ["a", "b", "c"]),
    ],
)
def test_literal_cases(spark, make, given_, wanted):
    assert one(spark, make, given_) == wanted


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 0.0]


def test_three_digits_round_as_python(spark):
    df = spark.createDataFrame([(x,) for x in (1 / 16, 1 / 80, 3 / 80)], "x double")
    assert [r[0] for r in df.select(T.three_digits("x")).collect()] == ["0.062", "0.013", "0.037"]


def test_prefixes():
    assert T.prefixes_for("some/E5-large") == ("query: ", "passage: ")
    assert T.prefixes_for("other") == ("", "")
    assert T.run_label("a/b", False) == "b__noortho"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_composing_equals_unicodedata(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.nfc(F.col("t")))
    assert [r[0] for r in df.collect()] == [unicodedata.normalize("NFC", t) for t in texts]
