import pytest

from kildespor.llm import lookalike

SCHEMA = "tbl string, id bigint, text string, form string"


def forms(spark, texts):
    df = spark.createDataFrame([("t", i, x, "clash") for i, x in enumerate(texts)], SCHEMA)
    out = lookalike.consistent(df)
    return {r["id"]: r["form"] for r in out.collect()}, out


SAME = [
    ("Han sang og gik", "Hаn ѕаng оg gіk"),  # Cyrillic
    ("Han så dem", "Ｈａｎ　så dem "),
    ("på fjeldet", "på ﬁeldet".replace("ﬁe", "fje")),
    ("fisk", "ﬁsk"),
    ("bølge", "bo̸lge"),
    ("en to", "en​ \n\t to﻿"),
    ("og dig", "οɡ ԁіɡ"),
    ("viv liv", "ⅴiv ⅼiv"),
    ("kat", "Kat".lower()),
    ("lam", "\U0001d425\U0001d41a\U0001d426"),
    ("Kat", "Kat"),
    ("påen", "pа̊en"),
]


@pytest.mark.parametrize("plain, odd", SAME)
def test_same_to_the_reader(spark, rows, plain, odd):
    got, out = forms(spark, [plain, odd])
    assert got[0] == got[1] == plain
    expected = [("t", 0, 1)] if plain != odd else []
    assert rows(lookalike.same_to_the_reader(out)) == expected


@pytest.mark.parametrize("a, b", [("for", "fór"), ("bøn", "bön"), ("Han", "han"), ("m2", "m²"), ("a.", "a,"), ("»a«", '"a"'), ("a - b", "a – b"), ("ab", "a b"), ("il", "Il"), ("l1", "ll")])
def test_different_to_the_reader(spark, rows, a, b):
    got, out = forms(spark, [a, b])
    assert got[0] != got[1] and rows(lookalike.same_to_the_reader(out)) == []


@pytest.mark.parametrize("plain, odd", [("en\u2010to", "en\u2011to"), ("5 \u03bcm", "5 \u00b5m")])
def test_a_character_has_one_form_in_plain_texts_and_others(spark, rows, plain, odd):
    got, out = forms(spark, [plain, odd, odd + "\u200b"])
    assert got == {0: plain, 1: plain, 2: plain}
    assert rows(lookalike.same_to_the_reader(out)) == [("t", 0, 1), ("t", 0, 2), ("t", 1, 2)]


def test_foreign_words_stay_and_unknown_results_too(spark):
    got, _ = forms(spark, ["λόγος", "αβρον", "ѕvamр", "ordet", None, "", " ​\n", "ordet ordet"])
    assert got == {0: "λόγος", 1: "αβρον", 2: "ѕvamр", 3: "ordet", 4: None, 5: "", 6: "", 7: "ordet ordet"}


@pytest.mark.parametrize("plain, odd", [
    ("мое слово тут", "мое слoво тут"),  # one Latin o in a Cyrillic word
    ("и слово", "и cлoвo"),
    ("это сор и спор", "это cop и спор"),  # a word of Latin letters alone
    ("λόγος και ρυθμος", "λόγoς και pυθμος"),  # Latin in Greek
    ("Abe og kat", "ꓮbe og kat"),  # Lisu
    ("Abe og kat", "Аbе og kat"),
    ("ՈՒՐ լույս", "ՈՒՐ լոuյս".replace("ոu", "ու")),
])
def test_scripts_other_than_latin_and_look_alikes_of_any_script(spark, plain, odd):
    got, _ = forms(spark, [plain, odd])
    assert got == {0: plain, 1: plain}


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([("t", 1, "slot", ""), ("t", 2, "ѕlot og ѕlot", ""), ("t", 2, "ѕlot og ѕlot", ""), ("t", 2, "ѕlot", "")], SCHEMA)
    assert sorted((r["id"], r["form"]) for r in lookalike.consistent(df).collect()) == [(1, "slot"), (2, "slot"), (2, "slot og slot"), (2, "slot og slot")]


def test_two_disguises_support_one_another(spark):
    got, _ = forms(spark, ["ѕvamp", "svаmp", "svamр og"])
    assert got == {0: "svamp", 1: "svamp", 2: "svamp og"}


def test_all_pairs_but_none_of_equal_texts(spark, rows):
    texts = ["en mand"] * 3 + ["en  mand"] * 2 + ["en mand", None, "", ""]
    _, out = forms(spark, texts)
    found = rows(lookalike.same_to_the_reader(out))
    wanted = [("t", i, j) for i in range(6) for j in range(i + 1, 6) if texts[i] != texts[j]]
    assert found == wanted
    assert rows(lookalike.same_to_the_reader(out.where("false"))) == []


def test_long_texts_and_nothing(spark):
    long = "et ord " * 60_000
    got, _ = forms(spark, [long, long.replace("o", "о")])
    assert got[0] == got[1] == long.strip()
    assert lookalike.consistent(spark.createDataFrame([], SCHEMA)).count() == 0
