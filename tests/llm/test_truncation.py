import random

import pytest

from kildespor.llm import truncation

SCHEMA = "id bigint, source string, text string, c string, tokens string"


def corpus():
    """(texts by source, truncated ids): prose with field limits, verse without full stops, letters with signatures."""
    rng = random.Random(12)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiouy") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "ende", "lig", "hed"]) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]

    def sentence():
        w = rng.choices(words, weights, k=rng.randrange(4, 12))
        return (" ".join(w)).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    rows, cut = [], set()
    for i in range(1200):
        kind = i % 3
        if kind == 0:
            text = " ".join(sentence() for _ in range(rng.randrange(2, 9)))
            if len(text) > 300:
                text = text[:300]
                if text[-1] not in ".!? ":
                    cut.add(i)
                elif text[-1] == " ":
                    text = text[:-1]
            rows.append((i, "Avis ", text))
        elif kind == 1:
            rows.append((i, "salmer", "\n".join(" ".join(rng.choices(words, weights, k=5)).capitalize() for _ in range(4))))
        else:
            rows.append((i, "breve", sentence() + " " + sentence() + "\nHilsen fra " + rng.choice(words).capitalize()))
    return rows, cut


def test_field_limits_are_found_and_verse_and_signatures_are_whole(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    found = {r["id"] for r in truncation.truncated(df).collect()}
    assert cut and len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(rows)
    rates = {r["source"]: r for r in truncation.rates(df).collect()}
    assert rates["avis"]["texts"] == 400 and rates["avis"]["truncated"] == len([i for i in found if i % 3 == 0])


def test_a_source_broken_off_in_most_of_its_texts(spark):
    rows, _ = corpus()
    rng = random.Random(13)
    prose = [t for _, s, t in rows if s == "Avis "]
    cut, whole = set(), set()
    for i in range(600):
        text = rng.choice(prose)[:280].rsplit(".", 1)[0] + "."
        if i % 10 < 8:
            at = rng.randrange(len(text) // 3, len(text) - 1)
            after_word = text[at - 1].isalpha() and text[at] == " "
            text = text[:at].rstrip(" .!?")
            if after_word and text.rsplit(" ", 1)[-1].islower():
                cut.add(5000 + i)
        else:
            whole.add(5000 + i)
        rows.append((5000 + i, "dagbog", text))
    found = {r["id"] for r in truncation.truncated(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert len(cut) > 40 and len(found & cut) >= 0.95 * len(cut) and len(found & whole) <= 0.05 * len(whole)
    assert sum(i < 5000 and i % 3 == 1 for i in found) <= 0.02 * 400  # verse without full stops


MARKED = ["Han gik ud og så at de var kom…", "Han gik ud og så at de [...]", "Og saa stod h[…]", "Han gik til S&oslas", "Han gik til &#82", "Han gik <i", "Han gik hj�", "Han gik, (som de", "Han gik, og de,"]
WHOLE = ["Han gik ud ...", "Han gik (dog).", "Om Ask og Embla", "Han gik ud.\nSLUT", "Han gik.«", "", "  ", None]


def test_marks_in_place_of_the_rest(spark):
    rows, _ = corpus()
    more = [(9000 + i, "avis", t) for i, t in enumerate(MARKED)] + [(9500 + i, "avis", t) for i, t in enumerate(WHOLE)]
    df = spark.createDataFrame([(*r, "", "") for r in rows + more + more[:1]], SCHEMA)
    found = [r["id"] for r in truncation.truncated(df).collect() if r["id"] >= 9000]
    assert sorted(found) == [9000] + list(range(9000, 9000 + len(MARKED)))


@pytest.mark.parametrize("texts", [[], [None], [""], ["Et ord."]])
def test_few_or_no_texts(spark, texts):
    df = spark.createDataFrame([(i, None, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    assert truncation.truncated(df).count() == 0
