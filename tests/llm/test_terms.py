import math
import random
from collections import Counter

import pytest
import regex

from kildespor.llm import distinctive, term_counts

SCHEMA = "id bigint, text string, term string, tf int, df int"
TERM = regex.compile(r"[\p{L}\p{N}_]{2,}")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0, 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"ord{i}" for i in range(200)]
    some = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(200)], k=rng.randrange(30))) for _ in range(300)]
    return [*some, None, "", "  ", "a b", "Å-ÅÅ æØ_1 İx", some[0], some[0], "lang " * 200_000]


@pytest.mark.parametrize("heavy", [0, 5, 256])
def test_counts_against_brute_force(spark, rows, texts, heavy):
    tf, df = Counter(), Counter()
    for t in texts:
        found = TERM.findall((t or "").lower())
        tf.update(found)
        df.update(set(found))
    if heavy:
        got = term_counts.term_counts(table(spark, texts), heavy=heavy)
    else:
        got = term_counts.term_counts(table(spark, texts).repartition(13), heavy=1)
    assert rows(got) == sorted(((t, tf[t], df[t]) for t in tf), key=repr)


def test_marks(spark):
    marked = {r["term"]: r["mark"] for r in term_counts.marked_terms(table(spark, ["aa bb"] * 2 + ["aa cc"] * 3 + ["dd"] * 30 + [None] * 40)).collect()}
    assert marked == {"aa": "common", "bb": "rare", "cc": "common", "dd": "common"}  # of 35 records
    few = {r["term"]: r["mark"] for r in term_counts.marked_terms(table(spark, ["aa"])).collect()}
    assert few == {"aa": "rare"}  # rare where both hold
    assert term_counts.marked_terms(table(spark, [None])).count() == 0


def test_weights_against_brute_force(spark, texts):
    records = [TERM.findall(t.lower()) for t in texts if t is not None]
    n, mean = len(records), sum(map(len, records)) / len(records)
    df, cf = Counter(t for r in records for t in set(r)), Counter(t for r in records for t in r)
    got = {(r["id"], r["term"]): r for r in distinctive.term_weights(table(spark, texts), ["id"], "text").collect()}
    count = 0
    for i, t in enumerate(texts):
        found = TERM.findall((t or "").lower())
        for w, f in Counter(found).items():
            r, count = got[i, w], count + 1
            tfn = f * math.log2(1 + mean / len(found))
            assert (r["tf"], r["df"]) == (f, df[w])
            assert r["tfidf"] == pytest.approx(f * math.log(n / df[w]))
            assert r["dfr"] == pytest.approx((math.log2(1 + cf[w] / n) + tfn * math.log2(1 + n / cf[w])) / (1 + tfn))
    assert count == len(got)


def test_ties_go_to_the_smaller_term(spark, rows):
    weights = distinctive.term_weights(table(spark, ["bb aa", "aa bb", "cc", "zz zz aa bb", None, ""]), ["id"], "text")
    assert rows(distinctive.best_terms(weights, ["id"], "tfidf")) == [(0, "aa"), (1, "aa"), (3, "aa")]
    assert distinctive.term_weights(table(spark, []), ["id"], "text").count() == 0
