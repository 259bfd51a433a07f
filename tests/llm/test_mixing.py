from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kildespor.llm import mixing

DOCS = "doc_id bigint, sources array<string>, n_tokens bigint, pattern string, key string"
TARGETS = "source string, weight double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, n, "clash", "") for i, (s, n) in enumerate(rows)], DOCS)


def test_short_sources(spark, rows):
    d = docs(spark, [(["a"], 50), (["a"], 30), (["b"], 20), (["other"], 900), (None, 70), ([None], 5)])
    t = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3)], TARGETS)
    # of 100 tokens a has 80 >= 50, b 2 * 20 = 40 >= 40, c none
    assert rows(mixing.short_sources(d, t, F.col("sources"))) == [("c",)]
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.400001, 2), (None, 0.1, 1)], TARGETS)
    assert rows(mixing.short_sources(d, t, F.col("sources"))) == [("b",)]
    assert rows(mixing.short_sources(d.where("false"), t, F.col("sources"))) == []
    assert rows(mixing.short_sources(d, t.where("false"), F.col("sources"))) == []


def test_flow_shares_overlapping_documents():
    targets = {"a": (Fraction(1, 2), 1), "b": (Fraction(1, 2), 1)}
    taken, reached = mixing.solved({("a", "b"): 60, ("a",): 40}, targets)
    assert reached == {"a": (50, 50), "b": (50, 50)}
    assert taken[("a",), "a"] + taken[("a", "b"), "a"] == 50 and taken[("a", "b"), "b"] == 50


def test_repeats_are_used_last():
    taken, reached = mixing.solved({("a",): 10, ("a", "b"): 90}, {"a": (Fraction(3, 10), 3), "b": (Fraction(7, 10), 1)})
    assert taken[("a",), "a"] == 10 and taken[("a", "b"), "a"] == 20 and taken[("a", "b"), "b"] == 70
    taken, reached = mixing.solved({("a",): 10, ("b",): 90}, {"a": (Fraction(4, 10), 3), "b": (Fraction(6, 10), 1)})
    assert taken[("a",), "a"] == 30 and reached["a"] == (40, 30) and reached["b"] == (60, 60)


def test_mixture_holds_weights_and_caps(spark):
    d = docs(spark, [([["a"], ["b"], ["c"]][i % 3 if i % 10 else 0], 5 + i % 11) for i in range(3000)])
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3)], TARGETS)
    chosen, shares = mixing.mixture(d, t, F.col("sources"))
    s = {r["source"]: r for r in shares.collect()}
    for r in s.values():
        assert abs(r["share"] - r["weight"]) < 0.003 and r["tokens"] <= r["quota"] + 1e-6
    rows = chosen.collect()
    assert len({(r["doc_id"], r["source"]) for r in rows}) == len(rows) and max(r["repeats"] for r in rows) <= 3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(d.repartition(5), t, F.col("sources"))[0].collect()))


def test_a_source_that_falls_short_is_used_whole(spark):
    d = docs(spark, [(["a"], 10), (["b"], 90), (["b"], 0)])
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    chosen, shares = mixing.mixture(d, t, F.col("sources"))
    assert {(r["doc_id"], r["repeats"]) for r in chosen.where("source = 'a'").collect()} == {(0, 2)}
    assert {r["source"]: r["tokens"] for r in shares.collect()}["a"] == 20


def test_sources_are_compared_plainly(spark):
    df = spark.createDataFrame([(" Avis ",), (None,)], "s string")
    assert [r[0] for r in df.select(mixing.plain(F.col("s"))).collect()] == ["avis", None]
