import random

import pytest
from pyspark.sql import functions as F

from kildespor.llm import splits

REFS = "ord bigint, id string, annotation_id string, component string, split string"
LABELS = "id string, jaccard_group string, jaccard double"


@pytest.mark.parametrize("a, b", [("bro-000189", "Bro/00189"), ("bro-189", " bro_000189"), ("sel - 0000295", "SEL.295"), ("x-0", "X 000"), ("a-7-b", "A007b")])
def test_spellings_of_one_entry(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(splits.entry_of(F.col("a")), splits.entry_of(F.col("b"))).head()
    assert r[0] == r[1]


@pytest.mark.parametrize("a, b", [("sel-000295", "sel-000295b"), ("bro-189", "bro-1890"), ("bro-10", "bro-1"), ("x1", "y1")])
def test_different_entries(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(splits.entry_of(F.col("a")), splits.entry_of(F.col("b"))).head()
    assert r[0] != r[1]


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("one", "one")] + [("p000", "p030")]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[n] for n in got if n[0] == "p"} == {"p000"} and {got[n] for n in got if n[0] == "s"} == {"hub"} and got["one"] == "one"
    assert len(got) == 61 + 51 + 1
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pairs_of_spellings(spark, rows):
    data = [(0, "r0", "bro-001"), (1, "r1", "Bro/1"), (2, "r1", "sel-2"), (3, "r3", None), (4, None, "bro 0001"), (5, None, None), (5, None, None)]
    refs = spark.createDataFrame([(*r, "", "") for r in data], REFS)
    # r1 joins two entries in one component, but their spellings are no pair
    assert rows(splits.same_entry(refs)) == [("Bro/1", "bro 0001"), ("Bro/1", "bro-001"), ("bro 0001", "bro-001")]
    assert rows(splits.same_entry(refs.where("false"))) == []


def test_splits_keep_entries_together_and_hold_shares(spark):
    rng = random.Random(9)
    data = []
    for i in range(1500):
        entry = "big" if i < 150 else f"e-{rng.randrange(700)}"
        data.append((i, f"r{i}" if i % 50 else None, entry if i % 70 else None, "", ""))
    refs = spark.createDataFrame(data, REFS)
    labels = spark.createDataFrame([(f"r{i}", rng.choice(["quote", " Quote", "allusion", None]), 0.1) for i in range(1400)], LABELS)
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.08), ("test", 0.12), (None, 0.5), ("none", 0.0)], "split_name string, share double")
    got = splits.reference_splits(refs, labels, targets).collect()
    assert len(got) == 1500
    of = {r["ref"]: r["split"] for r in got}
    by = {}
    for i, ref, entry, *_ in data:
        if entry:
            by.setdefault(entry, set()).add(of[ref or f"\x01{i}"])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(v == s for v in of.values()) / 1500 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["validation"] - 0.08) < 0.02 and abs(share["test"] - 0.12) < 0.02
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.reference_splits(refs.repartition(7), labels, targets).collect()))


def test_no_references(spark):
    none = spark.createDataFrame([], REFS)
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert splits.reference_splits(none, spark.createDataFrame([], LABELS), targets).count() == 0
    with pytest.raises(ValueError):
        splits.reference_splits(none, spark.createDataFrame([], LABELS), targets.where("false"))
