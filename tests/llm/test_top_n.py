import random

import pytest

from kildespor.llm import top_n

SCHEMA = "pair_id string, annotation_id string, bm25_lemstem_rank int, dfm_ft_rank int, loaded_at int, position int, grp string"


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_sorting(spark, rows, n):
    rng = random.Random(n)
    data = [(f"p{i}", "hot" if i % 3 else rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), 0, 0, "") for i in range(2000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    got = rows(top_n.top_n(df, "annotation_id", ["bm25_lemstem_rank", "dfm_ft_rank"], "pair_id", n))
    wanted, last = [], lambda x: (x is None, x or 0)
    for g in {r[1] for r in data if r[1]}:
        mine = sorted((r for r in data if r[1] == g and (r[2] or r[3])), key=lambda r: (last(r[2]), last(r[3]), r[0]))
        wanted += [(g, r[0], i) for i, r in enumerate(mine[:n], 1)]
    assert got == sorted(wanted, key=repr)


def test_candidates(spark, rows):
    data = [
        ("p1", "a", 5, None, 1), ("p1", "a", 1, None, 0), ("p2", "a", 5, 9, 1), ("p3", "a", 0, 5, 1), ("p4", "a", None, 0, 1), ("p5", "a", 9, 5, 1), ("p5", "a", 9, 5, 1),
        ("p6", None, 1, 1, 1), (None, "a", 1, 1, 1), ("p7", "b", 3, 3, None), ("p7", "b", 8, 8, 2),
    ]
    df = spark.createDataFrame([(*r, 0, "") for r in data], SCHEMA)
    assert rows(top_n.best_candidates(df)) == [("a", "p1", 3), ("a", "p2", 1), ("a", "p5", 2), ("b", "p7", 1)]
    assert rows(top_n.best_candidates(df.where("false"))) == []
