"""The scans that rank: against brute force, and how many rows they give."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kildespor.operators import dense as D, lexical as L


@pytest.mark.parametrize("positive", [True, False])
def test_lexical_scan_is_brute_force(monkeypatch, positive):
    monkeypatch.setattr(L, "_FIRST", 16)
    monkeypatch.setattr(L, "_STRETCH", 128)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    docs = [list(rng.choice(words, rng.integers(0, 9), p=share / share.sum())) for _ in range(500)]
    docs[40:80] = [["w7", "w8"]] * 40  # ties, more than k
    rows = [(q, w, float(rng.random() + (0.1 if positive else -0.3))) for q in range(40) for w in rng.choice(words, 6, replace=False)]
    rows += [(40, "w7", 9.0)]
    weights = {(q, w): x for q, w, x in rows}
    block = L._block(pa.table({"ord": [r[0] for r in rows], "term": [r[1] for r in rows], "weight": [r[2] for r in rows]}))
    table = pa.table({"doc_id": np.arange(500), "tokens": pa.array(docs, pa.list_(pa.string())), "side": np.ones(500)})
    out = pa.Table.from_batches(L._scorer(SimpleNamespace(value=block), 10, lambda tf, side: tf / (tf + side))(iter(table.to_batches(max_chunksize=50))))
    found = sorted(zip(out["ord"].to_pylist(), (-out["score"].to_numpy().round(9)).tolist(), out["doc_id"].to_pylist()))
    want = []
    for q in range(41):
        scores = [(d, sum(weights.get((q, w), 0.0) * (t.count(w) / (t.count(w) + 1)) for w in set(t))) for d, t in enumerate(docs) if any((q, w) in weights for w in t)]
        want += sorted((q, -round(s, 9), d) for d, s in scores)[:10]
    assert [(q, d) for q, _, d in found] == [(q, d) for q, _, d in want]
    assert np.allclose([s for _, s, _ in found], [s for _, s, _ in want])


@pytest.mark.parametrize("same", [False, True])
def test_dense_scan_is_brute_force(monkeypatch, same):
    monkeypatch.setattr(D, "_PAIRS", 256 * 64)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((500, 7))
    v[100:140] = v[100]
    if same:
        v[:] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.r_[rng.standard_normal((20, 7)), v[100:101]]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    s = np.round(q @ v.T, 9)
    to_beat = np.r_[s[:20, 123], np.inf]
    table = pa.table({"doc_id": np.arange(500), "vector": pa.array(v.tolist(), pa.list_(pa.float64()))})
    out = pa.Table.from_batches(D._scanned(SimpleNamespace(value=(np.arange(21), q, to_beat, None)), 10)(iter(table.to_batches(max_chunksize=50)))).to_pylist()
    assert sorted((r["ord"], -round(r["score"], 9), r["doc_id"]) for r in out if r["doc_id"] is not None) == sorted((i, *e) for i in range(21) for e in sorted((-x, d) for d, x in enumerate(s[i].tolist()))[:10])
    assert [r["beaten"] for r in out if r["doc_id"] is None] == (s > to_beat[:, None]).sum(axis=1).tolist()


def test_bound_is_below_the_kth_best():
    rng = np.random.default_rng(6)
    v, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.standard_normal((300, 7)), rng.standard_normal((20, 7))))
    table = pa.table({"ord": np.arange(20), "vector": pa.array(q.tolist(), pa.list_(pa.float64()))})
    out = pa.Table.from_batches(D._bounded(SimpleNamespace(value=v.astype(np.float32)), 10)(iter(table.to_batches())))
    kth = np.sort(q @ v.T, axis=1)[:, -10]
    assert (out["least"].to_numpy() <= kth).all() and (out["least"].to_numpy() > kth - 1e-4).all()


def test_rows_of_scans_dont_grow_with_the_documents_tasks(spark):
    k, most = 3, 3 * spark.sparkContext.defaultParallelism
    many = 4 * spark.sparkContext.defaultParallelism
    docs = spark.range(2000).repartition(many).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tokens"))
    asked = spark.createDataFrame([(0, ["a"])], "ord bigint, tokens array<string>")
    assert 0 < L.BM25(docs)._scored(asked, k).count() <= most
    vectors = spark.range(2000).repartition(many).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    one = spark.createDataFrame([(0, [1.0, 0.0])], "ord bigint, vector array<double>")
    assert 0 < D.Dense(vectors)._scan(one, k).count() <= most
