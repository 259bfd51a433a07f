import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from kildespor.operators import corpus as C, gold as G, metrics as M, study as S, tuning
from kildespor.operators.dense import Dense
from kildespor.operators.encode import EncodedRetriever, HashingEncoder
from kildespor.operators.lexical import BM25, Tfidf
from kildespor.operators.negatives import mine
from kildespor.operators.trainers import DimensionTrainer
from kildespor.plans import rendezvous, skew
from kildespor.sources import files

VERSES = "doc_id bigint, book string, chapter int, verse int, text string"
REFS = "ord bigint, id string, annotation_id string, text string, book string, chapter int, verse int, verse_end int"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [(0, "a", 1, 1, "x  y"), (1, "a", 1, 2, None), (2, "a", 1, 4, "x y"), (3, "a", 1, 2, "z"), (4, "b", 1, 1, ""), (5, None, None, None, "")], VERSES
    )


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(
        [
            (0, "r0", "e", "x", "a", 1, 1, None),
            (1, "r1", "e", None, "a", 1, 1, 4),
            (2, "r2", None, "y", "a", 1, 4, 0),
            (3, "r3", None, "y", "a", 1, 4, 2),
            (4, "r4", "f", "y", "c", 1, 1, None),
        ],
        REFS,
    )


def test_spans_and_lookups(corpus, refs, rows):
    gold = C.spans(refs, corpus)
    assert rows(gold) == [(0, 0), (1, 0), (1, 2), (1, 3), (2, 2)]  # the last of two under one key; a hole; reversed; unknown book
    assert rows(C.duplicates_of(gold, corpus)) == [(0, 0), (0, 2), (1, 0), (1, 2), (1, 3), (2, 0), (2, 2)]
    assert rows(C.adjacent(gold, corpus)) == [(0, 3)]  # by doc_id r1's last is verse 2, and verse 3 is a hole
    assert rows(C.lookup(refs.select("ord", *C.KEY), corpus), "ord", "doc_id")[4] == (4, None)


def test_gold_set(spark, corpus, refs, rows):
    labels = spark.createDataFrame([("r0", "quote", 0.5, "x"), ("r0", "allusion", 0.1, "x"), (None, "quote", 1.0, ""), ("r2", None, None, None)], "id string, jaccard_group string, jaccard double, reference string")
    kept, gold = G.assemble(refs, corpus, labels)
    assert rows(kept, "ord", "band") == [(0, "allusion"), (1, None), (2, None)]
    in_order = spark.createDataFrame([(0, "r0", "allusion", 0.5, "x"), (1, "r0", "quote", 0.1, "x")], "ord bigint, id string, jaccard_group string, jaccard double, reference string")
    assert rows(G.assemble(refs, corpus, in_order)[0], "ord", "band")[0] == (0, "quote")  # the file's last one holds
    assert rows(G.by_id(refs, "r1", "r9"), "ord") == [(1,)] and rows(G.part(refs, 1, 3), "ord") == [(1,), (2,)]
    assert rows(G.sibling_gold(kept, gold)) == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 2)]
    assert rows(G.band_counts(kept)) == [("allusion", 1), ("paraphrase", 0), ("quote", 0)]
    with pytest.raises(Exception, match="no band for r1"):
        G.assemble(refs, corpus, labels, strict=True)[0].collect()


def test_folds_keep_entries_together(spark):
    rng = random.Random(1)
    data = [(i, f"e{rng.randrange(40)}" if i % 9 else None, rng.choice(["quote", "allusion", None])) for i in range(400)]
    refs = spark.createDataFrame(data, "ord bigint, annotation_id string, band string")
    folds = {r["ord"]: r["fold"] for r in G.stratified_group_folds(refs, 5).collect()}
    assert sorted(folds) == list(range(400)) and set(folds.values()) == set(range(5))
    assert all(len({folds[i] for i, a, _ in data if a == e}) == 1 for e in {a for _, a, _ in data if a})
    sizes = Counter(folds.values())
    assert max(sizes.values()) < 1.5 * min(sizes.values())
    assert folds == {r["ord"]: r["fold"] for r in G.stratified_group_folds(refs, 5).collect()}
    other = {r["ord"]: r["fold"] for r in G.stratified_group_folds(refs, 5, seed=7).collect()}
    assert sum(other[i] != f for i, f in folds.items()) > 100
    for band in ("quote", "allusion"):
        share = Counter(folds[i] for i, _, b in data if b == band)
        assert max(share.values()) < 2 * min(share.values())


def test_dealing_follows_rendezvous_and_shares(spark):
    rng = random.Random(4)
    units = [(f"u{i}", rng.choice("ab"), rng.choice([1, 1, 1, 2, 5])) for i in range(600)] + [("big", "a", 400)]
    shares = {"train": 0.8, "test": 0.12, "validation": 0.08}
    table = spark.createDataFrame(units, "unit string, stratum string, size bigint")
    got = {r["unit"]: r["name"] for r in rendezvous.deal(table, shares).collect()}
    assert len(got) == 601 and got["big"] == "train"
    total = sum(s for _, _, s in units)
    for n, share in shares.items():
        assert abs(sum(s for u, _, s in units if got[u] == n) - share * total) <= 6
    # all but those that a full place turned away are where hashing alone puts them
    scores = F.array(*[F.struct(rendezvous.score(F.col("unit"), n, F.lit(s), 0).alias("s"), F.lit(n).alias("n")) for n, s in sorted(shares.items())])
    wanted = {r["unit"]: r["n"] for r in table.select("unit", F.array_max(scores)["n"].alias("n")).collect()}
    assert sum(got[u] == wanted[u] for u in wanted) > 0.85 * len(wanted)
    with pytest.raises(ValueError):
        rendezvous.deal(table, {"a": 0})
    assert rendezvous.deal(table.limit(0), shares).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_heavy_keys_are_joined_where_rows_are(spark, how):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = rows.where("k is not null and k <> 'k1'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.attach(rows, table, ["k"], "n", how, least=100)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    plain = rows.join(table, ["k"], how)
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    low = eps * sum(raw.values()) / len(raw)
    idf = {t: low if v < 0 else v for t, v in raw.items()}
    return [sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query if t in d) for d in docs]


def brute_tfidf(docs, query):
    n = len(docs)
    df = Counter(t for d in docs for t in set(d))

    def vector(tokens):
        v = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(tokens).items() if t in df}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / norm for t, x in v.items()}

    q = vector(query)
    return [sum(q.get(t, 0) * x for t, x in vector(d).items()) for d in docs]


@pytest.mark.parametrize("kind, brute", [(BM25, brute_bm25), (Tfidf, brute_tfidf)])
@pytest.mark.parametrize("pad", [False, True])
def test_lexical_ranking_against_brute_force(spark, kind, brute, pad):
    rng = random.Random(7)
    words = "a b c d e f g h".split()
    docs = [rng.choices(words, weights=range(1, 9), k=rng.randrange(0, 9)) for _ in range(60)]
    asked = [rng.choices([*words, "unknown"], k=rng.randrange(0, 5)) for _ in range(12)]
    retriever = kind(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<string>"))
    queries = spark.createDataFrame(list(enumerate(asked)), "ord bigint, tokens array<string>")
    got = {(r["ord"], r["rank"]): (r["doc_id"], round(r["score"], 8)) for r in retriever.search(queries, 7, pad_zeros=pad).collect()}
    wanted = {}
    for q, tokens in enumerate(asked):
        scores = brute(docs, tokens)
        ranked = sorted((d for d in range(60) if pad or set(tokens) & set(docs[d])), key=lambda d: (-round(scores[d], 9), d))
        wanted |= {(q, i): (d, round(scores[d], 8)) for i, d in enumerate(ranked[:7], 1)}
    assert got == wanted
    band = retriever.band(queries, 2, 5)
    assert {r["rank"] for r in band.collect()} <= {3, 4, 5}


def test_ranking_of_nothing(spark, rows):
    none = spark.createDataFrame([], "doc_id bigint, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a"])], "ord bigint, tokens array<string>")
    assert rows(BM25(none).search(queries)) == [] and rows(Tfidf(none).search(queries)) == []
    some = spark.createDataFrame([(1, ["a"]), (2, None)], "doc_id bigint, tokens array<string>")
    assert rows(BM25(some).search(queries.where("ord > 9"))) == []


def test_dense_ranks_and_ties(spark, rows):
    docs = spark.createDataFrame([(0, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "doc_id bigint, vector array<float>")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0, 1.0])], "ord bigint, vector array<float>")
    gold = spark.createDataFrame([(7, 1), (7, 2), (9, 2), (8, 1)], "ord bigint, doc_id bigint")
    d = Dense(docs)
    assert rows(d.search(queries, 2), "ord", "doc_id", "rank") == [(7, 0, 1), (7, 1, 2), (9, 0, 1), (9, 1, 2)]
    assert rows(d.ranks(queries, gold)) == [(7, 1), (8, None), (9, 1)]  # a tie doesn't worsen the rank; a query without a vector is a miss
    ranks, top = d.ranks_and_top(queries, gold, 2)
    assert rows(ranks) == rows(d.ranks(queries, gold)) and rows(top) == rows(d.search(queries, 2))
    with pytest.raises(RuntimeError):
        Dense().search(queries)


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((300, 8)).round(1), rng.standard_normal((20, 8)).round(1)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "ord bigint, vector array<double>")
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
    got = {(r["ord"], r["rank"]): r["doc_id"] for r in Dense(docs).search(queries, 5).collect()}
    assert got == {(i, n + 1): d for i in range(20) for n, d in enumerate(sorted(range(300), key=lambda d: (-s[i, d], d))[:5])}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 30)), min_size=1, max_size=30))
def test_metric_bounds(spark, ranks):
    m = M.metrics(spark.createDataFrame([(r,) for r in ranks], "rank bigint")).head()
    assert 0 <= m["p_at_1"] <= m["mrr_at_10"] <= m["ndcg_at_10"] + 1e-12 and m["ndcg_at_10"] <= m["r_at_10"] + 1e-12 <= 1 + 1e-9


@pytest.mark.parametrize("rank, wanted", [(None, (0, 0, 0, 0)), (0, (0, 0, 0, 0)), (1, (1, 1, 1, 1)), (10, (0, 1, 0.1, 1 / math.log2(11))), (11, (0, 0, 0, 0))])
def test_metrics_of_one_rank(spark, rank, wanted):
    assert tuple(M.metrics(spark.createDataFrame([(rank,)], "rank bigint")).select(*M.METRICS).head()) == pytest.approx(wanted)


def test_metrics_of_nothing_are_null(spark):
    ranks = spark.createDataFrame([(1, "quote", 1)], "ord bigint, band string, rank bigint")
    table = {r["label"]: r for r in M.by_band(ranks).collect()}
    assert table["allusion"]["p_at_1"] is None and table["allusion"]["n"] == 0
    assert table["macro-avg"]["p_at_1"] == 1.0 and table["overall"]["n"] == 1
    assert M.metrics(ranks.where("ord > 1")).head()["p_at_1"] is None
    assert M.with_counts(M.by_band(ranks)).head()["label"] == "quote (n=1)"


def test_ndcg_of_several_gold_documents(spark):
    ranking = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "ord bigint, doc_id bigint, rank bigint")
    gold = spark.createDataFrame([(1, 5), (1, 7), (1, 7)], "ord bigint, doc_id bigint")
    r = M.ranking_metrics(ranking, gold, spark.createDataFrame([(1,), (2,)], "ord bigint")).orderBy("ord").collect()
    assert r[0]["ndcg_at_10"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert r[1]["ndcg_at_10"] == 0.0 and r[1]["p_at_1"] == 0.0


def test_negatives_keep_order_and_leave_out_gold_texts(spark, corpus, rows):
    dense = spark.createDataFrame([(0, 2, 1), (0, 4, 2)], "ord bigint, doc_id bigint, rank bigint")
    lexical = spark.createDataFrame([(0, 4, 1), (0, 3, 2), (0, 1, 3)], "ord bigint, doc_id bigint, rank bigint")
    siblings = spark.createDataFrame([(0, 0)], "ord bigint, doc_id bigint")
    assert rows(mine(dense, lexical, siblings, corpus, 2)) == [(0, 3, 2), (0, 4, 1)]
    assert rows(mine(dense, lexical, siblings, corpus, 0)) == []


def test_tuples_keep_caps():
    rng = random.Random(5)
    pairs = [(f"p{i}", f"a{rng.randrange(25)}", rng.choice(S.BINS)) for i in range(80)]
    drawn, left = S.draw_tuples(pairs, seed=1)
    about = {p: (a, b) for p, a, b in pairs}
    assert 4 * len(drawn) + left == 4 * len(pairs)
    assert max(Counter(p for t in drawn for p in t).values()) <= S.REPS
    for t in drawn:
        assert len(t) == len(set(t)) == 4
        assert max(Counter(about[p][0] for p in t).values()) <= S.MAX_PER_ANNOTATION
        assert max(Counter(about[p][1] for p in t).values()) <= S.MAX_PER_BIN
    assert S.draw_tuples(pairs, seed=1) == (drawn, left) and S.draw_tuples([]) == ([], 0)


def test_tuples_of_a_pool_of_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(f"p{i}", "a0" if i % 10 == 0 else f"a{rng.randrange(200)}", rng.choices(S.BINS, [2, 10, 60, 28])[0], "r") for i in range(1500)]
    whole = S.draw_tuples([p[:3] for p in sorted(pairs, key=lambda p: (p[2], p[1], p[3], p[0]))])[0]
    table = spark.createDataFrame(pairs, "pair_id string, annotation_id string, bin string, reference string")

    def drawn():
        found = {}
        for r in S.tuples(table).collect():
            found.setdefault(r["tuple_id"], {})[r["position"]] = r["pair_id"]
        return {t: [x[i] for i in range(1, 5)] for t, x in found.items()}

    assert drawn() == {f"T{n:04d}": t for n, t in enumerate(whole, 1)}
    monkeypatch.setattr(S, "MAX_PAIRS", 100)
    got = drawn()
    assert sorted(got) == sorted(f"T{n:04d}" for n in range(1, len(got) + 1))
    assert len(got) >= 0.99 * len(whole)
    about = {p: (a, b) for p, a, b, _ in pairs}
    assert max(Counter(p for t in got.values() for p in t).values()) <= S.REPS
    for t in got.values():
        assert len(set(t)) == 4
        assert max(Counter(about[p][0] for p in t).values()) <= S.MAX_PER_ANNOTATION
        assert max(Counter(about[p][1] for p in t).values()) <= S.MAX_PER_BIN
    assert drawn() == got


def test_encoding_and_its_cache(spark, tmp_path, rows):
    docs = spark.createDataFrame([(1, "Paa Bjerget"), (2, None), (3, "på bjerget")], "doc_id bigint, text string")
    r = EncodedRetriever("hashing", HashingEncoder, cache_dir=str(tmp_path))
    with pytest.raises(RuntimeError):
        r.search(docs.withColumnRenamed("doc_id", "ord"))
    vectors = {x["doc_id"]: x["vector"] for x in r.encode_corpus(docs).collect()}
    assert vectors[1] == vectors[3] and not any(vectors[2])
    assert len(list(tmp_path.iterdir())) == 1
    r.encode_corpus(docs)
    assert len(list(tmp_path.iterdir())) == 1
    r.encode_corpus(docs.where("doc_id < 3"))
    assert len(list(tmp_path.iterdir())) == 2  # other texts, another cache
    assert rows(r.search(spark.createDataFrame([(9, "bjerget på")], "ord bigint, text string"), 1), "ord", "doc_id") == [(9, 1)]


def test_soup(spark, rows):
    df = spark.createDataFrame([("w", [1.0, 2.0]), ("w", [3.0, 4.0]), ("b", [5.0])], "param string, vector array<float>")
    assert rows(tuning.soup(df)) == [("b", [5.0]), ("w", [2.0, 3.0])]


def test_cross_validation(spark, tmp_path):
    words = [f"ord{i}" for i in range(60)]
    rng = random.Random(2)
    corpus = spark.createDataFrame([(i, "a", 1, i + 1, " ".join(rng.sample(words, 8))) for i in range(40)], VERSES).cache()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    refs = spark.createDataFrame([(i, f"r{i}", f"e{i // 2}", texts[i], ["quote", "allusion"][i % 2]) for i in range(12)], "ord bigint, id string, annotation_id string, text string, band string")
    gold = spark.createDataFrame([(i, i) for i in range(12)], "ord bigint, doc_id bigint")
    seen = []
    config = tuning.Tuning("hashing", mining=tuning.Mining(dense=10), fit=tuning.Fit(rate=0.01), folds=2, souped=2)
    trainer = DimensionTrainer(spark)
    fitted = trainer.fitted
    trainer.fitted = lambda state, examples, fit, seed: seen.append((examples.count(), fit.rate, seed)) or fitted(state, examples, fit, seed)
    after = []
    out = tuning.cross_validate(corpus, refs, gold, config, trainer, after_fold=lambda f, table, r: after.append((f, r.count())))
    assert [s for _, _, s in seen] == [42, 43, 42, 43] and all(n and rate == 0.01 for n, rate, _ in seen)
    assert [f for f, _ in after] == [0, 1] and sum(n for _, n in after) == 12
    ranks = {r["ord"]: r["rank"] for r in out["out_of_fold_ranks"].collect()}
    assert ranks == {i: 1 for i in range(12)}
    assert {r["metric"]: r["delta"] for r in out["summary"].collect()} == {m: 0.0 for m in M.METRICS}
    assert {r["band"]: r["p_at_1"] for r in out["band_means"].collect()} == {"quote": 1.0, "allusion": 1.0, "paraphrase": None}
    assert tuning.tuned_rankings(out["out_of_fold_top"], 3).count() == 36
    assert config.describe() == "hashing | ortho=True clean_q=True | pretrain=none | 2-fold | soup x2"
    path = files.write_document(spark, *tuning.results(out), str(tmp_path / "results.json"))
    document = json.loads(Path(next(p for p in Path(path).iterdir() if p.suffix == ".txt")).read_text(encoding="utf-8"))
    assert document["n_references"] == 12 and document["config"]["fit"]["rate"] == 0.01 and document["zero_shot_ranks"]["r3"] == 1
    assert [f["fold"] for f in document["folds"]] == [0, 1] and sum(f["n_test"] for f in document["folds"]) == 12
    assert len(document["out_of_fold_top"]["r3"]) == 40 and document["out_of_fold_top"]["r3"][0] == 3


def test_pretraining_and_its_checkpoint(spark, tmp_path):
    docs = spark.createDataFrame([(1, "og og ord"), (2, "og"), (3, None)], "doc_id bigint, text string")
    trainer = DimensionTrainer(spark)
    start = trainer.start("m", tuning.Fit())
    config = tuning.Tuning("m", pretraining=tuning.Pretraining("tsdae"))
    state, kind = tuning.pretrained(trainer, start, docs, config, str(tmp_path / "c"))
    assert kind == "simcse" and len(set(state.round(6))) == 3
    assert spark.read.parquet(str(tmp_path / "c")).head()["vector"] == state.tolist()
    assert tuning.pretrained(trainer, start, docs, tuning.Tuning("m"))[1] == "none"
