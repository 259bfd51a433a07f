import json

from kildespor import cli
from kildespor.functions import text as T
from kildespor.operators.lexical import BM25
from kildespor.streaming.ranking import rank_stream
from pyspark.sql import functions as F


def study(root):
    (root / "data").mkdir()
    (root / "data-annotations").mkdir()
    texts = ["Himlens Fugle sang", "Havets Fiske svam", "Markens Lilier stod", "Himlens Fugle fløj", "Havets Bølger slog", "Bjerget stod fast"]
    verses = [{"book": "es", "chapter": 1, "verse": i + 1, "text": t} for i, t in enumerate(texts)]
    notes = [{"id": f"r{i}", "annotation_id": f"e{i}", "quote_from_work": texts[i], "book": "es", "chapter": 1, "verse": i + 1} for i in (0, 2, 5)]
    bands = [{"id": n["id"], "jaccard_group": "quote", "jaccard": 1.0, "reference": "x"} for n in notes]
    tokens = {"model": "m", "stem": "s", "corpus_lemma": [t.lower() for t in texts], "corpus_stem": [t.lower() for t in texts], "queries": {n["id"]: {"lemma": n["quote_from_work"].lower(), "stem": n["quote_from_work"].lower()} for n in notes}}
    rankings = [{"id": n["id"], "ft_oof_top20": [5, 4, 3, 2, 1, 0]} for n in notes]
    for name, value in {"data/all_verses_ot_nt.json": verses, "data-annotations/split-annotations.json": notes, "data-annotations/relation_labeling_jaccard.json": bands, "data-annotations/retrieval_tokens_dacy_small.json": tokens, "data-annotations/per_query_oof.json": rankings}.items():
        (root / name).write_text(json.dumps(value), encoding="utf-8")


def test_commands(spark, tmp_path, capsys):
    study(tmp_path)
    cli.main(["--root", str(tmp_path), "rank-lexical", "--bands"])
    shown = capsys.readouterr().out
    assert "bm25_lemstem" in shown and "quote (n=3)" in shown
    cli.main(["--root", str(tmp_path), "rank-dense", "--ablate-ortho"])
    assert "hashing__noortho" in capsys.readouterr().out
    cli.main(["--root", str(tmp_path), "build-study", "--reps", "2"])
    assert list((tmp_path / "artifacts/bws/bws_tuples_key.csv").glob("*.csv")) and "places left over" in capsys.readouterr().out


def test_tuning_from_the_command_line(spark, tmp_path, capsys):
    study(tmp_path)
    cli.main(["--root", str(tmp_path), "tune", "--model", "hashing", "--folds", "2", "--seeds", "2", "--epochs", "1", "--lr", "0.5", "--pretrain", "simcse"])
    assert "pretrain=simcse | 2-fold | soup x2" in capsys.readouterr().out
    text = next((tmp_path / "artifacts/results.json").glob("*.txt")).read_text(encoding="utf-8")
    document = json.loads(text)
    assert document["config"]["fit"]["rate"] == 0.5 and document["n_references"] == 3 and set(document["out_of_fold_ranks"]) == {"r0", "r2", "r5"}
    assert list((tmp_path / "artifacts/cv_checkpoint/metrics").glob("*.json")) and list((tmp_path / "artifacts/domain_pretrained").glob("*.parquet"))


def test_a_stream_of_queries(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "doc_id bigint, tokens array<string>")
    spark.createDataFrame([(5, "bb aa"), (6, None)], "ord bigint, text string").write.parquet(str(tmp_path / "in"))
    docs = docs.select("doc_id", F.transform("tokens", lambda t: F.concat(t, t)).alias("tokens"))
    stream = spark.readStream.schema("ord bigint, text string").parquet(str(tmp_path / "in"))
    seen = []
    q = rank_stream(stream, BM25(docs), T.raw_tokens, lambda ranking, n: seen.extend(ranking.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert [(r["ord"], r["doc_id"], r["rank"]) for r in sorted(seen, key=lambda r: r["rank"])] == [(5, 1, 1), (5, 2, 2)]
