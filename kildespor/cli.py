"""Command line: rank-lexical, rank-dense, tune and build-study over a study's files."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, functions as F

from kildespor.functions import text as T
from kildespor.functions.books import books
from kildespor.operators import gold as G, metrics as M, study as S
from kildespor.operators.encode import EncodedRetriever, HashingEncoder
from kildespor.operators.lexical import BM25, Tfidf, distinct_terms, rank_all
from kildespor.operators.trainers import DimensionTrainer
from kildespor.operators.tuning import Fit, Pretraining, Texts, Tuning, cross_validate, results
from kildespor.plans.shared import written
from kildespor.session import session
from kildespor.sources import files

LEXICAL = {"tfidf_raw": (Tfidf, False), "bm25_raw": (BM25, False), "tfidf_lemstem": (Tfidf, True), "bm25_lemstem": (BM25, True)}


def _load(spark, folders: files.Folders):
    corpus = files.read_corpus(spark, folders.file("verses"))
    notes = files.read_annotations(spark, folders.file("annotations")).withColumnRenamed("quote_from_work", "text")
    refs, gold = G.assemble(notes, corpus, files.read_bands(spark, folders.file("bands")), strict=True)
    return corpus, refs, gold


def _encoder(name: str):
    """'module:function' of a function (model name, device) -> encoder factory; 'hashing' needs none."""
    if name == "hashing":
        return lambda model, device: HashingEncoder
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _show(table: DataFrame) -> None:
    table.select(*[F.round(c, 3).alias(c) if c in M.METRICS else F.col(c) for c in table.columns]).show(100, truncate=False)


def rank_lexical(args, spark, folders) -> None:
    corpus, refs, gold = _load(spark, folders)
    docs, asked = files.read_tokens(spark, folders.file("tokens"))
    files.check_alignment(docs, corpus)
    stems = docs, refs.join(asked, "id", "left").select("ord", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    raw = corpus.select("doc_id", T.raw_tokens(F.col("text")).alias("tokens")), refs.select("ord", T.raw_tokens(F.col("text")).alias("tokens"))
    runs = {}
    for name in args.retrievers:
        kind, stemmed = LEXICAL[name]
        began = time.time()
        d, q = stems if stemmed else raw
        runs[name] = refs.select("ord", "band").join(rank_all(kind(d), q, gold, args.depth), "ord")
        print(f"{name} planned in {time.time() - began:.1f} s")
    _report(runs, args.bands)


def _report(runs: dict[str, DataFrame], bands: bool) -> None:
    table = None
    for name, ranks in runs.items():
        part = ranks.select(F.lit(name).alias("run"), "ord", "rank")
        table = part if table is None else table.unionByName(part)
    _show(M.comparison_table(table).orderBy(F.col("r_at_10").desc(), "run"))
    for name, ranks in runs.items() if bands else ():
        print(name)
        _show(M.with_counts(M.by_band(ranks)))


def rank_dense(args, spark, folders) -> None:
    corpus, refs, gold = _load(spark, folders)
    runs = {}
    for model in args.models:
        for use_ortho in (True, False) if args.ablate_ortho else (not args.no_ortho,):
            r = EncodedRetriever(model, _encoder(args.encoder)(model, args.device), use_ortho, args.clean_queries, args.batch_size, str(folders.embeddings))
            r.encode_corpus(corpus)
            print(T.run_label(model, use_ortho))
            runs[T.run_label(model, use_ortho)] = refs.select("ord", "band").join(r.ranks(refs, gold), "ord")
    _report(runs, args.bands)


def tune(args, spark, folders) -> None:
    corpus, refs, gold = _load(spark, folders)
    config = Tuning(
        args.model, Texts(not args.no_ortho, not args.no_clean_queries), pretraining=Pretraining(args.pretrain),
        fit=Fit(args.epochs, args.batch_size, rate=args.lr, device=args.device), folds=args.folds, souped=args.seeds,
    )
    print(config.describe())
    if args.trainer == "dimensions":
        trainer = DimensionTrainer(spark)
    else:
        module, _, name = args.trainer.partition(":")
        trainer = getattr(importlib.import_module(module), name)(spark)
    out = f"{args.out_dir or folders.artifacts}"

    def after_fold(fold: int, table: DataFrame, ranks: DataFrame) -> None:
        files.write_json(table, f"{out}/cv_checkpoint/metrics", "append" if fold else "overwrite")
        files.write_json(ranks.withColumn("fold", F.lit(fold)), f"{out}/cv_checkpoint/ranks", "append" if fold else "overwrite")
        r = table.where("label = 'overall'").head()
        print(f"fold {fold}: R@10 {r['r_at_10']:.3f} of {r['n']}")

    result = cross_validate(corpus, refs, gold, config, trainer, f"{out}/domain_pretrained", after_fold)
    _show(result["summary"])
    _show(result["band_means"])
    print(files.write_document(spark, *results(result), f"{out}/results.json"))


def build_study(args, spark, folders) -> None:
    corpus, refs, gold = _load(spark, folders)
    docs, asked = files.read_tokens(spark, folders.file("tokens"))
    files.check_alignment(docs, corpus)
    queries = distinct_terms(refs.join(asked, "id").select("ord", "tokens"))
    tuned = refs.select("ord", "id").join(files.read_rankings(spark, folders.file("rankings")), "id").select("ord", "doc_id", "rank")
    pairs = S.pool(refs, gold, corpus, books(spark), BM25(docs).search(queries, 200), tuned, queries, docs)
    pairs = written(pairs)
    S.bin_counts(pairs).orderBy("bin").show()
    out = f"{args.out_dir or folders.artifacts}/bws"
    print(files.write_pool(pairs, out))
    drawn = written(S.tuples(pairs, reps=args.reps, seed=args.seed))
    left = S.left_over(pairs, drawn, args.reps).head()[0]
    print(drawn.select(F.count_distinct("tuple_id")).head()[0], "tuples,", left, "places left over")
    print(*files.write_study(*S.sheets(pairs, drawn), out), sep="\n")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kildespor", description=__doc__)
    top.add_argument("--root", default=".")
    top.add_argument("--master")
    top.add_argument("--checkpoint-dir", help="folder that all executors share, for tables that are written on the way; else spark.checkpoint.dir")
    sub = top.add_subparsers(required=True)

    p = sub.add_parser("rank-lexical")
    p.add_argument("--retrievers", nargs="+", choices=list(LEXICAL), default=list(LEXICAL))
    p.add_argument("--depth", type=int, default=100)
    p.add_argument("--bands", action="store_true")
    p.set_defaults(run=rank_lexical)

    p = sub.add_parser("rank-dense")
    p.add_argument("--models", nargs="+", default=["hashing"])
    p.add_argument("--encoder", default="hashing", help="module:function from a model's name to an encoder factory")
    p.add_argument("--batch-size", type=int, default=64)
    p.add_argument("--device")
    for flag in ("--no-ortho", "--clean-queries", "--ablate-ortho", "--bands"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(run=rank_dense)

    p = sub.add_parser("tune")
    d = Tuning("hashing")
    p.add_argument("--model", default=d.model)
    p.add_argument("--trainer", default="dimensions", help="module:class of a Trainer that takes the session")
    p.add_argument("--folds", type=int, default=d.folds)
    p.add_argument("--seeds", type=int, default=d.souped)
    p.add_argument("--epochs", type=int, default=d.fit.epochs)
    p.add_argument("--batch-size", type=int, default=d.fit.batch)
    p.add_argument("--lr", type=float, default=d.fit.rate)
    p.add_argument("--pretrain", choices=["none", "tsdae", "simcse"], default=d.pretraining.kind)
    p.add_argument("--device")
    p.add_argument("--out-dir")
    for flag in ("--no-ortho", "--no-clean-queries"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(run=tune)

    p = sub.add_parser("build-study")
    p.add_argument("--out-dir")
    p.add_argument("--reps", type=int, default=S.REPS)
    p.add_argument("--seed", type=int, default=S.DEFAULT_SEED)
    p.set_defaults(run=build_study)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(args.master)
    if args.checkpoint_dir:
        spark.conf.set("spark.checkpoint.dir", args.checkpoint_dir)
    args.run(args, spark, files.Folders(args.root))


if __name__ == "__main__":
    main()
