"""The queries of the core operators on the test tables, and the SQL they are compared with.

verses are the corpus, split_annotations the references, relation_labeling
their bands, text_vectors the vectors of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kildespor.functions import text as T
from kildespor.operators import corpus as C, encode as E, gold as G, metrics as M, study as S
from kildespor.operators.dense import Dense
from kildespor.operators.lexical import BM25, Tfidf, distinct_terms, document_frequencies, postings, rank_all
from kildespor.operators.negatives import mine, triples
from kildespor.operators.trainers import Untrained
from kildespor.operators.tuning import Mining, Tuning, cross_validate, results, soup
from kildespor.plans.shared import fresh, together, written
from kildespor.sources import files

Query = Callable[[SparkSession, str], DataFrame]

FOLDS = 5


class Tables:
    """The test tables in the shapes that operators take."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self._assembled: tuple[DataFrame, DataFrame] | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    @property
    def corpus(self) -> DataFrame:
        return C.corpus_of(self.table("verses"))

    @property
    def refs(self) -> DataFrame:
        return self.table("split_annotations").withColumnRenamed("quote_from_work", "text")

    @property
    def gold(self) -> DataFrame:
        return C.spans(self.refs, self.corpus)

    def assembled(self) -> tuple[DataFrame, DataFrame]:
        """(references, gold), written once."""
        if not self._assembled:
            gold = written(self.gold)
            self._assembled = written(G.assemble(self.refs, self.corpus, self.table("relation_labeling"), gold=gold)[0]), gold
        return self._assembled

    def tokens(self, make, of: str) -> DataFrame:
        df = self.corpus if of == "doc_id" else self.refs
        return df.select(of, F.coalesce(make(F.col("text")), F.array().cast("array<string>")).alias("tokens"))

    def vectors(self, tbl: str, name: str) -> DataFrame:
        return self.table("text_vectors").where(F.col("tbl") == tbl).select(F.col("row_id").alias(name), F.col("embedding").alias("vector"))

    def bm25(self, make) -> BM25:
        return BM25(self.tokens(make, "doc_id"))

    def tfidf(self, make) -> Tfidf:
        return Tfidf(self.tokens(make, "doc_id"))

    def dense(self) -> Dense:
        return Dense(self.vectors("verses", "doc_id"))


def stems(text):
    return T.stemmed_tokens(T.ortho(text))


def _top(ranking: DataFrame) -> DataFrame:
    return ranking.select("ord", "doc_id", "rank", F.round("score", 6).alias("score"))


def _rounded(table: DataFrame) -> DataFrame:
    return table.select(*[F.round(c, 6).alias(c) if c in M.METRICS else F.col(c) for c in table.columns])


QUERIES: dict[str, Query] = {}


def query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf: make(Tables(spark, sf))
    return make


@query
def tokenize_raw(t: Tables) -> DataFrame:
    return t.corpus.select("doc_id", F.array_join(T.raw_tokens(F.col("text")), " ").alias("tokens"))


@query
def tokenize_stem(t: Tables) -> DataFrame:
    return t.corpus.select("doc_id", F.array_join(T.stemmed_tokens(F.col("text")), " ").alias("tokens"))


@query
def ortho_normalize(t: Tables) -> DataFrame:
    return t.refs.select("ord", T.ortho(F.col("text")).alias("text"))


@query
def normalize_text(t: Tables) -> DataFrame:
    return t.corpus.select("doc_id", T.normalized(F.col("text")).alias("text"))


@query
def clean_query(t: Tables) -> DataFrame:
    return t.refs.select("ord", T.clean_query(F.col("text")).alias("text"))


@query
def prepared_query(t: Tables) -> DataFrame:
    return t.refs.select("ord", T.prepare_query(F.col("text")).alias("text"))


@query
def book_reference_label(t: Tables) -> DataFrame:
    return C.labels(t.corpus, t.table("books"))


@query
def key_lookup(t: Tables) -> DataFrame:
    return C.lookup(t.refs.select("ord", *C.KEY), t.corpus).select("ord", "doc_id")


@query
def verse_span(t: Tables) -> DataFrame:
    return t.gold


@query
def duplicates_of(t: Tables) -> DataFrame:
    return C.duplicates_of(t.gold, t.corpus)


@query
def adjacent_keys(t: Tables) -> DataFrame:
    return C.adjacent(t.gold, t.corpus)


@query
def gold_assembly(t: Tables) -> DataFrame:
    refs, gold = t.assembled()
    docs = gold.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda d: d.cast("string")), " ").alias("gold"))
    return refs.join(docs, "ord").select("ord", "id", "annotation_id", "band", "jaccard", "citation", "gold")


@query
def sibling_gold(t: Tables) -> DataFrame:
    return G.sibling_gold(*t.assembled())


@query
def jaccard_pairs(t: Tables) -> DataFrame:
    q = t.tokens(stems, "ord").withColumnRenamed("tokens", "q")
    d = t.tokens(stems, "doc_id").withColumnRenamed("tokens", "d")
    pairs = t.gold.join(q, "ord").join(d, "doc_id")
    return pairs.select("ord", "doc_id", F.round(T.jaccard(F.col("q"), F.col("d")), 6).alias("jaccard"))


@query
def postings_df(t: Tables) -> DataFrame:
    docs = t.tokens(T.raw_tokens, "doc_id")
    cf = postings(docs).groupBy("term").agg(F.sum("tf").alias("cf"))
    return document_frequencies(docs).join(cf, "term")


@query
def bm25_raw_top10(t: Tables) -> DataFrame:
    return _top(t.bm25(T.raw_tokens).search(t.tokens(T.raw_tokens, "ord"), 10))


@query
def bm25_raw_top10_padded(t: Tables) -> DataFrame:
    return _top(t.bm25(T.raw_tokens).search(t.tokens(T.raw_tokens, "ord"), 10, pad_zeros=True))


@query
def bm25_stem_top10(t: Tables) -> DataFrame:
    return _top(t.bm25(stems).search(t.tokens(stems, "ord"), 10))


@query
def bm25_distinct_terms_top10(t: Tables) -> DataFrame:
    return _top(t.bm25(stems).search(distinct_terms(t.tokens(stems, "ord")), 10))


@query
def bm25_band(t: Tables) -> DataFrame:
    return _top(t.bm25(stems).band(t.tokens(T.stemmed_tokens, "ord"), 3, 50))


@query
def tfidf_raw_top10(t: Tables) -> DataFrame:
    return _top(t.tfidf(T.raw_tokens).search(t.tokens(T.raw_tokens, "ord"), 10))


@query
def tfidf_stem_top10(t: Tables) -> DataFrame:
    return _top(t.tfidf(stems).search(t.tokens(stems, "ord"), 10))


@query
def bm25_all_scores(t: Tables) -> DataFrame:
    """Of every reference against every document."""
    return t.bm25(T.raw_tokens).scores(t.tokens(T.raw_tokens, "ord")).select("ord", "doc_id", F.round("score", 6).alias("score"))


@query
def tfidf_all_scores(t: Tables) -> DataFrame:
    return t.tfidf(T.raw_tokens).scores(t.tokens(T.raw_tokens, "ord")).select("ord", "doc_id", F.round("score", 6).alias("score"))


def _lexical_ranks(t: Tables, depth: int = 100) -> DataFrame:
    """(ord, band, rank) of the references with gold."""
    refs, gold = t.assembled()
    asked = t.tokens(T.raw_tokens, "ord").join(refs.select("ord"), "ord", "left_semi")
    ranks = rank_all(t.bm25(T.raw_tokens), asked, gold, depth)
    return written(refs.select("ord", "annotation_id", "band").join(ranks, "ord"))


def _dense_ranks(t: Tables) -> DataFrame:
    """(ord, band, rank) of the same references; one without a vector has no rank."""
    refs, gold = t.assembled()
    return written(refs.select("ord", "annotation_id", "band").join(t.dense().ranks(t.vectors("split_annotations", "ord"), gold), "ord", "left"))


@query
def first_gold_rank_depth(t: Tables) -> DataFrame:
    return _lexical_ranks(t).select("ord", "rank")


@query
def dense_top10(t: Tables) -> DataFrame:
    return _top(t.dense().search(t.vectors("split_annotations", "ord"), 10))


@query
def dense_gold_rank(t: Tables) -> DataFrame:
    return _dense_ranks(t).select("ord", "rank")


@query
def dense_ranks_and_top(t: Tables) -> DataFrame:
    """Rank of the best gold document beside the three most similar ones, from one pass."""
    ranks, top = t.dense().ranks_and_top(t.vectors("split_annotations", "ord"), t.assembled()[1], 3)
    return _top(top).join(ranks.withColumnRenamed("rank", "gold_rank"), "ord")


@query
def metrics_overall(t: Tables) -> DataFrame:
    return _rounded(M.metrics(_lexical_ranks(t)))


@query
def metrics_multi_gold(t: Tables) -> DataFrame:
    refs, gold = t.assembled()
    ranking = t.bm25(T.raw_tokens).search(t.tokens(T.raw_tokens, "ord"), 10)
    return _rounded(M.ranking_metrics(ranking, gold, refs))


@query
def metrics_by_band(t: Tables) -> DataFrame:
    return _rounded(M.by_band(_lexical_ranks(t)).drop("place"))


def _comparison(t: Tables) -> DataFrame:
    t.assembled()
    runs = dict(zip(("bm25_raw", "dense"), together(lambda: _lexical_ranks(t), lambda: _dense_ranks(t))))
    both = None
    for run, ranks in runs.items():
        part = ranks.select(F.lit(run).alias("run"), "ord", "rank")
        both = part if both is None else both.unionByName(part)
    return _rounded(M.comparison_table(both))


@query
def comparison_table(t: Tables) -> DataFrame:
    return _comparison(t)


@query
def comparison_order(t: Tables) -> DataFrame:
    """The runs as they are reported: best R@10 first, then by name. One row a run."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("r_at_10").desc(), "run")
    return _comparison(t).select("run", F.row_number().over(order).cast("bigint").alias("place"))


def _folded(t: Tables, ranks: DataFrame) -> DataFrame:
    return M.fold_metrics(ranks.join(G.hash_group_folds(ranks, FOLDS), "ord"))


@query
def fold_metrics(t: Tables) -> DataFrame:
    return _rounded(_folded(t, _lexical_ranks(t)))


@query
def band_fold_means(t: Tables) -> DataFrame:
    return _rounded(M.band_means(_folded(t, _lexical_ranks(t))))


@query
def fold_summary(t: Tables) -> DataFrame:
    table = M.summary(_folded(t, _lexical_ranks(t)), _folded(t, _dense_ranks(t)))
    return table.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "after_std", "delta")])


@query
def band_counts(t: Tables) -> DataFrame:
    return G.band_counts(t.assembled()[0])


@query
def band_indices(t: Tables) -> DataFrame:
    return G.band_indices(t.assembled()[0])


@query
def hash_group_folds(t: Tables) -> DataFrame:
    return G.hash_group_folds(t.refs, FOLDS)


@query
def stratified_group_folds(t: Tables) -> DataFrame:
    return G.stratified_group_folds(t.assembled()[0], FOLDS)


@query
def fold_checks(t: Tables) -> DataFrame:
    """Of stratified_group_folds: references, entries in more than one fold, folds."""
    refs = t.assembled()[0]
    rows = written(refs.select("ord", "annotation_id").join(G.stratified_group_folds(refs, FOLDS), "ord"))
    parted = rows.where("annotation_id is not null").groupBy("annotation_id").agg(F.count_distinct("fold").alias("n")).where("n > 1")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("refs"), F.count_distinct("fold").alias("folds")).withColumn("parted_entries", F.lit(parted.count()))


@query
def reference_slice(t: Tables) -> DataFrame:
    return G.part(t.refs, 5, 15).select("ord", "id")


@query
def references_by_id(t: Tables) -> DataFrame:
    """Those with an id of the first three references."""
    ids = [r["id"] for r in G.part(t.refs, 0, 3).select("id").collect()]
    return G.by_id(t.refs, *ids).select("ord", "id")


@query
def reference_queries(t: Tables) -> DataFrame:
    return G.queries_of(t.refs)


def _negatives(t: Tables) -> DataFrame:
    refs, gold = t.assembled()
    kept = refs.select("ord")
    dense, band = together(
        lambda: t.dense().search(t.vectors("split_annotations", "ord").join(kept, "ord", "left_semi"), 60),
        lambda: t.bm25(stems).band(t.tokens(T.stemmed_tokens, "ord").join(kept, "ord", "left_semi"), 3, 50),
    )
    return mine(dense, band, G.sibling_gold(refs, gold), t.corpus, 16)


@query
def hard_negatives(t: Tables) -> DataFrame:
    return _negatives(t)


@query
def training_triples(t: Tables) -> DataFrame:
    refs, gold = t.assembled()
    docs = t.corpus.select("doc_id", T.ortho(F.col("text")).alias("text"))
    return triples(refs, gold, _negatives(t), docs).select("ord", "positive_id", "negative_id", "query", "positive", "negative")


@query
def weight_soup(t: Tables) -> DataFrame:
    """The mean vector of each label, as (label, pos, x)."""
    mean = soup(t.table("embeddings").select(F.col("label").alias("param"), F.col("embedding").alias("vector")))
    return mean.select(F.col("param").alias("label"), F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def _pool(t: Tables) -> DataFrame:
    refs, gold = t.assembled()
    kept = refs.select("ord")
    queries = written(distinct_terms(t.tokens(stems, "ord").join(kept, "ord", "left_semi")))
    docs = BM25(t.tokens(stems, "doc_id"))
    lexical, tuned = together(lambda: docs.search(queries, 200), lambda: t.dense().search(t.vectors("split_annotations", "ord").join(kept, "ord", "left_semi"), 20))
    return S.pool(refs, gold, t.corpus, t.table("books"), lexical, tuned, queries, docs.docs)


@query
def bws_pool(t: Tables) -> DataFrame:
    return _pool(t).withColumn("jaccard", F.round("jaccard", 6))


@query
def bws_bin_counts(t: Tables) -> DataFrame:
    return S.bin_counts(_pool(t))


@query
def bws_tuples(t: Tables) -> DataFrame:
    return S.tuples(t.table("build_pool"))


@query
def bws_sheet(t: Tables) -> DataFrame:
    pairs = t.table("build_pool")
    return S.sheets(pairs, S.tuples(pairs))[0]


@query
def bws_key(t: Tables) -> DataFrame:
    pairs = t.table("build_pool")
    return S.sheets(pairs, S.tuples(pairs))[1]


@query
def bws_checks(t: Tables) -> DataFrame:
    """Of bws_tuples: places used and left over, and tuples that break a rule."""
    pairs = t.table("build_pool")
    drawn = written(S.tuples(pairs))
    about = pairs.where("pair_id is not null").select("pair_id", "annotation_id", "bin").dropDuplicates(["pair_id"])
    rows = drawn.join(about, "pair_id")

    def broken(*by: str, most: int) -> int:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).count()

    left = S.left_over(pairs, drawn).head()[0]
    counts = {
        "over_bin": broken("tuple_id", "bin", most=S.MAX_PER_BIN), "over_annotation": broken("tuple_id", "annotation_id", most=S.MAX_PER_ANNOTATION),
        "repeated": broken("tuple_id", "pair_id", most=1), "over_reps": broken("pair_id", most=S.REPS),
    }
    unfilled = drawn.groupBy("tuple_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != S.TUPLE_SIZE).count()
    return drawn.agg((F.count(F.lit(1)) + F.lit(left)).alias("places"), *[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()], F.lit(unfilled).cast("bigint").alias("unfilled"))


@query
def hash_encode(t: Tables) -> DataFrame:
    r = E.EncodedRetriever("hashing", E.HashingEncoder)
    return r.encode_corpus(t.corpus.select("doc_id", "text"))


# --- files, written to the shared folder and read back -------------------


@query
def corpus_size(t: Tables) -> DataFrame:
    return t.corpus.agg(F.count(F.lit(1)).alias("n"))


def _corpus_file(t: Tables) -> DataFrame:
    rows = t.corpus.select("doc_id", "book", "chapter", "verse", F.coalesce("text", F.lit("")).alias("text"))
    return files.read_corpus(t.spark, files.write_array(rows, fresh(t.spark), "doc_id"))


@query
def file_corpus(t: Tables) -> DataFrame:
    return _corpus_file(t)


@query
def file_annotations(t: Tables) -> DataFrame:
    return files.read_annotations(t.spark, files.write_array(t.table("split_annotations"), fresh(t.spark), "ord"))


@query
def file_bands(t: Tables) -> DataFrame:
    """Without the places in the file, as the table has no order."""
    rows = t.table("relation_labeling").withColumn("at", F.coalesce("id", F.lit("")))
    return files.read_bands(t.spark, files.write_array(rows, fresh(t.spark), "at")).drop("ord")


def _token_file(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.tokens(T.raw_tokens, "doc_id").join(t.tokens(stems, "doc_id").withColumnRenamed("tokens", "stem"), "doc_id")
    asked = t.refs.groupBy("id").agg(F.max_by("text", "ord").alias("text")).select("id", F.coalesce(T.raw_tokens(F.col("text")), F.array().cast("array<string>")).alias("lemma"))
    path = files.write_tokens(docs.withColumnRenamed("tokens", "lemma"), asked.withColumn("stem", F.col("lemma")), fresh(t.spark))
    return files.read_tokens(t.spark, path)


@query
def file_tokens(t: Tables) -> DataFrame:
    return _token_file(t)[0].select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def file_query_tokens(t: Tables) -> DataFrame:
    return _token_file(t)[1].select("id", F.array_join("tokens", " ").alias("tokens"))


@query
def token_alignment(t: Tables) -> DataFrame:
    docs, corpus = _token_file(t)[0], _corpus_file(t)
    files.check_alignment(docs, corpus)
    return docs.agg(F.count(F.lit(1)).alias("n"))


@query
def file_rankings(t: Tables) -> DataFrame:
    """The most similar documents of each reference, as a rankings file."""
    top = t.dense().search(t.vectors("split_annotations", "ord"), 5).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("t"))
    rows = top.select("ord", F.col("ord").cast("string").alias("id"), F.transform("t", lambda x: x["doc_id"]).alias("ft_oof_top20"))
    return files.read_rankings(t.spark, files.write_array(rows, fresh(t.spark), "ord"))


_POOL_FILE = ", ".join(f"{c} string" for c in "pair_id annotation_id reference category bin jaccard blixen_text bible_text bm25_lemstem_rank dfm_ft_rank".split())


@query
def pool_file(t: Tables) -> DataFrame:
    pairs = t.table("build_pool").drop("loaded_at")
    return files.read_csv(t.spark, files.write_pool(pairs, fresh(t.spark)), _POOL_FILE)


@query
def study_files(t: Tables) -> DataFrame:
    """Of the sheets as written: their rows that don't agree with each other or with the pool."""
    pairs = written(t.table("build_pool").drop("loaded_at").dropDuplicates(["pair_id"]))
    drawn = written(S.tuples(pairs))
    paths = files.write_study(*S.sheets(pairs, drawn), fresh(t.spark))
    kinds = ("tuple_id position pair_id reference blixen_text bible_text BEST WORST", "tuple_id position pair_id annotation_id reference category bin jaccard bm25_lemstem_rank dfm_ft_rank")
    judges, key = (files.read_csv(t.spark, p, ", ".join(f"{c} string" for c in k.split())) for p, k in zip(paths, kinds))
    place = ["tuple_id", "position", "pair_id"]
    shown = drawn.select("tuple_id", F.col("position").cast("string").alias("position"), "pair_id")
    fields = ["pair_id", "annotation_id", "bin", "category", "bm25_lemstem_rank"]
    other = key.select(*fields).distinct().exceptAll(pairs.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).distinct())
    return judges.agg(F.count_if(F.col("BEST").isNotNull() | F.col("WORST").isNotNull()).alias("marked")).select(
        "marked", F.lit(judges.select(place).exceptAll(shown).count()).alias("only_judges"), F.lit(shown.exceptAll(key.select(place)).count()).alias("not_in_key"), F.lit(other.count()).alias("unlike_pool")
    )


@query
def three_digits(t: Tables) -> DataFrame:
    return t.table("relation_labeling").select("id", T.three_digits(F.col("jaccard")).alias("jaccard"))


@query
def tuple_ids(t: Tables) -> DataFrame:
    return t.refs.select("ord", T.tuple_id(F.col("ord")).alias("tuple_id"))


@query
def model_names(t: Tables) -> DataFrame:
    """Prefixes and labels of made-up models' names."""
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("lab/"), "p_brand", F.lit("-E5/"))).otherwise(F.col("p_brand"))
    rows = t.table("part").select("p_partkey", name.alias("m"))
    m = F.col("m")
    return rows.select("p_partkey", T.query_prefix(m).alias("query_prefix"), T.passage_prefix(m).alias("passage_prefix"), T.run_labels(m, True).alias("label"), T.run_labels(m, False).alias("plain_label"))


def _letters(t: Tables, clean: bool = False) -> E.EncodedRetriever:
    return E.EncodedRetriever("letters-e5", E.LetterEncoder, True, clean, cache_dir=fresh(t.spark))


def _long(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.select(name, F.posexplode("vector").alias("pos", "x")).select(name, "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


@query
def embedding_cache(t: Tables) -> DataFrame:
    """Vectors of the corpus as a second run finds them in the cache."""
    r = _letters(t)
    r.encode_corpus(t.corpus)
    r.make = None  # nothing is encoded again
    return _long(r.encode_corpus(t.corpus), "doc_id")


@query
def encoded_queries(t: Tables) -> DataFrame:
    return _long(_letters(t, True).encode_queries(t.refs), "ord")


@query
def encoded_top10(t: Tables) -> DataFrame:
    r = _letters(t, True)
    r.encode_corpus(t.corpus)
    return _top(r.search(t.refs, 10))


def _validated(t: Tables) -> dict:
    refs, gold = t.assembled()
    config = Tuning("letters-e5", mining=Mining(dense=10), folds=FOLDS, souped=1)
    return cross_validate(t.corpus, refs, gold, config, Untrained(E.LetterEncoder, t.spark))


@query
def cross_validated_ranks(t: Tables) -> DataFrame:
    """Out-of-fold ranks of an encoder that no fold changes: its own ranks."""
    return _validated(t)["out_of_fold_ranks"].select("ord", "rank")


@query
def results_document(t: Tables) -> DataFrame:
    """Ranks by reference as the written document has them."""
    path = files.write_document(t.spark, *results(_validated(t)), fresh(t.spark))
    text = t.spark.read.text(path, wholetext=True)
    kinds = "n_references bigint, folds array<struct<fold:int,n_test:bigint>>, zero_shot_ranks map<string,bigint>"
    found = text.select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("d"))
    total = F.aggregate("d.folds", F.lit(0).cast("bigint"), lambda s, f: s + f["n_test"])
    return found.select(F.col("d.n_references").alias("n_references"), total.alias("n_test"), F.explode("d.zero_shot_ranks").alias("id", "rank")).distinct()


# --- SQL ---------------------------------------------------------------

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_SUFFIX = "|".join(T.SUFFIXES)


def _ortho(x: str) -> str:
    cut = f"regexp_replace(coalesce({x}, ''), '(?s){T.LEFTOVER}.*', '')"
    return f"replace(replace(regexp_replace(nfc_normalize({cut}), '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'aa', 'å'), 'Aa', 'Å')"


def _raw(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _stemmed(x: str) -> str:
    return f"list_transform(list_filter({_raw(x)}, lambda w: w NOT IN ({_STOP})), lambda w: regexp_replace(w, '^(.{{3,}}?)(?:{_SUFFIX})$', '\\1'))"


def _even(x: str) -> str:
    return f"nfc_normalize(trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g')))"


def _clean(x: str) -> str:
    bare = f"translate(coalesce({x}, ''), '{T.QUOTES.replace(chr(39), chr(39) * 2)}', '')"
    said = rf"(?i),?{_SPACE}*(?:{'|'.join(T.SPEECH_VERBS)}){_SPACE}+(?:{'|'.join(T.PRONOUNS)})(?:[^\p{{L}}\p{{N}}_,.;][^,.;]*|([,.;])|$)"
    return _even(f"regexp_replace({bare}, '{said}', '\\1', 'g')")


_CORPUS = """
corpus AS (SELECT verse_index AS doc_id, book, chapter, verse, text FROM verses),
keyed AS (SELECT book, chapter, verse, max(doc_id) AS doc_id FROM corpus GROUP BY ALL),
gold AS (SELECT r.ord, k.doc_id FROM split_annotations r JOIN keyed k ON r.book = k.book AND r.chapter = k.chapter
  AND k.verse BETWEEN r.verse AND coalesce(nullif(r.verse_end, 0), r.verse))"""
_SAME = _CORPUS + f""",
normal AS (SELECT doc_id, {_even('text')} AS norm FROM corpus WHERE text IS NOT NULL)"""
_ADJACENT = """
ends AS (SELECT ord, min(doc_id) AS a, max(doc_id) AS b FROM gold GROUP BY ord),
adjacent AS (SELECT DISTINCT e.ord, k.doc_id FROM ends e JOIN corpus c ON c.doc_id = e.a JOIN keyed k ON k.book = c.book AND k.chapter = c.chapter AND k.verse = c.verse - 1
  UNION SELECT e.ord, k.doc_id FROM ends e JOIN corpus c ON c.doc_id = e.b JOIN keyed k ON k.book = c.book AND k.chapter = c.chapter AND k.verse = c.verse + 1)"""
_REFS = _CORPUS + """,
bands AS (SELECT id, jaccard_group AS band, jaccard, reference AS citation FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY jaccard_group NULLS LAST, jaccard NULLS LAST, reference NULLS LAST) AS r FROM relation_labeling WHERE id IS NOT NULL) WHERE r = 1),
refs AS (SELECT s.*, b.band, b.jaccard, b.citation FROM split_annotations s LEFT JOIN bands b ON s.id = b.id WHERE s.ord IN (SELECT ord FROM gold))"""
_SIBLINGS = """
siblings AS (SELECT DISTINCT r.ord, g.doc_id FROM refs r JOIN refs o ON r.ord = o.ord OR r.annotation_id = o.annotation_id JOIN gold g ON g.ord = o.ord)"""


def _tokens_sql(document: str, asked: str, distinct: bool) -> str:
    asked = f"list_distinct({asked})" if distinct else asked
    return f"""
d AS (SELECT verse_index AS doc_id, coalesce({document}, []) AS toks FROM verses),
q AS (SELECT ord, coalesce({asked}, []) AS toks FROM split_annotations),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
qtfs AS (SELECT ord, term, count(*) AS qtf FROM (SELECT ord, unnest(toks) AS term FROM q) GROUP BY ALL),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tfs GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(toks) AS DOUBLE)) AS av FROM d)"""


_RANK = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"""


def _bm25_sql(document: str, asked: str, distinct: bool = False) -> str:
    return _tokens_sql(document, asked, distinct) + """,
raw AS (SELECT term, ln(n - df + CAST(0.5 AS DOUBLE)) - ln(df + CAST(0.5 AS DOUBLE)) AS i FROM dfs, n),
idf AS (SELECT term, CASE WHEN i < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(i) FROM raw) ELSE i END AS idf FROM raw),
scored AS (SELECT ord, doc_id, sum(qtf * idf * (tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(toks) / av)))) AS score
  FROM qtfs JOIN tfs USING (term) JOIN idf USING (term) JOIN d USING (doc_id), n GROUP BY ord, doc_id),""" + _RANK


def _tfidf_sql(document: str, asked: str) -> str:
    return _tokens_sql(document, asked, False) + """,
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, n),
dw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tfs JOIN idf USING (term)),
qw AS (SELECT ord, term, (1 + ln(qtf)) * idf AS w FROM qtfs JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
qn AS (SELECT ord, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ord),
scored AS (SELECT ord, doc_id, sum(qw.w / qn.norm * dw.w / dn.norm) AS score
  FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (ord) GROUP BY ord, doc_id),""" + _RANK


_STEMS, _QUERY_STEMS = _stemmed(_ortho("text")), _stemmed(_ortho("quote_from_work"))
_BM25_RAW = _bm25_sql(_raw("text"), _raw("quote_from_work"))
_SHOW = "SELECT ord, doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank "

_VECTORS = """
units AS (SELECT tbl, row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v
  FROM text_vectors WHERE list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))) > 0),
sims AS (SELECT a.row_id AS ord, b.row_id AS doc_id, list_dot_product(a.v, b.v) AS score FROM units a, units b WHERE a.tbl = 'split_annotations' AND b.tbl = 'verses'),
dense AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sims)"""
_DENSE_RANKS = """
best AS (SELECT s.ord, max(round(s.score, 9)) AS m FROM sims s JOIN gold g ON s.ord = g.ord AND s.doc_id = g.doc_id GROUP BY s.ord),
dense_found AS (SELECT b.ord, 1 + CAST(count_if(round(s.score, 9) > m) AS BIGINT) AS rank FROM best b JOIN sims s ON b.ord = s.ord GROUP BY b.ord),
dense_ranks AS (SELECT r.ord, r.annotation_id, r.band, f.rank FROM refs r LEFT JOIN dense_found f ON r.ord = f.ord)"""
_LEXICAL_RANKS = """
lexical_ranks AS (SELECT r.ord, r.annotation_id, r.band, min(k.rank) AS rank FROM refs r LEFT JOIN gold g ON g.ord = r.ord
  LEFT JOIN (SELECT * FROM ranked WHERE rank <= 100) k ON k.ord = r.ord AND k.doc_id = g.doc_id GROUP BY ALL)"""
_GAINS = {
    "p_at_1": "CAST(coalesce(rank = 1, false) AS DOUBLE)",
    "r_at_10": "CAST(coalesce(rank BETWEEN 1 AND 10, false) AS DOUBLE)",
    "mrr_at_10": "CASE WHEN rank BETWEEN 1 AND 10 THEN CAST(1 AS DOUBLE) / rank ELSE CAST(0 AS DOUBLE) END",
    "ndcg_at_10": "CASE WHEN rank BETWEEN 1 AND 10 THEN CAST(1 AS DOUBLE) / log2(rank + CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END",
}
_MEANS = ", ".join(f"round(avg({g}), 6) AS {m}" for m, g in _GAINS.items())
_PLAIN_MEANS = ", ".join(f"avg({g}) AS {m}" for m, g in _GAINS.items())
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in M.METRICS)
_FOLD = "coalesce(CAST(('0x' || substr(md5(annotation_id), 1, 8))::BIGINT % 5 AS INTEGER), 0)"
_KNOWN = "(VALUES ('quote'), ('paraphrase'), ('allusion')) k(label)"
_RUN = f"WITH {_REFS}, {_BM25_RAW}, {_LEXICAL_RANKS}"
_BOTH = f"{_RUN}, {_VECTORS}, {_DENSE_RANKS}"

_NEGATIVES = f"""WITH {_REFS}, {_SIBLINGS}, {_VECTORS}, {_bm25_sql(_STEMS, _stemmed('quote_from_work'))},
normal AS (SELECT doc_id, {_even('text')} AS norm FROM corpus WHERE text IS NOT NULL),
excluded AS (SELECT ord, doc_id FROM siblings UNION SELECT s.ord, o.doc_id FROM siblings s JOIN normal n ON n.doc_id = s.doc_id JOIN normal o ON o.norm = n.norm),
candidates AS (SELECT ord, doc_id, 0 AS src, rank FROM dense WHERE rank <= 60 UNION ALL SELECT ord, doc_id, 1, rank FROM ranked WHERE rank BETWEEN 4 AND 50),
allowed AS (SELECT ord, doc_id, min(src * 1000 + rank) AS place FROM candidates c WHERE ord IN (SELECT ord FROM refs)
  AND NOT EXISTS (SELECT 1 FROM excluded e WHERE e.ord = c.ord AND e.doc_id = c.doc_id) GROUP BY ord, doc_id),
negatives AS (SELECT ord, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY place) AS position FROM allowed) WHERE position <= 16)"""

_POOL = f"""WITH {_REFS}, {_ADJACENT}, {_VECTORS}, {_bm25_sql(_STEMS, _QUERY_STEMS, True)},
normal AS (SELECT doc_id, {_even('text')} AS norm FROM corpus WHERE text IS NOT NULL),
excluded AS (SELECT ord, doc_id FROM gold UNION SELECT g.ord, o.doc_id FROM gold g JOIN normal n ON n.doc_id = g.doc_id JOIN normal o ON o.norm = n.norm UNION SELECT * FROM adjacent),
a AS (SELECT ord, doc_id FROM ranked WHERE rank <= 3 EXCEPT SELECT * FROM excluded),
b AS (SELECT ord, doc_id FROM dense WHERE rank <= 3 EXCEPT SELECT * FROM excluded),
u AS (SELECT * FROM a UNION SELECT * FROM b),
j AS (SELECT u.ord, u.doc_id, CASE WHEN len(list_distinct(list_concat(q.toks, d.toks))) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(q.toks, d.toks)) / len(list_distinct(list_concat(q.toks, d.toks)))::DOUBLE END AS overlap FROM u JOIN q USING (ord) JOIN d USING (doc_id)),
pool AS (SELECT DISTINCT r.id || '__' || c.book || c.chapter || '.' || c.verse AS pair_id, r.id AS annotation_id,
  coalesce(bk.book_name, c.book) || ' ' || c.chapter || ':' || c.verse AS reference, r.band AS category,
  CASE WHEN a.ord IS NOT NULL AND b.ord IS NOT NULL THEN '1_both' WHEN a.ord IS NOT NULL THEN '2_bm25_only' WHEN overlap > 0 THEN '3_dfmft_only_jac' ELSE '4_dfmft_only_zero' END AS bin,
  round(overlap, 6) AS jaccard, r.quote_from_work AS blixen_text, c.text AS bible_text, k.rank AS bm25_lemstem_rank, t.rank AS dfm_ft_rank
  FROM j JOIN refs r USING (ord) JOIN corpus c USING (doc_id) LEFT JOIN books bk ON bk.book = c.book
  LEFT JOIN a ON a.ord = j.ord AND a.doc_id = j.doc_id LEFT JOIN b ON b.ord = j.ord AND b.doc_id = j.doc_id
  LEFT JOIN ranked k ON k.ord = j.ord AND k.doc_id = j.doc_id AND k.rank <= 200 LEFT JOIN dense t ON t.ord = j.ord AND t.doc_id = j.doc_id AND t.rank <= 20)"""

_LETTERS = E.LetterEncoder.letters
_POOL_TEXTS = "pair_id annotation_id reference category bin blixen_text bible_text bm25_lemstem_rank dfm_ft_rank".split()


def _letter_units(name: str, of: str, table: str, prefix: str) -> str:
    """(name, v): letter counts with length 1, in single precision."""
    counts = ", ".join(f"length(x) - length(replace(x, '{c}', ''))" for c in _LETTERS)
    return f"""(SELECT {name}, [CAST(CASE WHEN n > 0 THEN c / n ELSE 0 END AS FLOAT) for c in counts] AS v FROM (
  SELECT {name}, counts, sqrt(list_sum([CAST(c * c AS DOUBLE) for c in counts])) AS n FROM (
  SELECT {name}, [{counts}] AS counts FROM (SELECT {name}, '{prefix}' || {of} AS x FROM {table}))))"""


_LETTER_DOCS = _letter_units("doc_id", _ortho("text"), "(SELECT verse_index AS doc_id, text FROM verses)", "passage: ")
_LETTER_QUERIES = _letter_units("ord", _ortho(_clean("quote_from_work")), "split_annotations", "query: ")
_DOUBLES = "list_transform(v, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(v, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
_LETTER_SIMS = f"""
lq AS (SELECT ord, {_DOUBLES} AS v FROM {_LETTER_QUERIES}), ld AS (SELECT doc_id, {_DOUBLES} AS v FROM {_LETTER_DOCS}),
sims AS (SELECT ord, doc_id, list_dot_product(lq.v, ld.v) AS score FROM lq, ld)"""
_LETTER_RANKS = f"WITH {_REFS}, {_LETTER_SIMS}, {_DENSE_RANKS}"

ORACLES: dict[str, str] = {
    "tokenize_raw": f"SELECT verse_index AS doc_id, array_to_string({_raw('text')}, ' ') AS tokens FROM verses",
    "tokenize_stem": f"SELECT verse_index AS doc_id, array_to_string({_stemmed('text')}, ' ') AS tokens FROM verses",
    "ortho_normalize": f"SELECT ord, {_ortho('quote_from_work')} AS text FROM split_annotations",
    "normalize_text": f"SELECT verse_index AS doc_id, {_even('text')} AS text FROM verses",
    "clean_query": f"SELECT ord, {_clean('quote_from_work')} AS text FROM split_annotations",
    "prepared_query": f"SELECT ord, {_ortho(_clean('quote_from_work'))} AS text FROM split_annotations",
    "book_reference_label": "SELECT verse_index AS doc_id, coalesce(book_name, verses.book) || ' ' || chapter || ':' || verse AS label FROM verses LEFT JOIN books ON books.book = verses.book",
    "key_lookup": f"WITH {_CORPUS} SELECT r.ord, k.doc_id FROM split_annotations r LEFT JOIN keyed k ON r.book = k.book AND r.chapter = k.chapter AND r.verse = k.verse",
    "verse_span": f"WITH {_CORPUS} SELECT * FROM gold",
    "duplicates_of": f"WITH {_SAME} SELECT ord, doc_id FROM gold UNION SELECT g.ord, o.doc_id FROM gold g JOIN normal n ON n.doc_id = g.doc_id JOIN normal o ON o.norm = n.norm",
    "adjacent_keys": f"WITH {_CORPUS}, {_ADJACENT} SELECT * FROM adjacent",
    "gold_assembly": f"WITH {_REFS} SELECT r.ord, r.id, r.annotation_id, r.band, r.jaccard, r.citation, (SELECT string_agg(CAST(g.doc_id AS VARCHAR), ' ' ORDER BY g.doc_id) FROM gold g WHERE g.ord = r.ord) AS gold FROM refs r",
    "sibling_gold": f"WITH {_REFS}, {_SIBLINGS} SELECT * FROM siblings",
    "jaccard_pairs": f"WITH {_CORPUS}, q AS (SELECT ord, coalesce({_QUERY_STEMS}, []) AS q FROM split_annotations), d AS (SELECT verse_index AS doc_id, coalesce({_STEMS}, []) AS d FROM verses) "
    "SELECT ord, doc_id, CASE WHEN len(list_concat(q, d)) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(q, d)) / len(list_distinct(list_concat(q, d)))::DOUBLE, 6) END AS jaccard FROM gold JOIN q USING (ord) JOIN d USING (doc_id)",
    "postings_df": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT verse_index AS doc_id, unnest({_raw('text')}) AS term FROM verses) GROUP BY term",
    "bm25_raw_top10": f"WITH {_BM25_RAW} {_SHOW} <= 10",
    "bm25_raw_top10_padded": f"WITH {_BM25_RAW}, padded AS (SELECT ord, doc_id, score FROM scored UNION ALL SELECT q.ord, d.doc_id, 0.0 FROM q, d WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.ord = q.ord AND s.doc_id = d.doc_id)) "
    "SELECT ord, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(score, 9) DESC, doc_id) AS rank FROM padded) WHERE rank <= 10",
    "bm25_stem_top10": f"WITH {_bm25_sql(_STEMS, _QUERY_STEMS)} {_SHOW} <= 10",
    "bm25_distinct_terms_top10": f"WITH {_bm25_sql(_STEMS, _QUERY_STEMS, True)} {_SHOW} <= 10",
    "bm25_band": f"WITH {_bm25_sql(_STEMS, _stemmed('quote_from_work'))} {_SHOW} BETWEEN 4 AND 50",
    "tfidf_raw_top10": f"WITH {_tfidf_sql(_raw('text'), _raw('quote_from_work'))} {_SHOW} <= 10",
    "tfidf_stem_top10": f"WITH {_tfidf_sql(_STEMS, _QUERY_STEMS)} {_SHOW} <= 10",
    "bm25_all_scores": f"WITH {_BM25_RAW} SELECT q.ord, d.doc_id, round(coalesce(score, 0), 6) AS score FROM q CROSS JOIN d LEFT JOIN scored s ON s.ord = q.ord AND s.doc_id = d.doc_id",
    "tfidf_all_scores": f"WITH {_tfidf_sql(_raw('text'), _raw('quote_from_work'))} SELECT q.ord, d.doc_id, round(coalesce(score, 0), 6) AS score FROM q CROSS JOIN d LEFT JOIN scored s ON s.ord = q.ord AND s.doc_id = d.doc_id",
    "first_gold_rank_depth": f"{_RUN} SELECT ord, rank FROM lexical_ranks",
    "dense_top10": f"WITH {_VECTORS} SELECT ord, doc_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10",
    "dense_gold_rank": f"WITH {_REFS}, {_VECTORS}, {_DENSE_RANKS} SELECT ord, rank FROM dense_ranks",
    "dense_ranks_and_top": f"WITH {_REFS}, {_VECTORS}, {_DENSE_RANKS} SELECT d.ord, d.doc_id, d.rank, round(d.score, 6) AS score, f.rank AS gold_rank FROM dense d LEFT JOIN dense_found f ON d.ord = f.ord WHERE d.rank <= 3",
    "metrics_overall": f"{_RUN} SELECT {_MEANS}, count(*) AS n FROM lexical_ranks",
    "metrics_multi_gold": f"""{_RUN}, sizes AS (SELECT ord, count(DISTINCT doc_id) AS n_gold FROM gold GROUP BY ord),
ideal AS (SELECT ord, (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, 11) t(i) WHERE i <= n_gold) AS ideal FROM sizes),
hits AS (SELECT k.ord, min(k.rank) AS rank, sum(1 / log2(k.rank + 1.0::DOUBLE)) AS dcg FROM ranked k JOIN gold g ON g.ord = k.ord AND g.doc_id = k.doc_id WHERE k.rank <= 10 GROUP BY k.ord)
SELECT r.ord, {', '.join(f'round({_GAINS[m]}, 6) AS {m}' for m in M.METRICS[:3])}, round(coalesce(dcg / ideal, 0), 6) AS ndcg_at_10
FROM refs r LEFT JOIN ideal USING (ord) LEFT JOIN hits USING (ord)""",
    "metrics_by_band": f"""{_RUN}, per AS (SELECT label, count(ord) AS n, {', '.join(f'avg(CASE WHEN ord IS NOT NULL THEN {g} END) AS {m}' for m, g in _GAINS.items())} FROM {_KNOWN} LEFT JOIN lexical_ranks ON band = label GROUP BY label)
SELECT label, n, {_ROUNDED} FROM per UNION ALL SELECT 'macro-avg', NULL, {', '.join(f'round(avg({m}), 6)' for m in M.METRICS)} FROM per
UNION ALL SELECT 'overall', count(*), {_MEANS} FROM lexical_ranks""",
    "comparison_table": f"{_BOTH} SELECT 'bm25_raw' AS run, {_MEANS}, count(*) AS n FROM lexical_ranks UNION ALL SELECT 'dense', {_MEANS}, count(*) FROM dense_ranks",
    "fold_metrics": f"""{_RUN}, f AS (SELECT *, {_FOLD} AS fold FROM lexical_ranks)
SELECT fold, 'overall' AS label, count(*) AS n, {_MEANS} FROM f GROUP BY fold
UNION ALL SELECT x.fold, label, count(f.ord), {', '.join(f'round(avg(CASE WHEN f.ord IS NOT NULL THEN {g} END), 6)' for g in _GAINS.values())}
FROM (SELECT DISTINCT fold FROM f) x CROSS JOIN {_KNOWN} LEFT JOIN f ON f.fold = x.fold AND f.band = label GROUP BY x.fold, label""",
    "fold_summary": f"""{_BOTH}, x AS (SELECT {_FOLD} AS fold, {_PLAIN_MEANS} FROM lexical_ranks GROUP BY fold),
y AS (SELECT {_FOLD} AS fold, {_PLAIN_MEANS} FROM dense_ranks GROUP BY fold)
{' UNION ALL '.join(f"SELECT '{m}' AS metric, round(avg(x.{m}), 6) AS before, round(avg(y.{m}), 6) AS after, round(stddev_pop(y.{m}), 6) AS after_std, round(avg(y.{m}) - avg(x.{m}), 6) AS delta FROM x FULL JOIN y ON x.fold = y.fold" for m in M.METRICS)}""",
    "band_counts": f"WITH {_REFS} SELECT label AS band, count(ord) AS n FROM {_KNOWN} LEFT JOIN refs ON band = label GROUP BY label",
    "band_indices": f"WITH {_REFS} SELECT band, ord, row_number() OVER (PARTITION BY band ORDER BY ord) - 1 AS position FROM refs WHERE band IN ('quote', 'paraphrase', 'allusion')",
    "hash_group_folds": f"SELECT ord, {_FOLD} AS fold FROM split_annotations",
    "hard_negatives": f"{_NEGATIVES} SELECT * FROM negatives",
    "training_triples": f"""{_NEGATIVES}, positives AS (SELECT ord, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY doc_id) AS r FROM (SELECT DISTINCT * FROM gold)) WHERE r <= 3)
SELECT n.ord, p.doc_id AS positive_id, n.doc_id AS negative_id, {_ortho(_clean('r.quote_from_work'))} AS query, {_ortho('a.text')} AS positive, {_ortho('b.text')} AS negative
FROM negatives n JOIN positives p ON p.ord = n.ord JOIN refs r ON r.ord = n.ord JOIN corpus a ON a.doc_id = p.doc_id JOIN corpus b ON b.doc_id = n.doc_id""",
    "weight_soup": "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i",
    "bws_pool": f"{_POOL} SELECT * FROM pool",
    "bws_bin_counts": f"{_POOL} SELECT bin, count(*) AS n FROM pool GROUP BY bin",
    "comparison_order": f"{_BOTH}, c AS (SELECT 'bm25_raw' AS run, {_MEANS} FROM lexical_ranks UNION ALL SELECT 'dense', {_MEANS} FROM dense_ranks) SELECT run, row_number() OVER (ORDER BY r_at_10 DESC, run) AS place FROM c",
    "band_fold_means": f"""{_RUN}, f AS (SELECT {_FOLD} AS fold, band, {_PLAIN_MEANS} FROM lexical_ranks GROUP BY fold, band)
SELECT label AS band, {', '.join(f'round(avg({m}), 6) AS {m}' for m in M.METRICS)} FROM {_KNOWN} LEFT JOIN f ON band = label GROUP BY label""",
    "fold_checks": f"WITH {_REFS} SELECT count(*) AS n, count(*) AS refs, CAST(5 AS BIGINT) AS folds, CAST(0 AS BIGINT) AS parted_entries FROM refs",
    "reference_slice": "SELECT ord, id FROM split_annotations ORDER BY ord LIMIT 10 OFFSET 5",
    "references_by_id": "SELECT ord, id FROM split_annotations WHERE id IN (SELECT id FROM split_annotations ORDER BY ord LIMIT 3)",
    "reference_queries": "SELECT ord, quote_from_work AS text FROM split_annotations",
    "bws_checks": "SELECT CAST(4 * count(DISTINCT pair_id) AS BIGINT) AS places, CAST(0 AS BIGINT) AS over_bin, CAST(0 AS BIGINT) AS over_annotation, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS over_reps, CAST(0 AS BIGINT) AS unfilled FROM build_pool",
    "corpus_size": "SELECT count(*) AS n FROM verses",
    "file_corpus": "SELECT row_number() OVER (ORDER BY verse_index) - 1 AS doc_id, book, chapter, verse, coalesce(text, '') AS text FROM verses",
    "file_annotations": "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, * EXCLUDE (ord) FROM split_annotations",
    "file_bands": "SELECT id, jaccard_group, jaccard, reference FROM relation_labeling",
    "file_tokens": f"SELECT row_number() OVER (ORDER BY verse_index) - 1 AS doc_id, coalesce(array_to_string({_STEMS}, ' '), '') AS tokens FROM verses",
    "file_query_tokens": f"SELECT id, coalesce(array_to_string({_raw('t')}, ' '), '') AS tokens FROM (SELECT id, arg_max(quote_from_work, ord) AS t FROM split_annotations GROUP BY id)",
    "token_alignment": "SELECT count(*) AS n FROM verses",
    "file_rankings": f"WITH {_VECTORS} SELECT CAST(ord AS VARCHAR) AS id, doc_id, rank FROM dense WHERE rank <= 5",
    "pool_file": f"SELECT {', '.join(f'nullif(CAST({c} AS VARCHAR), repeat(chr(32), 0)) AS {c}' for c in _POOL_TEXTS)}, printf('%.3f', jaccard) AS jaccard FROM build_pool",
    "study_files": "SELECT CAST(0 AS BIGINT) AS marked, CAST(0 AS INTEGER) AS only_judges, CAST(0 AS INTEGER) AS not_in_key, CAST(0 AS INTEGER) AS unlike_pool",
    "three_digits": "SELECT id, printf('%.3f', jaccard) AS jaccard FROM relation_labeling",
    "tuple_ids": "SELECT ord, printf('T%04d', ord) AS tuple_id FROM split_annotations",
    "model_names": "SELECT p_partkey, if(p_size % 2 = 0, 'query: ', '') AS query_prefix, if(p_size % 2 = 0, 'passage: ', '') AS passage_prefix, p_brand || if(p_size % 2 = 0, '-E5', '') || '__ortho' AS label, p_brand || if(p_size % 2 = 0, '-E5', '') || '__noortho' AS plain_label FROM part",
    "embedding_cache": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(v[i] AS DOUBLE), 6) AS x FROM {_LETTER_DOCS}, range(1, {len(_LETTERS) + 1}) t(i)",
    "encoded_queries": f"SELECT ord, CAST(i - 1 AS INTEGER) AS pos, round(CAST(v[i] AS DOUBLE), 6) AS x FROM {_LETTER_QUERIES}, range(1, {len(_LETTERS) + 1}) t(i)",
    "encoded_top10": f"WITH {_LETTER_SIMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sims) {_SHOW} <= 10",
    "cross_validated_ranks": f"{_LETTER_RANKS} SELECT ord, rank FROM dense_ranks",
    "results_document": f"{_LETTER_RANKS} SELECT DISTINCT (SELECT count(*) FROM refs) AS n_references, (SELECT count(*) FROM refs) AS n_test, r.id, d.rank FROM dense_ranks d JOIN refs r USING (ord)",
}
