"""Exact TF-IDF and BM25 ranking.

Statistics of the collection (document frequencies, lengths, norms) are
DataFrame aggregations over all documents. Scoring goes block by block: queries
are dealt by hash to blocks of about BLOCK_TERMS (query, term) weights, each
block is broadcast, and each task scores its documents against all of its
queries with an inverted index of its own and keeps the first k of each query. So no
(query, document) pair is shuffled but the k best of each task, and neither a
common term nor a long document makes a large task.

Order is by score rounded to 9 digits, descending, then doc_id. A document
matches when it has a term of the query, whatever the score's sign. Null
texts have no terms but count as documents, as empty ones do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from kildespor.plans.shared import together, written

#: Weights (query, term) that are broadcast at once, about; one query's are never parted.
BLOCK_TERMS = 400_000
#: Documents and queries whose scores a task holds at a time, as one matrix. Fewer documents come first, for thresholds.
_STRETCH, _FIRST, _CHUNK = 65_536, 4096, 16
#: A term in more than this share of a stretch's documents is multiplied as a full row.
_DENSE = 1 / 16


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """(ord, doc_id, score, rank) for queries (ord, tokens)."""


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) of (doc_id, tokens)."""
    return (
        docs.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy("doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df)."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


class _Block(NamedTuple):
    """Queries of a block and the weights of their terms, sorted by query."""

    ids: np.ndarray
    terms: np.ndarray
    ends: np.ndarray  # of each query's weights, from 0
    term: np.ndarray
    weight: np.ndarray


def _block(rows: pa.Table) -> _Block:
    """rows: (ord, term, weight)."""
    ids, query = np.unique(rows["ord"].to_numpy(), return_inverse=True)
    names = rows["term"].combine_chunks().dictionary_encode()
    names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
    term, weight = names.indices.to_numpy(), rows["weight"].to_numpy()
    order = np.lexsort((term, query))
    ends = np.r_[0, np.cumsum(np.bincount(query, minlength=len(ids)))]
    return _Block(ids, names.dictionary.to_numpy(zero_copy_only=False), ends, term[order].astype(np.int64), weight[order])


class _Postings:
    """The terms of a stretch of documents that a block's queries have."""

    def __init__(self, table: pa.Table, names: pa.Array, document_weight: Callable):
        self.docs = table["doc_id"].to_numpy()
        tokens = table["tokens"].combine_chunks()
        if isinstance(tokens, pa.ChunkedArray):
            tokens = pa.concat_arrays(tokens.chunks)
        slot = pc.index_in(pc.list_flatten(tokens), names)
        known = slot.is_valid().to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(tokens).to_numpy()[known].astype(np.int64)
        n = len(self.docs)
        code, tf = np.unique(slot.drop_null().to_numpy().astype(np.int64) * n + row, return_counts=True)
        self.row = code % n
        self.value = document_weight(tf.astype(np.float64), table["side"].to_numpy(zero_copy_only=False)[self.row])
        self.start = np.searchsorted(code // n, np.arange(len(names) + 1))
        self.count = np.diff(self.start)
        self.full: dict[int, np.ndarray] = {}
        self.most, filled = np.zeros(len(names)), self.count > 0
        if filled.any():
            self.most[filled] = np.maximum.reduceat(self.value, self.start[:-1][filled])
        self.sum, self.last = np.zeros(n), np.zeros(n, np.int64)

    def reaching(self, block: _Block, query: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents by row, scores) of at least bound, where all weights are positive.

        Terms that can't reach the bound together give no documents, only scores to those that the other terms give.
        """
        at = slice(block.ends[query], block.ends[query + 1])
        there = self.count[block.term[at]] > 0
        term, weight = block.term[at][there], block.weight[at][there]
        most = weight * self.most[term]
        order = np.argsort(most)
        upto = np.cumsum(most[order])
        few = int(np.searchsorted(upto, bound))
        if few == len(order):
            return np.zeros(0, np.int64), np.zeros(0)
        rows = []
        for i in order[few:].tolist():
            own = slice(self.start[term[i]], self.start[term[i] + 1])
            rows.append(self.row[own])
            self.sum[rows[-1]] += weight[i] * self.value[own]
        row = np.concatenate(rows)
        found = row[self.sum[row] + (upto[few - 1] if few else 0.0) >= bound]
        number = np.arange(len(found))
        self.last[found] = number
        found = found[self.last[found] == number]  # each once
        score = self.sum[found]
        self.sum[row] = 0.0
        for i in order[:few].tolist():
            if not len(found):
                break
            if self.count[term[i]] > _DENSE * len(self.docs):
                score += weight[i] * self._full(term[i])[found]
                continue
            own = slice(self.start[term[i]], self.start[term[i] + 1])
            place = np.minimum(np.searchsorted(self.row[own], found), self.count[term[i]] - 1)
            score += np.where(self.row[own][place] == found, weight[i] * self.value[own][place], 0.0)
        keep = score >= bound
        return found[keep], score[keep]

    def scores(self, block: _Block, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, whether there is a common term) of queries first to last - 1, by documents."""
        at = slice(block.ends[first], block.ends[last])
        term, weight = block.term[at], block.weight[at]
        query = np.repeat(np.arange(last - first), np.diff(block.ends[first : last + 1]))
        n = len(self.docs)
        common = self.count[term] > _DENSE * n
        kinds, kind = np.unique(term[common], return_inverse=True)
        w = np.zeros((last - first, len(kinds)))
        w[query[common], kind] = weight[common]
        v = np.stack([self._full(t) for t in kinds.tolist()]) if len(kinds) else np.zeros((0, n))
        out = w @ v if len(kinds) else np.zeros((last - first, n))
        seen = (w != 0).astype(np.float32) @ (v != 0).astype(np.float32) > 0
        rare = ~common & (self.count[term] > 0)
        start = self.start
        for q, t, x in zip(query[rare].tolist(), term[rare].tolist(), weight[rare].tolist()):
            own = slice(start[t], start[t + 1])
            out[q][self.row[own]] += x * self.value[own]
            seen[q][self.row[own]] = True
        return out, seen

    def _full(self, t: int) -> np.ndarray:
        """A common term's value for each document, made once."""
        if t not in self.full:
            own = slice(self.start[t], self.start[t + 1])
            self.full[t] = np.zeros(len(self.docs))
            self.full[t][self.row[own]] = self.value[own]
        return self.full[t]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of _FIRST rows, then of _STRETCH."""
    held, count, rows = [], 0, _FIRST
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, rows - count))
            count, at = count + held[-1].num_rows, at + held[-1].num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count, rows = [], 0, _STRETCH
    if held:
        yield pa.Table.from_batches(held)


_SCORED = ["ord", "doc_id", "score"]


def _scorer(shared, k: int | None, document_weight: Callable):
    """Rows (doc_id, tokens, side) to each query's k best, or with k None to all documents' scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        names = pa.array(block.terms, pa.string())
        chunks = [(a, min(a + _CHUNK, len(block.ids))) for a in range(0, len(block.ids), _CHUNK)]
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(block.ids)
        least = np.full(len(block.ids), -np.inf)
        positive = k is not None and bool((block.weight > 0).all())
        for table in _tables(batches):
            found = _Postings(table, names, document_weight)
            n = len(found.docs)
            for a, b in chunks:
                s, seen = (None, None) if positive else found.scores(block, a, b)
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids[a:b], n)), pa.array(np.tile(found.docs, b - a)), pa.array(s.ravel())], _SCORED)
                    continue
                for q in range(a, b):
                    bound = least[q] - 1e-8
                    if positive:
                        y, x = found.reaching(block, q, max(bound, 5e-324))
                    else:
                        y = np.flatnonzero(seen[q - a] & (s[q - a] >= bound))
                        x = s[q - a, y]
                    if len(y):
                        d, x = np.append(best[q][0], found.docs[y]), np.append(best[q][1], x)
                        if len(x) > k > 0:
                            least[q] = np.partition(x, len(x) - k)[len(x) - k]
                            near = x >= least[q] - 1e-8
                            d, x = d[near], x[near]
                            if len(x) > 2 * k:  # many of one score: those with the lowest numbers
                                first = np.lexsort((d, -np.round(x, 9)))[:k]
                                d, x = d[first], x[first]
                        best[q] = d, x
        if k is not None:
            for a in range(0, len(block.ids), 256):
                some = best[a : a + 256]
                x = np.repeat(np.arange(len(some)), [len(d) for d, _ in some])
                x, d, s = _first([(x, *(np.concatenate(p) for p in zip(*some)))], k)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[a + x]), pa.array(d), pa.array(s)], _SCORED)

    return score


def _first(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k first of (query, document, score)."""
    x, d, s = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((d, -np.round(s, 9), x))
    x, d, s = x[order], d[order], s[order]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    keep = place < k
    return x[keep], d[keep], s[keep]


class _Lexical:
    """docs: (doc_id, tokens). Tokens are written once, statistics computed once, when first needed."""

    def __init__(self, docs: DataFrame):
        self._given = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
        self._kept: dict[str, object] = {}

    @property
    def docs(self) -> DataFrame:
        return self._once("docs", lambda: written(self._given))

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def df(self) -> DataFrame:
        return self._once("df", lambda: written(document_frequencies(self.docs)))

    def _sides(self) -> DataFrame:
        """(doc_id, tokens, side): what a document's weight needs besides its term counts."""
        raise NotImplementedError

    def _query_weights(self, terms: DataFrame) -> DataFrame:
        """(ord, term, weight) of (ord, term, qtf)."""
        raise NotImplementedError

    def _document_weight(self) -> Callable:
        raise NotImplementedError

    def _scored(self, queries: DataFrame, k: int | None) -> DataFrame:
        """(ord, doc_id, score) of each task's k best per query, block by block of queries."""
        spark = self._given.sparkSession
        terms = queries.select("ord", F.explode("tokens").alias("term")).groupBy("ord", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))
        weights = written(self._query_weights(terms))
        if k is None:  # queries without a known term have scores too
            rest = queries.select("ord").distinct().join(weights.select("ord").distinct(), "ord", "left_anti")
            weights = written(weights.unionByName(rest.select("ord", F.lit("").alias("term"), F.lit(0.0).alias("weight"))))
        blocks, found = math.ceil(weights.count() / BLOCK_TERMS), None
        for i in range(blocks):
            rows = weights.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == i).select(F.col("ord").cast("bigint").alias("ord"), "term", "weight").toArrow()
            if rows.num_rows:
                shared = spark.sparkContext.broadcast(_block(rows))
                sides = self._sides()
                if k is not None:  # each task gives k documents a query, so there are no more tasks than cores
                    sides = sides.coalesce(math.ceil(spark.sparkContext.defaultParallelism / blocks))
                part = sides.mapInArrow(_scorer(shared, k, self._document_weight()), "ord bigint, doc_id bigint, score double")
                found = part if found is None else found.unionByName(part)
        return spark.createDataFrame([], "ord bigint, doc_id bigint, score double") if found is None else found

    def search(self, queries: DataFrame, k: int = 100, pad_zeros: bool = False) -> DataFrame:
        """(ord, doc_id, score, rank), ranks 1 to k; with pad_zeros documents without a match fill up, with score 0."""
        found = self._scored(queries, k)
        if pad_zeros:
            found = written(found)
            # of the k first documents a query that needs more matches fewer than it lacks places
            low = [r["doc_id"] for r in self.docs.select("doc_id").orderBy("doc_id").limit(k).collect()]
            all_low = F.array(*[F.lit(d) for d in low]).cast("array<bigint>")
            zeros = queries.select("ord").distinct().select("ord", F.explode(all_low).alias("doc_id")).join(found, ["ord", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
            found = found.unionByName(zeros)
        order = Window.partitionBy("ord").orderBy(F.round("score", 9).desc(), "doc_id")
        found = found.repartition("ord")  # else Spark sorts every task's rows for a limit that they keep already
        return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)

    def band(self, queries: DataFrame, start: int, stop: int) -> DataFrame:
        """Ranks start + 1 to stop."""
        return self.search(queries, stop).where(F.col("rank") > start)

    def scores(self, queries: DataFrame) -> DataFrame:
        """(ord, doc_id, score) of every document for every query (ord, tokens); 0 without a match.

        As many rows as queries times documents: for a few queries, or for sinks that take that.
        """
        return self._scored(queries, None)


class BM25(_Lexical):
    """Okapi BM25: idf = ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes epsilon times the mean idf over all terms.

    A repeated query term counts as often as it is there; lengths are relative
    to the mean over all documents, empty ones too.
    """

    def __init__(self, docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25):
        super().__init__(docs)
        self.k1, self.b, self.epsilon = k1, b, epsilon

    def _totals(self) -> tuple[float, float, float]:
        def compute():
            self.docs  # written once, before both
            (n, length), _ = together(lambda: self.docs.agg(F.count(F.lit(1)), F.avg(F.size("tokens").cast("double"))).head(), lambda: self.df)
            mean = self.df.agg(F.avg(self._idf(float(n)))).head()[0]
            return float(n), float(length or 0.0), float(mean or 0.0)

        return self._once("totals", compute)

    def _idf(self, n: float) -> Column:
        df = F.col("df").cast("double")
        return F.log(F.lit(n) - df + F.lit(0.5)) - F.log(df + F.lit(0.5))

    def idf(self) -> DataFrame:
        """(term, df, idf)."""
        n, _, mean = self._totals()
        raw = self._idf(n)
        return self.df.select("term", "df", F.when(raw < 0, F.lit(self.epsilon * mean)).otherwise(raw).alias("idf"))

    def _query_weights(self, terms: DataFrame) -> DataFrame:
        return terms.join(self.idf(), "term").select("ord", "term", (F.col("qtf") * F.col("idf")).alias("weight"))

    def _sides(self) -> DataFrame:
        _, mean, _ = self._totals()
        k1, b = self.k1, self.b
        side = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.size("tokens").cast("double") / F.lit(mean or 1.0))
        return self.docs.select("doc_id", "tokens", side.alias("side"))

    def _document_weight(self) -> Callable:
        k1 = self.k1
        return lambda tf, side: tf * (k1 + 1.0) / (tf + side)


class Tfidf(_Lexical):
    """Cosine of (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) vectors; query terms that no document has are left out."""

    def _n(self) -> float:
        return self._once("n", lambda: float(self.docs.count()))

    def idf(self) -> DataFrame:
        """(term, df, idf)."""
        n = self._n()
        return self.df.select("term", "df", (F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df").cast("double"))) + F.lit(1.0)).alias("idf"))

    def norms(self) -> DataFrame:
        """(doc_id, norm) of the documents with a term."""

        def compute():
            part = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
            joined = postings(self.docs).join(self.idf(), "term")
            return written(joined.groupBy("doc_id").agg(F.sqrt(F.sum(part * part)).alias("norm")))

        return self._once("norms", compute)

    def _query_weights(self, terms: DataFrame) -> DataFrame:
        w = terms.join(self.idf(), "term").select("ord", "term", ((F.lit(1.0) + F.log("qtf")) * F.col("idf")).alias("w"))
        norm = w.groupBy("ord").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "ord").join(self.idf().select("term", "idf"), "term").select("ord", "term", (F.col("w") / F.col("norm") * F.col("idf")).alias("weight"))

    def _sides(self) -> DataFrame:
        return self._once("sides", lambda: written(self.docs.join(self.norms(), "doc_id", "left").select("doc_id", "tokens", F.coalesce("norm", F.lit(1.0)).alias("side"))))

    def _document_weight(self) -> Callable:
        return lambda tf, side: (1.0 + np.log(tf)) / side


def distinct_terms(queries: DataFrame) -> DataFrame:
    """Queries without repeated terms."""
    return queries.select("ord", F.array_sort(F.array_distinct("tokens")).alias("tokens"))


def rank_all(retriever: Retriever, queries: DataFrame, gold: DataFrame, depth: int = 100) -> DataFrame:
    """(ord, rank): the first gold document's position within ``depth``, null beyond."""
    from kildespor.operators.metrics import first_gold_ranks

    return first_gold_ranks(retriever.search(queries, depth), gold, queries)
