"""Exact ranking by cosine of vectors.

Queries are dealt by hash to blocks of about BLOCK_VALUES numbers, which are
broadcast one by one; each task multiplies its documents with all of a block
and keeps the first k per query, counts how many documents beat the best gold
one, or both. So nothing quadratic is ever stored.
All pairs are multiplied in single precision; those that its error bound doesn't
settle are multiplied again in double precision, from which all results come.
Null and all-zero vectors take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kildespor.plans.shared import written

#: Numbers of query vectors that are broadcast at once, about: 64 MB.
BLOCK_VALUES = 8_000_000
#: Similarities that a task holds at a time, queries they are of, and pairs multiplied again at a time.
_PAIRS, _CHUNK, _AGAIN = 1_048_576, 256, 65_536
#: Documents that give a lower bound of each query's k-th best similarity, where there are several times as many.
_BOUNDING = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        size = column.value_lengths().to_numpy()
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(size)), size)
        length = np.sqrt(np.bincount(row, flat * flat, minlength=len(size)))
        good = np.isfinite(length) & (length > 0)
        keep = good[row]
        values = flat[keep] / length[row[keep]]
        offsets = np.r_[0, np.cumsum(size[good])].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], batch.schema.names)


def usable(vectors: DataFrame, id_col: str) -> DataFrame:
    """(id_col, vector) of the usable ones, with length 1; those with a null, NaN or infinite number aren't."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias(id_col), "vector").where(F.col("vector").isNotNull())
    return rows.mapInArrow(_normalised, f"{id_col} bigint, vector array<double>")


def _matrix(column) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


_FOUND = "ord bigint, doc_id bigint, score double, beaten bigint"


def _error(dimensions: int) -> float:
    """More than a product of vectors of length 1 can be off in single precision."""
    return (dimensions + 8) * 2.0**-23


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix in which little is true: eight at a time are looked at first."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.nonzero(mask)
    eight = np.flatnonzero(flat.view(np.uint64))
    i, j = np.nonzero(flat.reshape(-1, 8)[eight])
    return np.divmod(eight[i] * 8 + j, mask.shape[1])


def _exactly(q: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of q[x] and v[y] in double precision."""
    if len(x) > len(q) * len(v) // 8:
        return (q @ v.T)[x, y]
    return np.concatenate([np.einsum("ij,ij->i", q[x[a : a + _AGAIN]], v[y[a : a + _AGAIN]]) for a in range(0, max(1, len(x)), _AGAIN)])


def _bounded(shared, k: int):
    """Rows of queries with the k-th best similarity to the shared documents, as found, less its error, at the end."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for table in _tables(batches, _CHUNK):
            s = _matrix(table["vector"]).astype(np.float32) @ v.T
            least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] - _error(v.shape[1])
            yield from table.append_column("least", pa.array(least.astype(np.float64))).to_batches()

    return bound


class _Best:
    """The first k documents of each query of a chunk so far."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k, self.parts, self.held = least.copy(), k, [], 0

    def add(self, x: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least[x] - 1e-8
        self.parts.append((x[keep], doc[keep], score[keep]))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.k * len(self.least):
            x, d, s = self.first()
            self.parts, self.held = [(x, d, s)], len(x)
            last = np.flatnonzero(np.arange(len(x)) - np.searchsorted(x, x) == self.k - 1)
            self.least[x[last]] = np.maximum(self.least[x[last]], s[last])

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _first(self.parts, self.k)


def _scanned(shared, k: int):
    """Rows (doc_id, vector) to each query's k best, and, where a score to beat is given, the number of documents over it (doc_id null).

    A task holds _PAIRS similarities at a time, of a chunk of queries and a stretch of documents.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, to_beat, least = shared.value
        q32, off = q.astype(np.float32), _error(q.shape[1])
        beaten = np.zeros(len(ids), np.int64)
        chunks = [slice(a, a + _CHUNK) for a in range(0, len(ids), _CHUNK)]
        best = [_Best(np.full(len(ids[c]), -np.inf) if least is None else least[c], k) for c in chunks]
        for table in _tables(batches, _PAIRS // _CHUNK):
            doc, v = table["doc_id"].to_numpy(), _matrix(table["vector"])
            v32 = np.ascontiguousarray(v.astype(np.float32).T)
            n = len(doc)
            for c, kept in zip(chunks, best):
                s = q32[c] @ v32
                if to_beat is not None:
                    low = (to_beat[c, None] - (off + 1e-8)).astype(np.float32)
                    high = (to_beat[c, None] + (off + 1e-8)).astype(np.float32)
                    over = s > high
                    beaten[c] += np.count_nonzero(over, axis=1)
                    x, y = _places((s >= low) & ~over)
                    if len(x):
                        x = x[np.round(_exactly(q[c], v, x, y), 9) > to_beat[c][x]]
                        beaten[c] += np.bincount(x, minlength=len(s))
                if not k:
                    continue
                if n > k and np.isneginf(kept.least).any():
                    kept.least = np.maximum(kept.least, np.partition(s, n - k, axis=1)[:, n - k].astype(np.float64) - off)
                x, y = _places(s >= (kept.least[:, None] - (off + 1e-7)).astype(np.float32))
                if len(x):
                    kept.add(x, doc[y], _exactly(q[c], v, x, y))
        none = lambda n: pa.nulls(n, pa.int64())
        for c, kept in zip(chunks, best):
            if kept.parts:
                x, d, s = kept.first()
                yield pa.RecordBatch.from_arrays([pa.array(ids[c][x]), pa.array(d), pa.array(s), none(len(x))], ["ord", "doc_id", "score", "beaten"])
        if to_beat is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids), none(len(ids)), pa.nulls(len(ids), pa.float64()), pa.array(beaten)], ["ord", "doc_id", "score", "beaten"])

    return scan


def _first(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k first of (query, document, score)."""
    x, d, s = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((d, -np.round(s, 9), x))
    x, d, s = x[order], d[order], s[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[keep], d[keep], s[keep]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ord").orderBy(F.round("score", 9).desc(), "doc_id")
    found = found.repartition("ord")  # else Spark sorts every task's rows for a limit that they keep already
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


class Dense:
    """docs: (doc_id, vector); queries: (ord, vector)."""

    def __init__(self, docs: DataFrame | None = None):
        self._given, self._written = docs, None

    @property
    def docs(self) -> DataFrame | None:
        """(doc_id, vector) of the usable documents, with length 1, written once when first needed."""
        if self._written is None and self._given is not None:
            self._written = written(usable(self._given, "doc_id"))
        return self._written

    def _require(self) -> DataFrame:
        if self._given is None:
            raise RuntimeError("the corpus must be encoded before searching")
        return self.docs

    def _scan(self, queries: DataFrame, k: int) -> DataFrame:
        """Rows of _FOUND for queries (ord, vector) with length 1 and, it may be, ``score``, which to beat."""
        docs, found = self._require(), None
        spark = docs.sparkSession
        size = queries.agg(F.sum(F.size("vector"))).head()[0] or 0
        blocks = math.ceil(size / BLOCK_VALUES)
        if blocks and 0 < k < _BOUNDING and docs.count() > 4 * _BOUNDING:
            some = docs.orderBy(F.xxhash64("doc_id")).limit(_BOUNDING).select("vector").toArrow()
            shared = spark.sparkContext.broadcast(_matrix(some["vector"]).astype(np.float32))
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
            queries = written(queries.mapInArrow(_bounded(shared, k), f"{kinds}, least double"))
        docs = docs.coalesce(spark.sparkContext.defaultParallelism)  # each task gives k documents a query
        for i in range(blocks):
            rows = queries.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == i).toArrow()
            if rows.num_rows:
                to_beat, least = (rows[c].to_numpy() if c in rows.column_names else None for c in ("score", "least"))
                shared = spark.sparkContext.broadcast((rows["ord"].to_numpy(), _matrix(rows["vector"]), to_beat, least))
                part = docs.mapInArrow(_scanned(shared, k), _FOUND)
                found = part if found is None else found.unionByName(part)
        return spark.createDataFrame([], _FOUND) if found is None else found

    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """(ord, doc_id, score, rank), ranks 1 to k."""
        self._require()
        return _ranked(self._scan(written(usable(queries, "ord")), k).select("ord", "doc_id", "score"), k)

    def gold_scores(self, queries: DataFrame, gold: DataFrame) -> DataFrame:
        """(ord, score): each query's best similarity, to 9 digits, to a gold document."""
        q = usable(queries, "ord").withColumnRenamed("vector", "q")
        pairs = gold.select("ord", "doc_id").distinct().join(q, "ord").join(self._require(), "doc_id")
        return pairs.groupBy("ord").agg(F.max(F.round(dot(F.col("q"), F.col("vector")), 9)).alias("score"))

    def ranks(self, queries: DataFrame, gold: DataFrame) -> DataFrame:
        """(ord, rank): 1 + the documents that are more similar than the best gold one, without a cut; ties favour gold.

        A query without a usable vector or gold vector has a null rank, which counts as a miss.
        """
        return self.ranks_and_top(queries, gold, 0)[0]

    def ranks_and_top(self, queries: DataFrame, gold: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
        """(ranks, search) of one pass over the documents."""
        self._require()
        one = usable(queries, "ord")
        asked = written(one.join(self.gold_scores(queries, gold), "ord", "left").withColumn("score", F.coalesce("score", F.lit(float("inf")))))
        found = self._scan(asked, k)
        if k:
            found = written(found)
        beaten = found.where("doc_id is null").groupBy("ord").agg((F.sum("beaten") + 1).alias("rank"))
        beaten = beaten.join(asked.where(F.col("score") < float("inf")).select("ord"), "ord", "left_semi")
        ranks = queries.select("ord").join(beaten, "ord", "left")
        return ranks, _ranked(found.where("doc_id is not null").select("ord", "doc_id", "score"), k)
