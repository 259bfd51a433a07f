"""Best–worst scaling: the pool of candidate pairs, the tuples to be judged, and what judges get.

Tuples are laid out as a timetable: with T tuples to fill, the places of all
pairs are listed bin by bin and given out in turn, place i to tuple i mod T. A
bin has at most MAX_PER_BIN * T places in the list, so no tuple gets more of it
than it may, whatever the order; T is the largest number for which bins,
annotations and pairs have enough places under their caps. Only where a tuple
gets too many of one annotation are places exchanged with others of the same bin.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kildespor.functions.text import jaccard, pair_id, tuple_id
from kildespor.operators.corpus import adjacent, duplicates_of, labels
from kildespor.plans.shared import together, written

# Names of the pool's bins, caps within a tuple, and defaults.
BINS = ("1_both", "2_bm25_only", "3_dfmft_only_jac", "4_dfmft_only_zero")
TOP_K, REPS, TUPLE_SIZE, MAX_PER_ANNOTATION, MAX_PER_BIN, DEFAULT_SEED = 3, 4, 4, 2, 2, 20260906
#: So many pairs are drawn from at once, about; a larger pool is drawn from in blocks by hash.
MAX_PAIRS = 100_000


def pool(refs: DataFrame, gold: DataFrame, corpus: DataFrame, books: DataFrame, lexical: DataFrame, tuned: DataFrame, query_tokens: DataFrame, corpus_tokens: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Candidate pairs of references and documents.

    ``lexical`` and ``tuned`` are rankings (ord, doc_id, rank). Of each the first
    top_k are taken before documents with a gold text and neighbours of gold ones
    are left out, so fewer may remain. refs: (ord, id, text, band).
    """
    lexical, tuned, excluded = together(
        lambda: written(lexical.select("ord", "doc_id", "rank")),
        lambda: written(tuned.select("ord", "doc_id", "rank")),
        lambda: written(duplicates_of(gold, corpus).unionByName(adjacent(gold, corpus)).distinct()),
    )

    def top(ranking: DataFrame, name: str) -> DataFrame:
        return ranking.where(F.col("rank") <= top_k).join(excluded, ["ord", "doc_id"], "left_anti").select("ord", "doc_id", F.lit(True).alias(name))

    both = top(lexical, "a").join(top(tuned, "b"), ["ord", "doc_id"], "full_outer")
    ranks = [r.select("ord", "doc_id", F.col("rank").alias(n)) for r, n in ((lexical, "bm25_lemstem_rank"), (tuned, "dfm_ft_rank"))]
    q = query_tokens.select("ord", F.col("tokens").alias("q"))
    d = corpus_tokens.select("doc_id", F.col("tokens").alias("d"))
    empty = F.array().cast("array<string>")
    overlap = jaccard(F.coalesce("q", empty), F.coalesce("d", empty))
    bin_ = F.when(F.col("a") & F.col("b"), BINS[0]).when(F.col("a"), BINS[1]).when(F.col("overlap") > 0, BINS[2]).otherwise(BINS[3])
    return (
        both.join(ranks[0], ["ord", "doc_id"], "left").join(ranks[1], ["ord", "doc_id"], "left")
        .join(q, "ord", "left").join(d, "doc_id", "left")
        .withColumn("overlap", overlap)
        .join(refs.select("ord", "id", F.col("text").alias("blixen_text"), F.col("band").alias("category")), "ord")
        .join(corpus.select("doc_id", "book", "chapter", "verse", F.col("text").alias("bible_text")), "doc_id")
        .join(labels(corpus, books), "doc_id")
        .select(
            pair_id(F.col("id"), F.col("book"), F.col("chapter"), F.col("verse")).alias("pair_id"),
            F.col("id").alias("annotation_id"), F.col("label").alias("reference"), "category", bin_.alias("bin"), F.col("overlap").alias("jaccard"),
            "blixen_text", "bible_text", "bm25_lemstem_rank", "dfm_ft_rank",
        )
        .distinct()
    )


def bin_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _most_tuples(counts: list[np.ndarray], caps: list[int], size: int) -> int:
    """The largest number of tuples for which each kind of counts, capped at its cap per tuple, has places enough."""
    low, high = 0, min(int(c.sum()) for c in counts) // size
    while low < high:
        t = (low + high + 1) // 2
        if all(int(np.minimum(c, cap * t).sum()) >= size * t for c, cap in zip(counts, caps)):
            low = t
        else:
            high = t - 1
    return low


def _listed(bins: np.ndarray, notes: np.ndarray, places: np.ndarray, t: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """size * t places, each as the number of its pair, bin by bin; a pair's copies and an annotation's pairs stand together."""
    take = np.minimum(places, t)
    for kinds, cap in ((notes, MAX_PER_ANNOTATION * t), (bins, MAX_PER_BIN * t), (np.zeros(len(bins), np.int64), size * t)):
        order = rng.permutation(len(take))  # what is over a cap goes from pairs in seeded order
        order = order[np.argsort(kinds[order], kind="stable")]
        upto = np.cumsum(take[order])
        start = np.searchsorted(kinds[order], kinds[order])
        before = (upto - take[order]) - (upto - take[order])[start]
        take[order] = np.clip(cap - before, 0, take[order])
    turn = rng.permutation(notes.max() + 1)
    order = np.lexsort((rng.permutation(len(take)), turn[notes], bins))
    return np.repeat(order, take[order])


def _exchanged(at: np.ndarray, bins: np.ndarray, notes: np.ndarray, t: int, rng: np.random.Generator) -> np.ndarray:
    """The list with places exchanged within a bin where a tuple has too many of an annotation or a pair twice.

    Place i is in tuple i mod t. Returns the number of each place's pair.
    """
    at = at.copy()
    members = [np.arange(i, len(at), t).tolist() for i in range(t)]
    partners = {b: rng.permutation(np.flatnonzero(bins[at] == b)) for b in np.unique(bins[at])}
    next_partner = dict.fromkeys(partners, 0)

    def fits(i: int, pair: int) -> bool:
        """Whether the pair can stand at place i."""
        others = [at[j] for j in members[i % t] if j != i]
        return pair not in others and sum(notes[p] == notes[pair] for p in others) < MAX_PER_ANNOTATION

    tuple_of, note = np.arange(len(at)) % t, notes[at]
    for keys in (tuple_of * (notes.max() + 1) + note, tuple_of * (at.max() + 1) + at):
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(count[inverse] > 1).tolist():
            if fits(i, at[i]):
                continue
            of_bin = partners[bins[at[i]]]
            for _ in range(len(of_bin)):
                j = of_bin[next_partner[bins[at[i]]] % len(of_bin)]
                next_partner[bins[at[i]]] += 1
                if j % t != i % t and fits(i, at[j]) and fits(j, at[i]):
                    at[i], at[j] = at[j], at[i]
                    break
    return at


def _laid_out(bins: np.ndarray, notes: np.ndarray, places: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Tuples by position, as numbers of pairs, for pairs with a bin, an annotation and a number of places."""
    rng = np.random.default_rng(seed)
    t = _most_tuples([np.bincount(bins, places).astype(np.int64), np.bincount(notes, places).astype(np.int64), places], [MAX_PER_BIN, MAX_PER_ANNOTATION, 1], size)
    while t:
        at = _listed(bins, notes, places, t, size, rng)
        if len(at) == size * t:
            break
        t = len(at) // size  # caps of several kinds together leave less than each alone
    if not t:
        return np.zeros((0, size), np.int64)
    at = _exchanged(at, bins, notes, t, rng).reshape(size, t).T
    per_note, per_pair = np.sort(notes[at], axis=1), np.sort(at, axis=1)
    good = (per_pair[:, 1:] != per_pair[:, :-1]).all(axis=1) if size > 1 else np.ones(t, bool)
    if size > MAX_PER_ANNOTATION:
        good &= (per_note[:, MAX_PER_ANNOTATION:] != per_note[:, :-MAX_PER_ANNOTATION]).all(axis=1)
    return rng.permuted(at[good], axis=1)


def draw_tuples(pairs: list[tuple[str, str, str]], reps: int = REPS, size: int = TUPLE_SIZE, seed: int = DEFAULT_SEED) -> tuple[list[list[str]], int]:
    """(tuples, places left over) of (pair_id, annotation_id, bin), each pair to be used ``reps`` times.

    At most MAX_PER_BIN of a bin and MAX_PER_ANNOTATION of an annotation in a tuple, no pair twice.
    """
    drawn, left = _drawn([(*pair, reps) for pair in pairs], size, seed)
    return drawn, sum(left.values())


def _drawn(pairs: list[tuple[str, str, str, int]], size: int, seed: int) -> tuple[list[list[str]], dict[str, int]]:
    """(tuples, places left of each pair) of (pair_id, annotation_id, bin, places)."""
    if not pairs:
        return [], {}
    names, notes, bins, places = zip(*pairs)
    number = lambda values: np.unique([("", "") if v is None else ("x", v) for v in values], axis=0, return_inverse=True)[1].ravel()
    found = _laid_out(number(bins), number(notes), np.array(places, np.int64), size, seed)
    used = np.bincount(found.ravel(), minlength=len(names))
    return [[names[i] for i in row] for row in found.tolist()], {n: int(p - u) for n, p, u in zip(names, places, used)}


_ROW = ["pair_id", "annotation_id", "bin", "reference"]
_BLOCK = pa.schema([("block", pa.int32()), ("number", pa.int32()), ("position", pa.int32()), *[(c, pa.string()) for c in _ROW], ("places", pa.int32())])


def _block(size: int, seed: int, turn: int):
    """A block's pairs to its tuples, numbered from 1, and the pairs with places left, numbered 0."""

    def draw(table: pa.Table) -> pa.Table:
        def order(r):  # as Spark orders strings
            return [(r[c] is not None, (r[c] or "").encode()) for c in ("bin", "annotation_id", "reference", "pair_id")]

        rows = sorted(table.to_pylist(), key=order)
        block = rows[0]["block"]
        drawn, left = _drawn([(r["pair_id"], r["annotation_id"], r["bin"], r["places"]) for r in rows], size, seed + 1_000_003 * turn + block)
        out = [{"block": block, "number": n, "position": i, "pair_id": p} for n, t in enumerate(drawn, 1) for i, p in enumerate(t, 1)]
        out += [{**r, "number": 0, "places": left[r["pair_id"]]} for r in rows if left[r["pair_id"]]]
        return pa.Table.from_pylist(out, schema=_BLOCK)

    return draw


def _usable(left: DataFrame, reps: int, seed: int, turn: int) -> tuple[DataFrame, int]:
    """(pairs with places left that can still be drawn, their number); once those outside the largest bin are few, all of them with as many of it as they can go with."""
    counts = sorted(left.groupBy("bin").count().collect(), key=lambda r: (-r["count"], r["bin"] or ""))
    total = sum(r["count"] for r in counts)
    others = total - (counts[0]["count"] if counts else 0)
    if total <= MAX_PAIRS or others > MAX_PAIRS // (reps + 1):
        return left, total
    largest = F.col("bin").eqNullSafe(F.lit(counts[0]["bin"]))
    some = left.where(largest).orderBy(F.xxhash64("pair_id", F.lit(seed), F.lit(turn)), "pair_id").limit(reps * others)
    return left.where(~largest).unionByName(some), others + min(reps * others, counts[0]["count"])


def left_over(pairs: DataFrame, drawn: DataFrame, reps: int = REPS) -> DataFrame:
    """(n): the places of a pool's pairs that no tuple has."""
    wanted = pairs.where("pair_id is not null").agg((F.count_distinct("pair_id") * reps).alias("n"))
    return wanted.unionByName(drawn.agg((-F.count(F.lit(1))).alias("n"))).agg(F.sum("n").alias("n"))


def tuples(pairs: DataFrame, reps: int = REPS, size: int = TUPLE_SIZE, seed: int = DEFAULT_SEED) -> DataFrame:
    """(tuple_id, position, pair_id). The pool is read in the order of its file: bin, annotation_id, reference.

    A pool over MAX_PAIRS is split into blocks by a hash of the pair, each drawn from by itself on the executors.
    The places that blocks leave over are split and drawn from again, until they are one block or give no tuple.
    """
    spark = pairs.sparkSession
    rows = written(pairs.select(*_ROW).where("pair_id is not null").dropDuplicates(["pair_id"]).withColumn("places", F.lit(reps)))
    count, turn, before, done = rows.count(), 0, 0, []
    while True:
        blocks = max(1, math.ceil(count / MAX_PAIRS))
        block = F.pmod(F.xxhash64("pair_id", F.lit(seed), F.lit(turn)), F.lit(blocks)).cast("int")
        split = rows.withColumn("block", block).repartition(blocks, "block")
        kinds = "block int, number int, position int, pair_id string, annotation_id string, bin string, reference string, places int"
        out = written(split.groupBy("block").applyInArrow(_block(size, seed, turn), kinds))
        drawn, offsets = 0, []
        for r in sorted(out.groupBy("block").agg(F.max("number").alias("n")).collect()):
            offsets.append((r["block"], before + drawn))
            drawn += r["n"]
        offset = F.broadcast(spark.createDataFrame(offsets, "block int, before int"))
        done.append(
            out.where("number > 0").join(offset, "block").select(tuple_id(F.col("number") + F.col("before")).alias("tuple_id"), "position", "pair_id")
        )
        if blocks == 1 or not drawn:
            return reduce(DataFrame.unionByName, done)
        before, turn = before + drawn, turn + 1
        rows, count = _usable(out.where("number = 0").select(*_ROW, "places"), reps, seed, turn)


def sheets(pairs: DataFrame, drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(for judges, key) of a study: the first without anything that tells where a pair comes from."""
    rows = drawn.join(pairs.dropDuplicates(["pair_id"]), "pair_id")
    blank = F.lit("")
    judges = rows.select("tuple_id", "position", "pair_id", "reference", "blixen_text", "bible_text", blank.alias("BEST"), blank.alias("WORST"))
    key = rows.select("tuple_id", "position", "pair_id", "annotation_id", "reference", "category", "bin", "jaccard", "bm25_lemstem_rank", "dfm_ft_rank")
    return judges, key
