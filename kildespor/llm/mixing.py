"""Mixing sources to target weights.

Method: min-cost flow. Documents are aggregated by their membership pattern,
the set of target sources they belong to; only these sums reach the driver
(at most PATTERNS of them). Token capacity flows from patterns to source
quotas; the k-th repetition of a pattern's tokens costs k - 1, so repeats are
used last and evenly. Then documents are chosen in a seeded order up to what
the flow gives each pattern and source.

Sources are compared without case and outer blanks. Documents without a target
source take no part. A source without documents has no tokens. Null or empty
texts have no tokens and are never short of anything. Targets are a few rows;
a null or negative weight or repeat counts as 0, and of several of one source
the one with the greatest weight holds. More than PATTERNS targets or patterns
are an error.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from kildespor.plans.quota import cuts, place

PATTERNS = 10_000


class Flow:
    """Min-cost flow by shortest paths with potentials, on a graph of a few thousand arcs."""

    def __init__(self):
        self.arcs: list[list] = []  # to, capacity left, cost, index of the reverse arc's place
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def run(self, source, sink) -> None:
        order = {x: i for i, x in enumerate(self.out)}
        high = dict.fromkeys(self.out, 0)  # all costs are at least 0 at the start
        while True:
            far, via, heap = {source: 0}, {}, [(0, order[source], source)]
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for i in self.out[x]:
                    y, c, w = self.arcs[i]
                    e = d + w + high[x] - high[y]
                    if c > 0 and (y not in far or e < far[y]):
                        far[y], via[y] = e, i
                        heapq.heappush(heap, (e, order[y], y))
            if sink not in far:
                return
            most = max(far.values())
            for x in high:
                high[x] += far.get(x, most)
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.arcs[via[x] ^ 1][0]
            amount = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount

    def used(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]


def plain(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> dict[str, tuple[Fraction, int]]:
    rows = targets.select(plain(F.col("source")).alias("s"), "weight", "max_repeats").where("s is not null").limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"over {PATTERNS} targets")
    rows.sort(key=lambda r: (r["s"], r["weight"] or 0, r["max_repeats"] or 0))
    return {r["s"]: (max(Fraction(0), Fraction(str(r["weight"] or 0))), max(0, r["max_repeats"] or 0)) for r in rows}


def patterns(documents: DataFrame, targets: list[str], sources: Column) -> DataFrame:
    """documents with ``pattern``: the sorted target sources of each, as an array; those without are left out."""
    wanted = F.array(*[F.lit(t) for t in sorted(targets)]) if targets else F.array().cast("array<string>")
    mine = F.array_sort(F.array_distinct(F.array_intersect(sources, wanted)))
    return documents.withColumn("pattern", mine).where(F.size("pattern") > 0)


def solved(sums: dict[tuple[str, ...], int], targets: dict[str, tuple[Fraction, int]]) -> tuple[dict, dict[str, tuple[Fraction, Fraction]]]:
    """(taken, sources) of tokens by pattern and tokens' targets.

    taken[pattern, source]: tokens of the pattern that the source gets, repeats
    included. sources[s]: (quota, reached). Flow is in parts of a token, so
    quotas are exact.
    """
    total = sum(sums.values())
    scale = 1
    for w, _ in targets.values():
        scale = math.lcm(scale, w.denominator)
    flow, arcs, ends = Flow(), {}, {}
    for p, tokens in sorted(sums.items()):
        for s in p:
            for k in range(1, targets[s][1] + 1):
                flow.arc("in", ("copy", p, s, k), tokens * scale, 0)
                arcs[p, s, k] = flow.arc(("copy", p, s, k), ("source", s), tokens * scale, k - 1)
    for s, (w, _) in targets.items():
        ends[s] = flow.arc(("source", s), "out", int(w * total * scale))
    if arcs:
        flow.run("in", "out")
    taken: dict[tuple, Fraction] = {}
    for (p, s, _), a in arcs.items():
        taken[p, s] = taken.get((p, s), Fraction(0)) + Fraction(flow.used(a), scale)
    return taken, {s: (w * total, Fraction(flow.used(ends[s]), scale)) for s, (w, _) in targets.items()}


def pattern_sums(sized: DataFrame) -> dict[tuple[str, ...], int]:
    rows = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"over {PATTERNS} membership patterns")
    return {tuple(r["pattern"]): int(r["n"]) for r in rows}


def short_sources(sized: DataFrame, targets: DataFrame, sources: Column) -> DataFrame:
    """(source): targets that can't get their weight of the tokens of all documents of target sources."""
    wanted = _targets(targets)
    _, reached = solved(pattern_sums(patterns(sized, list(wanted), sources)), wanted)
    short = {s for s, (quota, got) in reached.items() if got < quota}
    return targets.where(plain(F.col("source")).isin(*sorted(short)) if short else F.lit(False)).select("source").distinct()


def mixture(sized: DataFrame, targets: DataFrame, sources: Column, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: (doc_id, source, repeats). shares: per source the target, quota, tokens and reached share.

    ``sized`` has doc_id, n_tokens and what ``sources`` reads; it is read several times.
    """
    spark = sized.sparkSession
    wanted = _targets(targets)
    docs = patterns(sized, list(wanted), sources).withColumn("key", F.concat_ws("\u0001", "pattern"))
    sums = pattern_sums(docs)
    taken, reached = solved(sums, wanted)
    full, rest = [], {}
    for (p, s), n in taken.items():
        key, tokens = "\u0001".join(p), sums[p]
        times = int(n // tokens) if tokens else 0
        full.append((key, s, times))
        rest[key, s] = float(n - times * tokens)
    plan = spark.createDataFrame(full, "key string, to string, times int")
    spread = docs.select("doc_id", "n_tokens", "key").join(F.broadcast(plan), "key").withColumn("at", place(F.lit(seed), F.col("doc_id"), F.col("to")))
    cut = cuts(spread, ["key", "to"], "n_tokens", "at", rest)
    limits = spark.createDataFrame([(k, s, c) for (k, s), c in cut.items()], "key string, to string, cut bigint")
    chosen = (
        spread.join(F.broadcast(limits), ["key", "to"])
        .withColumn("repeats", F.col("times") + F.when((F.col("at") < F.col("cut")) & (F.col("n_tokens") > 0), 1).otherwise(0))
        .where("repeats > 0")
        .select("doc_id", F.col("to").alias("source"), "repeats", "n_tokens")
    )
    goals = spark.createDataFrame([(s, float(w), float(reached[s][0])) for s, (w, _) in wanted.items()], "source string, weight double, quota double")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    everything = Window.partitionBy(F.lit(0))  # one row a target
    shares = (
        goals.join(got, "source", "left")
        .withColumn("all_tokens", F.sum("tokens").over(everything))
        .select("source", "weight", "quota", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("share"))
    )
    return chosen.select("doc_id", "source", "repeats"), shares
