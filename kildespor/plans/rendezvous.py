"""Dealing units of any size to a few named places in given shares, by weighted rendezvous hashing.

Every unit scores every place by a hash of both and the place's share; where
all places have room it goes to the one it scores highest, so it stays there
when other units come or go. Quotas are a correction: a unit chooses only among
places that still have room for the whole of it within its stratum, larger
units are let in first, and those that a full place turns away choose again.
The same rule holds at every number and size of units.

What fits nowhere within its stratum is dealt in the same way by what places
lack over all strata, and what fits nowhere then, to the places that lack most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kildespor.plans.quota import cuts, place
from kildespor.plans.shared import small, written

#: Strata that have quotas of their own, and places. Both bound what the driver holds.
STRATA, PLACES = 256, 1000


def _cost(unit: Column, name: str, seed: int) -> Column:
    """An exponentially distributed number of the unit and the place."""
    return -F.log((place(unit, name, str(seed)) + F.lit(1)) / F.lit(float(2**48 + 2)))


def score(unit: Column, name: str, weight: Column, seed: int) -> Column:
    """Weighted rendezvous hashing: the place with the highest score gets the unit."""
    return F.when(weight > 0, weight / _cost(unit, name, seed)).otherwise(F.lit(-1.0))


def _order(seed: int) -> Column:
    """A place in [0, 2**48): larger units first, by powers of two, then by hash."""
    power = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("bigint")
    return F.shiftleft(F.lit(63) - power, 42) + F.shiftrightunsigned(place(F.col("unit"), f"order{seed}"), 6)


def _dealt(units: DataFrame, left: dict[tuple[str, str], float], shares: dict[str, float], seed: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of (unit, name), units that fit nowhere). ``left`` is what each (stratum, name) lacks, and is kept up to date."""
    spark, names = units.sparkSession, sorted(shares)
    strata = sorted({s for s, _ in left})
    done: list[DataFrame] = []
    for _ in range(len(names) + 2):
        room = small(spark, [(s, [left[s, n] for n in names]) for s in strata], "stratum string, room array<double>")
        scores = F.array(*[
            F.struct(score(F.col("unit"), n, F.when(F.col("size") <= F.col("room")[i], F.lit(shares[n])).otherwise(0.0), seed).alias("s"), F.lit(n).alias("n"))
            for i, n in enumerate(names)
        ])
        best = F.array_max(scores)
        chosen = written(
            units.join(F.broadcast(room), "stratum")
            .withColumn("best", best)
            .select("unit", "stratum", "size", F.when(F.col("best.s") >= 0, F.col("best.n")).alias("name"), _order(seed).alias("at"))
        )
        wishes = chosen.where("name is not null")
        cut = cuts(wishes, ["stratum", "name"], "size", "at", left)
        limits = small(spark, [(s, n, c) for (s, n), c in cut.items()], "stratum string, name string, cut bigint")
        decided = chosen.join(F.broadcast(limits), ["stratum", "name"], "left")
        taken = decided.where("at < cut")
        got = taken.groupBy("stratum", "name").agg(F.sum("size").alias("s")).collect()
        for r in got:
            left[r["stratum"], r["name"]] -= float(r["s"])
        units = decided.where("cut is null or at >= cut").select("unit", "stratum", "size")
        if got:
            done.append(taken.select("unit", "name"))
        if not got or units.isEmpty():
            break
    return done, units


def deal(units: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(unit, name) for units (unit string, stratum string, size): each stratum's sizes near the shares.

    Shares that are null or not positive get nothing. The STRATA strata with most
    in them have quotas of their own, all others one in common. A null stratum
    is one of its own.
    """
    spark = units.sparkSession
    shares = {n: float(s) for n, s in shares.items() if s and s > 0}
    if not shares:
        raise ValueError("no positive share")
    if len(shares) > PLACES:
        raise ValueError(f"over {PLACES} shares")
    whole = sum(shares.values())
    shares = {n: s / whole for n, s in shares.items()}
    units = written(units.select("unit", F.coalesce("stratum", F.lit("\u0001none")).alias("stratum"), "size"))
    by = units.groupBy("stratum").agg(F.sum("size").alias("s")).orderBy(F.col("s").desc(), "stratum").limit(STRATA).collect()
    total = units.agg(F.sum("size")).head()[0] or 0
    sums = {r["stratum"]: float(r["s"]) for r in by}
    if rest := total - sum(sums.values()):
        sums["\u0001rest"] = rest
        known = small(spark, [(s,) for s in sums], "stratum string").withColumn("_known", F.lit(True))
        units = units.join(F.broadcast(known), "stratum", "left").select("unit", F.when(F.col("_known"), F.col("stratum")).otherwise("\u0001rest").alias("stratum"), "size")
    left = {(s, n): v * shares[n] for s, v in sums.items() for n in shares}
    # a unit larger than any quota of its stratum: less than one in a stratum and place, so they are few
    most = small(spark, [(s, v * max(shares.values())) for s, v in sums.items()], "stratum string, most double")
    names = sorted(shares)
    costs = F.array(*[_cost(F.col("unit"), n, seed) for n in names]).alias("costs")
    large = units.join(F.broadcast(most), "stratum").where("size > most").select("unit", "stratum", "size", costs).collect()
    lacking = {n: sum(left[s, n] for s in sums) for n in shares}
    placed = []
    for r in sorted(large, key=lambda r: (-r["size"], r["unit"])):
        fits = {n: shares[n] for n in shares if r["size"] <= lacking[n]} or {n: v for n, v in lacking.items() if v == max(lacking.values())}
        cost = dict(zip(names, r["costs"]))
        name = max(fits, key=lambda n: (max(fits[n], 1e-9) / cost[n], n))
        placed.append((r["unit"], name))
        lacking[name] -= r["size"]
        left[r["stratum"], name] -= r["size"]
    done = small(spark, placed, "unit string, name string")
    if placed:
        units = units.join(F.broadcast(done.select("unit")), "unit", "left_anti")
    parts, units = _dealt(units, left, shares, seed)
    if not units.isEmpty():
        lacking = {("", n): sum(left[s, n] for s in sums) for n in shares}
        more, units = _dealt(units.withColumn("stratum", F.lit("")), lacking, shares, seed)
        parts += more
        weights = {n: max(0.0, lacking["", n]) for n in shares}
        if not any(weights.values()):
            weights = shares
        scores = F.array(*[F.struct(score(F.col("unit"), n, F.lit(w), seed).alias("s"), F.lit(n).alias("n")) for n, w in sorted(weights.items())])
        parts.append(units.select("unit", F.array_max(scores)["n"].alias("name")))
    for part in parts:
        done = done.unionByName(part)
    return done
